import random

import duckdb
import numpy as np

from twinleaf.llm import common, minhash


def brute(rows, k, percent):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [(i, sh(t)) for i, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[find(x)] = find(y)
    least = {}
    for x in range(len(rows)):
        least[find(x)] = min(least.get(find(x), 1 << 60), sets[x][0])
    return sorted((i, len(s), least[find(x)], i == least[find(x)]) for x, (i, s) in enumerate(sets))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["The", "the", "É", "a b"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 8, 30, 200]))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 12])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append((1000 - 3 * i, rng.choice([" ", "\n", "  \t"]).join(w)))
    return out + [(2, None), (3, ""), (4, " \n "), (5, "w1")]


def test_components_match_brute_force(spark):
    for seed, k in ((1, 2), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, bands string, rep int")
        assert sorted(map(tuple, minhash.near_duplicates(df, k, 80).collect())) == brute(rows, k, 80)


def test_sql_matches_brute_force():
    rows = corpus(4, 60)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.sql(minhash.oracle(2, 80)).fetchall()) == brute(rows, 2, 80)


def test_chains_of_links_are_joined(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = dict(map(tuple, minhash.components(df).collect()))
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[101], got[102]} == {100}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    errors = []
    for shared in (0, 300, 800):
        a, b = pool[:1000], np.concatenate([pool[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])
        got = minhash.super_minhash(np.repeat([0, 1], 1000), np.concatenate([a, b]), 2, 160)
        errors.append(abs((got[0] == got[1]).mean() - shared / (2000 - shared)))
    assert max(errors) < 0.12
    small = minhash.super_minhash(np.zeros(3, dtype=np.int64), pool[:3], 1, 160)
    assert small.max() < np.uint64(1 << 63)


def test_empty_table_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A B C")], schema)
    got = sorted(map(tuple, minhash.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, False), (2, 2, 1, False)], key=str)
    assert sorted(r.doc_id or 0 for r in minhash.drop_near_duplicates(df, 2).collect()) == [0, 1, 1]


def family(seed, n, words, changed, plain=()):
    """n texts of so many words, each with some of them replaced by words of its own."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), 0 if i in plain else changed):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 20)
    for rounds in (0, 1):  # without leaders every link is found by the exact join
        monkeypatch.setattr(minhash, "ROUNDS", rounds)
        rows = family(9, 300, 300, 27, range(0, 300, 50))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, minhash.near_duplicates(df, 2).collect())) == brute(rows, 2, 80)


def test_forests_of_dense_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rows = [*family(9, 300, 300, 14, range(0, 300, 50)), *((i + 300, t) for i, t in family(11, 200, 300, 17))]  # pairs at about 0.83 and 0.79
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2, 80)
    for few, held in ((0, 1 << 19), (2, 50)):
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "HELD", held)
        assert sorted(map(tuple, minhash.near_duplicates(df, 2).collect())) == want


def test_forest_spans_what_its_edges_join_at_least_weight():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(2, 40)
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.0, 0.5, rng.random()])) for _ in range(rng.randrange(0, 90))]
        p, q, w = (np.array([e[c] for e in edges], dtype=t) for c, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
        root, total, joins = list(range(n)), 0.0, 0

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y, far in sorted(edges, key=lambda e: e[2]):
            if find(x) != find(y):
                root[find(x)] = find(y)
                total, joins = total + far, joins + 1
        got = minhash.forest(p, q, w, n)
        assert len(got) == joins and abs(w[got].sum() - total) < 1e-9


def test_every_pair_at_the_threshold_is_a_candidate(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 30)
    rows = [*family(3, 60, 90, 5), *((100 + i, t) for i, t in corpus(6, 120) if t)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "rep long, tree long, text string")
    members = minhash.rare_shingles(df, 2, 80)
    got = {tuple(r) for r in minhash.candidates(members, minhash.key_sizes(members), 80).collect()}
    sets = {i: {tuple(t.encode().lower().split()[k : k + 2]) for k in range(max(len(t.split()) - 1, 1))} for i, t in rows}
    want = {(x, y) for x in sets for y in sets if y < x and sets[x] != {()} and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert want <= got and len(want) > 100


def test_a_family_below_the_threshold_takes_linear_rows(spark):
    counts = []
    for n in (400, 1600):
        rows = family(5, n, 100, 5)  # about 10 of 99 shingles changed: pairs at about 0.68
        df = spark.createDataFrame([(i, i, t) for i, t in rows], "rep long, tree long, text string")
        members = minhash.rare_shingles(df, 2, 80)
        counts.append((members.count(), minhash.candidates(members, minhash.key_sizes(members), 80).count()))
    assert counts[1][0] <= 4.4 * counts[0][0] and counts[1][1] <= 1600


def test_structured_words_do_not_collide(spark):
    text = "a"
    for _ in range(10):
        text += text.translate(str.maketrans("ab", "ba"))
    other = text.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, text), (2, other), (3, f"{text} {other}"), (4, f"{other} {text}")], "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(df, 2).orderBy("doc_id").collect()] == [1, 2, 3, 4]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(common.Ranges, "__call__", lambda self, start, end: np.zeros(len(start), dtype=np.uint64))
    text = "b a b a b c a"
    row, x = minhash.exact_shingles(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, 7, len(text)]), 2)
    assert row.tolist() == [0, 0, 1, 1] and len(set(x.tolist())) == 4


def test_a_very_long_text_and_odd_columns(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(250_000)]
    long = " ".join(words)
    near = " ".join(["start", *words, "end"])
    rows = [(1, long), (2, near), (3, "short text here"), (4, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, _bits int, _bucket int, _hit int, hit int")
    out = minhash.drop_near_duplicates(df, 5)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    whole = {tuple(words[i : i + 2]) for i in range(len(words) - 1)}
    got = {r.doc_id: r.n_shingles for r in minhash.near_duplicates(df, 2).collect()}
    assert got[1] == len(whole)
    row = np.zeros(50_000, dtype=np.int64)
    element = rng_elements(50_000)
    parts = minhash.super_minhash(row, element, 1, 160)
    assert (parts == minhash.super_minhash(row, element, 1, 160, most=10**9)).all()


def rng_elements(n):
    return np.random.default_rng(4).integers(0, 1 << 63, n, dtype=np.uint64)
