import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from twinleaf.llm import suffix_dedup


def brute(rows, depth):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + depth] for b in raw for s in range(len(b) - depth + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 2, dtype=bool)
        for s in range(len(b) - depth + 1):
            if seen[b[s : s + depth]] > 1:
                gone[s + 1 : s + 1 + depth] = True
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice(["ab", "é", "the ", "x", "\n", "0", "zq"]) for _ in range(n))

    passages = [text(n) for n in (30, 120, 160, 260, 700)] + ["a" * 450, "abc" * 150, "é" * 180]
    rows = []
    for i in range(90):
        parts = [text(rng.choice([0, 3, 50, 300]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(["", "!", "??"]) + p[k:]
            parts += [p, text(rng.choice([0, 1, 40]))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200, None), (201, ""), (202, "short"), (203, "q" * 199), (204, "r" * 200), (205, "s" * 201)]
    return rows


@pytest.mark.parametrize("depth", [40, 200])
def test_matches_brute_force(spark, depth):
    rows = corpus(depth)
    df = spark.createDataFrame([(i, t, 1, [1]) for i, t in rows], "doc_id long, text string, n int, runs array<int>").repartition(5)
    got = sorted(map(tuple, suffix_dedup.dedup_substrings(df, depth).collect()), key=str)
    assert got == brute(rows, depth)


def test_equal_ids_null_ids_and_nothing(spark):
    schema = "doc_id long, text string"
    rows = [(1, "k" * 150 + "x" * 120), (1, "k" * 150 + "x" * 120), (None, "nothing here")]
    got = sorted(map(tuple, suffix_dedup.dedup_substrings(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == brute(rows, 200)
    assert suffix_dedup.dedup_substrings(spark.createDataFrame([], schema)).count() == 0
    kept = suffix_dedup.dedup_substrings(spark.createDataFrame([(5, "é!")], schema), with_text=True).first()
    assert bytes(kept.kept) == "é!".encode()


def test_each_window_has_the_leftmost_least_seed():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 900, dtype=np.uint8)
    data[300:420] = 97
    bounds = np.array([0, 0, 250, 700, 705, 900])
    start, n, place, core = suffix_dedup.anchors(data, bounds, 60)
    h = suffix_dedup.seeds(data)
    assert (core == h[place]).all()
    kinds = {}
    assert all(kinds.setdefault(data[i : i + 32].tobytes(), x) == x for i, x in enumerate(h)) and len(set(kinds.values())) == len(kinds)
    got = {s + k: p for s, c, p in zip(start, n, place) for k in range(c)}
    want = {s: s + int(np.argmin(h[s : s + 29])) for lo, hi in zip(bounds, bounds[1:]) for s in range(lo, hi - 59)}
    assert got == want


def thue_morse(steps):
    text = "a"
    for _ in range(steps):
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_structured_strings_and_a_very_long_text(spark):
    a, b = thue_morse(10)
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(1_500_000))
    rows = [(1, "x" + a), (2, "y" + b), (3, long), (4, "!" + long[1_200_000:1_200_199] + "!" + long[700_000:700_250] + "?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.dedup_substrings(df).collect()))
    assert got[0] == brute([rows[0], rows[1]], 200)[0] and got[1] == brute([rows[0], rows[1]], 200)[1]
    assert [r[1:4] for r in got[2:]] == [(1_500_000, 250, 1), (199 + 250 + 3, 250, 1)]
