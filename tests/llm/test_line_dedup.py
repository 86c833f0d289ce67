import hashlib
import random
from collections import defaultdict

import duckdb

from twinleaf.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines string, other int"


def brute(rows, sites):
    spread = defaultdict(set)
    for _, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            if s is not None and line.strip(" \t\r"):
                spread[line.strip(" \t\r")].add(s)
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if len(spread[x.strip(" \t\r")]) < sites]
        n = lambda xs: sum(bool(x.strip(" \t\r")) for x in xs)
        out.append((i, n(lines), len(lines) - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    shared = [f"Shared line {k} \t" for k in range(12)]
    rows = []
    for i in range(220):
        lines = [f"own text of document {i} number {k}" for k in range(rng.randrange(5))]
        for _ in range(rng.randrange(3)):
            lines.insert(rng.randrange(len(lines) + 1), " " * rng.randrange(2) + rng.choice(shared[: rng.choice([3, 12])]))
        rows.append((i, "\n".join(lines), f"s{rng.randrange(14)}", "x", i))
    return rows + [(900, None, "s1", None, 0), (901, "", "s1", None, 0), (902, "\n \n", None, None, 0), (903, shared[0] + "\n" + shared[1], None, None, 0)]


def test_matches_brute_force_and_sql(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, line_dedup.dedup_lines(df, 10).collect()), key=str)
    assert got == brute(rows, 10) and sum(r[2] for r in got) > 20
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [r[:3] for r in rows])
    assert sorted(con.sql(line_dedup.oracle(10)).fetchall(), key=str) == got


def test_other_columns_null_ids_and_nothing(spark):
    schema = SCHEMA + ", _hit int, _n string, _keys int"
    rows = [(i, f"mine {i}\nboiler\n\nboiler ", f"s{i}", "x", i, i, "n", 1) for i in range(11)]
    rows += [(None, "a text without an id\nboiler", "s1", "x", 5, 1, "n", 1), (None, "boiler\n another", "s1", "x", 5, 1, "n", 1), (3, "the same id\nboiler", None, "y", 6, 1, "n", 1), rows[4], (5, None, "s1", "x", 1, 1, "n", 1)]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, schema), 10)
    got = out.collect()
    assert set(out.columns) == {*schema.replace(",", "").split()[::2], "n_removed"} and len(got) == len(rows)
    assert sorted(str(r.text) for r in got) == sorted(str(t and t.replace("\nboiler ", "").replace("\nboiler", "").replace("boiler\n", "")) for _, t, *_ in rows)
    assert sorted(r.n_removed for r in got) == [0] + [1] * 3 + [2] * 12
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_a_very_long_text_and_a_page_of_nothing_but_boilerplate(spark):
    shared = [f"common line {k}" for k in range(30)]
    rows = [(i, "\n".join(shared), f"s{i}", "x", 1) for i in range(12)]
    long = "\n".join(f"line {k}" if k % 3 else shared[k % 30] for k in range(120_000))
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(spark.createDataFrame([*rows, (50, long, "s1", "x", 1)], SCHEMA), 10).collect()}
    assert got[50].n_removed == 40_000 and got[50].text == "\n".join(f"line {k}" for k in range(120_000) if k % 3)
    assert all(got[i].text == "" and got[i].n_removed == 30 for i in range(12))
