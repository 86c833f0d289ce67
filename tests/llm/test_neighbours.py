import math

import numpy as np

from twinleaf.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, v string, score int"


def brute(rows, every, k):
    ok = [(i, np.array(e, dtype=np.float32).astype(float)) for i, e in rows if i is not None and e and all(c is not None and math.isfinite(c) for c in e) and any(e)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            found = sorted((-float((x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum()))), j) for j, x in ok if j != i and len(x) == len(q))
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def check(spark, rows, every, least):
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA).repartition(3)
    got = {}
    for r in sorted(neighbours.nearest(df, every, 5).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, every, 5)
    assert {q for q, w in want.items() if w} == set(got)
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    scores = {q: {j for j, _ in w} for q, w in want.items()}
    hit = sum(len({j for j, _ in got.get(q, [])} & w) for q, w in scores.items())
    assert hit >= least * sum(map(len, scores.values()))
    return got, want


def test_recall_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 700)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] * 0.5 + rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = check(spark, rows, 50, 0.9)
    close = {q: dict(w) for q, w in want.items()}
    assert all(abs(s - close[q][j]) < 1e-12 for q, f in got.items() for j, s in f if j in close[q])


def test_ties_odd_vectors_and_repeats(spark):
    same = [0.25, 0.5, -1.0]
    rows = [(i, same) for i in range(0, 40)] + [(100, [0.5, 1.0, -2.0]), (101, None), (102, []), (103, [0.0, 0.0, 0.0]), (104, [1.0, None, 0.0]), (105, [float("nan"), 1.0, 0.0]), (106, [float("inf"), 0.0, 0.0]), (None, same), (107, [1.0, 0.0]), (110, [2.0, 1.0]), (200, [0.1] * 4), (7, same)]
    got, want = check(spark, rows, 10, 1.0)
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[10]] == [0, 1, 2, 3, 4] and 200 not in got


def test_empty_table(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
