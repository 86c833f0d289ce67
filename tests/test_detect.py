import random

from twinleaf.model import CHANGED_LINES, SUBTREES
from twinleaf.operators import detect


def frame(spark, rows):
    return spark.createDataFrame([(f, k, k, s, e, n, bytearray(h.encode())) for k, (f, s, e, n, h) in enumerate(rows)], SUBTREES)


def greedy(rows):
    """From the largest group down: a group goes if groups that stayed hold all its instances."""
    groups = {}
    for f, s, e, n, h in rows:
        groups.setdefault(h, []).append((f, s, e, n))
    groups = {h: g for h, g in groups.items() if len(g) > 1}
    stayed, ranges = set(), []
    for h, g in sorted(groups.items(), key=lambda x: -x[1][0][3]):
        n = g[0][3]
        if not all(any(f == f2 and n2 > n and s2 <= s and e2 >= e for f2, s2, e2, n2 in ranges) for f, s, e, _ in g):
            stayed.add(h)
            ranges += [(f, s, e, n) for f, s, e, _ in g]
    return stayed


def test_one_anti_join_is_the_greedy_walk(spark):
    rng = random.Random(1)
    rows = []
    for case in range(120):
        for g in range(8):
            n = rng.randrange(1, 9)
            for _ in range(rng.choice([1, 2, 2, 3])):
                s = rng.randrange(1, 12)
                rows.append((f"{case}-{rng.randrange(2)}", s, s + rng.randrange(6), n, f"{case}-{g}"))
    want = greedy(rows)
    inst = detect.instances(frame(spark, rows))
    got = {bytes(r.hash).decode() for r in detect.subsumption(inst).select("hash").distinct().collect()}
    assert got == want
    covered = detect.covered(inst)
    assert covered.count() == inst.count()
    assert {bytes(r.hash).decode() for r in covered.where("NOT covered").select("hash").distinct().collect()} == want


def test_patch_filter(spark):
    cases = [
        ([("A", 100, 102)], [("B", 1, 5), ("C", 1, 5)], False),
        ([("A", 1, 50)], [("A", 1, 10), ("A", 11, 20)], True),
        ([("N", 1, 20)], [("N", 5, 15), ("E", 30, 40)], True),
        ([("S", 40, 40), ("N", 1, 20)], [("N", 5, 15), ("S", 35, 45)], True),
        ([("F", 50, 70)], [("F", 10, 20), ("F", 55, 65)], True),
    ]
    for ranges, own, kept in cases:
        changed = spark.createDataFrame([(f, n) for f, a, b in ranges for n in range(a, b + 1)], CHANGED_LINES)
        inst = detect.instances(frame(spark, [(f, s, e, 5, "h") for f, s, e in own]))
        assert (detect.patch_filter(inst, changed).count() == 2) == kept
        marks = {(r.file, r.start_line): r.changed for r in detect.changed(inst, changed).collect()}
        assert marks == {(f, s): any(f == g and a <= s and e <= b for g, a, b in ranges) for f, s, e in own}


def test_order_ties_and_single_instances(spark):
    rows = [("a", 1, 1, 5, "x"), ("a", 1, 1, 5, "x"), ("a", 3, 3, 5, "y"), ("b", 3, 3, 5, "y"), ("b", 9, 9, 7, "z"), ("b", 10, 10, 5, "w"), ("b", 11, 11, 5, "w"), ("b", 12, 12, 5, "w")]
    groups = detect.ranked(detect.summarized(detect.detect(frame(spark, rows), 5)))
    assert [bytes(r.hash).decode() for r in groups.orderBy("clone_no").collect()] == ["w", "x", "y"]
    assert detect.detect(frame(spark, rows), 6).count() == 0
    assert detect.ranked(detect.summarized(detect.detect(frame(spark, []), 1))).count() == 0


def test_plans_join_on_the_file_and_never_cross(spark):
    inst = detect.instances(frame(spark, [("a", 1, 1, 5, "x")] * 3))
    plan = detect.subsumption(inst)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_subtrees_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    source = frame(spark, [("a", 1, 1, 5, "x")] * 30).mapInPandas(count, SUBTREES)
    changed = spark.createDataFrame([("a", 1)], CHANGED_LINES)
    out = detect.summarized(detect.detect(source, 3, changed))
    assert out.count() == 1 and made.value == 30
    assert "MapInPandas" not in out._jdf.queryExecution().toString()
