"""Differing parts of lines that stand at the same place of several instances.

Works on the distinct texts at a place, of which there are few, and joins their ranges back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .report import unifiable

#: Shorter common parts don't split a difference.
LEAST_COMMON = 3
Range = tuple[int, int]


def common_part(parts: Sequence[bytes]) -> bytes:
    """The longest string of LEAST_COMMON bytes or more in all parts, the leftmost in the shortest part; empty if there is none.

    If a string is in all parts, so are its own parts: the length is found by bisection.
    """
    shortest = min(parts, key=len)
    others = [p for p in parts if p is not shortest]
    low, high, best = LEAST_COMMON, len(shortest), b""
    while low <= high:
        n = (low + high) // 2
        found = next((s for i in range(len(shortest) - n + 1) if all((s := shortest[i : i + n]) in p for p in others)), None)
        if found is None:
            high = n - 1
        else:
            low, best = n + 1, found
    return best


def split_differences(texts: Sequence[bytes]) -> list[list[Range]]:
    """For each text the byte ranges in which it differs from the others."""
    out: list[list[Range]] = [[] for _ in texts]
    todo = [[(t, 0) for t in texts]]
    while todo:
        segments = todo.pop()
        parts = [t for t, _ in segments]
        n = min(map(len, parts))
        head = next((k for k in range(n) if len({p[k] for p in parts}) > 1), n)
        n -= head
        tail = next((k for k in range(n) if len({p[len(p) - 1 - k] for p in parts}) > 1), n)
        middles = [(t[head : len(t) - tail], at + head) for t, at in segments]
        shared = common_part([m for m, _ in middles])
        if not shared:
            for own, (m, at) in zip(out, middles, strict=True):
                if m:
                    own.append((at, at + len(m)))
            continue
        cuts = [m.index(shared) for m, _ in middles]
        right = [(m[c + len(shared) :], at + c + len(shared)) for (m, at), c in zip(middles, cuts, strict=True)]
        todo += [right, [(m[:c], at) for (m, at), c in zip(middles, cuts, strict=True)]]  # the left one is next
    return out


def instance_ranges(instances: Sequence[Sequence[str]]) -> list[list[list[Range]]]:
    """By instance and line the differing byte ranges; lines are matched by their number among those that aren't blank."""
    if len(instances) < 2:
        return []
    out = [[[] for _ in lines] for lines in instances]
    content = [[k for k, line in enumerate(lines) if line.strip(" \t\n\r\0\x0b")] for lines in instances]
    if len({len(c) for c in content}) > 1:
        return out
    for places in zip(*content, strict=True):
        texts = [lines[k].encode() for lines, k in zip(instances, places, strict=True)]
        if len(set(texts)) > 1:
            for own, k, ranges in zip(out, places, split_differences(texts), strict=True):
                own[k] = ranges
    return out


def diff_ranges(numbered: DataFrame) -> DataFrame:
    """hash, inst, line, ranges ("a-b c-d") for the lines of unifiable groups that differ at their place."""
    rows = numbered.join(unifiable(numbered), "hash", "left_semi").where("idx IS NOT NULL")
    first = rows.groupBy("hash", "idx", "t").agg(F.min("inst").alias("inst"))
    texts = first.groupBy("hash", "idx").agg(F.array_sort(F.collect_list(F.struct("inst", "t"))).alias("x")).where(F.size("x") > 1).select("hash", "idx", F.col("x.t").alias("texts"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for h, idx, ts in zip(batch["hash"], batch["idx"], batch["texts"], strict=True):
                found = split_differences([t.encode() for t in ts])
                out += [(h, idx, t, " ".join(f"{a}-{b}" for a, b in r)) for t, r in zip(ts, found, strict=True)]
            yield pd.DataFrame(out, columns=["hash", "idx", "t", "ranges"])

    ranges = texts.mapInPandas(run, "hash binary, idx long, t string, ranges string")
    return rows.join(ranges, ["hash", "idx", "t"]).select("hash", "inst", "line", "ranges")
