"""Approximate nearest neighbours by a hash-prefix forest (operator 2).

Vectors are dealt at random into shards of a bounded size, and queries into blocks; each shard meets each block
in one task. For a shard there are TREES trees, each a sorted array of BITS-bit strings (the sides of
random hyperplanes through the shard's mean). A query descends to its longest matching prefix in every tree, then
ascends in all trees at once, a bit at a time, until the strings that share its prefixes, counted in every tree, number SHARE of the
shard. These candidates are scored exactly; a query's best over all shards are its result.

Equal vectors are one candidate to the search: only their K + 1 least ids can be in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TREES, BITS, SHARE = 48, 32, 0.6
SHARD, BLOCK = 16_384, 4_096
_SEED = 77


class Forest:
    """Sorted arrays of hash strings over the rows of x (unit vectors)."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(axis=0)
        self.planes = np.random.default_rng(_SEED + x.shape[1]).normal(size=(TREES, x.shape[1], BITS))
        hashes = self.strings(x)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """TREES x rows."""
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.stack([((x - self.mean) @ planes > 0) @ weight for planes in self.planes])

    def candidates(self, x: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query row its candidates' rows, sorted."""
        strings = self.strings(x)
        lo, hi = np.empty_like(strings), np.empty_like(strings)
        going = np.arange(len(x))
        for up in range(BITS + 1):  # ascending: prefixes of BITS - up bits
            first = strings[:, going] >> up << up
            for t in range(TREES):
                lo[t, going] = np.searchsorted(self.sorted[t], first[t])
                hi[t, going] = np.searchsorted(self.sorted[t], first[t] + (1 << up))
            going = going[(hi - lo)[:, going].sum(axis=0) < least]
            if not len(going):
                break
        mark = np.zeros(self.order.shape[1], dtype=bool)
        for q in range(len(x)):
            mark[:] = False
            for t in range(TREES):
                mark[self.order[t, lo[t, q] : hi[t, q]]] = True
            yield np.flatnonzero(mark)


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE) -> Iterator[tuple[int, int, float]]:
    """(query id, id, cosine) of each query's k best candidates of other ids; all vectors finite and of a length above 0."""
    norm, query_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    unit = x / norm[:, None]
    forest = Forest(unit)
    wanted = forest.candidates(queries / query_norm[:, None], max(int(share * len(ids)), TREES * min(len(ids), 8 * k)))
    for q, found in enumerate(wanted):
        found = found[ids[found] != query_ids[q]]
        rough = unit[found] @ (queries[q] / query_norm[q])
        if len(found) > k:  # whatever rounding may bring among the best
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
        score = (x[found] * queries[q]).sum(axis=1) / (norm[found] * query_norm[q])
        for i in np.lexsort((ids[found], -score))[:k]:
            yield int(query_ids[q]), int(ids[found[i]]), float(score[i])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v an array of doubles: rows with an id and a vector without null or non-finite components, not all 0."""
    v = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    kept = kept.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return kept.where(F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest cosine found for each row whose vec_id is divisible by every.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components, take no part. A query is
    compared with rows of other ids, and only with vectors as long as its own. Ties go to the smaller id. Of rows
    that share an id the least vector is the query, and a result names an id once, with its best score. Other columns are ignored.
    """
    spark = common.ready(vectors.sparkSession)
    # a vector's least ids; the limit is applied before the shuffle
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = common.cut(usable(vectors).distinct().withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "v"))
    queries = usable(vectors).where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = common.cut(queries)
    shards, blocks = max(1, -(-rows.count() // SHARD)), max(1, -(-queries.count() // BLOCK))

    def dealt(frame: DataFrame, kind: int, own: str, n: int, other: str, m: int) -> DataFrame:
        each = frame.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return each.select("shard", "block", F.lit(kind).alias("kind"), "vec_id", "v")

    both = dealt(rows, 0, "shard", shards, "block", blocks).unionByName(dealt(queries, 1, "block", blocks, "shard", shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            part = pa.Table.from_batches(held)
            cell = np.stack([part.column(c).to_numpy() for c in ("shard", "block")])
            if (cell[:, 0] == cell[:, -1]).all():
                continue
            edges = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges[:-1]], edges, strict=True):
                yield from one(part.slice(lo, hi - lo))
            held = part.slice(edges[-1]).to_batches()
        if held:
            yield from one(pa.Table.from_batches(held))

    def one(part: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, ids = part.column("kind").to_numpy(), part.column("vec_id").to_numpy()
        lists = part.column("v").combine_chunks()
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        at = at - at[0]
        size = np.diff(at)
        out = []
        for n in np.unique(size[kind == 1]):
            rows, own = np.flatnonzero((size == n) & (kind == 0)), np.flatnonzero((size == n) & (kind == 1))
            if len(rows):
                x, q = (flat[at[i][:, None] + np.arange(n)] for i in (rows, own))
                out += best(ids[rows], x, ids[own], q, k)
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    cells = both.repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block")
    found = cells.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
