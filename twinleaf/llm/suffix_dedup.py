"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 1).

Suffixes are told apart only through their first `depth` bytes, most significant digit first,
and a pass looks only at suffixes that share all digits so far with another one.

The first digit of a suffix is its anchor: of the SEED-byte strings within its first depth bytes
the one of least hash, and where it lies. Neighbouring suffixes mostly have the same anchor, so
a pass handles runs of them as one row: a key of what the run's suffixes have in common beyond doubt (its core), and a key of
all bytes that they cover. Runs whose core is found nowhere else are done: their suffixes are unique.
Runs that agree in all their bytes are done too: all of them repeat. One run of each kind that is
left goes into the next pass, split into narrower runs by place relative to the anchor, until in the last pass
a run is one suffix, its core is all depth bytes, and equal groups are exactly the repeated windows.

Strings are equal where two polynomials over all their bytes modulo 2 ** 61 - 1, in independent random bases, agree.
Different strings of up to 400 bytes do so with a chance below 10 ** -31, whatever their structure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 32
#: Runs per pass: whole runs of one anchor, then this many suffixes, then single ones.
WIDTHS = (12, 1)
#: Bytes of text worked on at a time, for the memory that hashes and their temporaries take.
SLICE = common.SLICE // 4
#: core, full and twin (full's second lane) are keys; rel is the first suffix's place relative to the anchor, negative or 0.
RUNS = "core long, full long, twin long, doc long, start long, n int, rel int"
KIND = ["core", "full", "twin"]


def seeds(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on: its 64-bit words, mixed one after another."""
    words = np.empty(max(len(data) - 7, 0), dtype=np.uint64)
    for k in range(8):
        own = data[k : k + (len(data) - k) // 8 * 8].view("<u8")
        words[k::8] = own[: len(words[k::8])]
    size = len(data) - SEED + 1
    h = words[:size].copy()
    for at in range(8, SEED, 8):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[at : at + size]
    return common.mix(h)


def anchors(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First suffix, number of suffixes, anchor and the anchor's hash of every run, from rows of at least depth bytes."""
    if len(data) < depth:
        return (*(np.zeros(0, dtype=np.int64),) * 3, np.zeros(0, dtype=np.uint64))
    h = seeds(data)
    span = depth - SEED + 1
    least, width = h.copy(), 1
    while width * 2 <= span:
        least[: len(least) - width] = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = span - width
    windows = len(data) - depth + 1
    low = np.minimum(least[:windows], least[rest : rest + windows])
    # the leftmost place at or after the window's start that holds the window's least hash
    place = _first_at_or_after(h, low)
    inside = np.zeros(windows, dtype=bool)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        inside[lo : max(lo, hi - depth + 1)] = True
    start = np.flatnonzero(inside)
    place = place[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (np.diff(start) != 1) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return start[first], np.diff(np.r_[first, len(start)]), place[first], h[place[first]]


def _first_at_or_after(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each i the first j >= i with h[j] == low[i]; low[i] is the least of h from i on for some way."""
    n = len(low)
    # windows of equal least form stretches; in each the places with that hash are few
    new = np.ones(n, dtype=bool)
    new[1:] = low[1:] != low[:-1]
    stretch = np.cumsum(new) - 1
    lows = low[new]
    ends = np.r_[np.flatnonzero(new)[1:], n]
    out = np.full(n, -1, dtype=np.int64)
    hit = h[:n] == low  # the least lies at the window's own start
    own = np.where(hit, np.arange(n), n + len(h))
    back = np.minimum.accumulate(own[::-1])[::-1]
    # usable only if still within the same stretch
    ok = (back < n) & (stretch[np.minimum(back, n - 1)] == stretch)
    out[ok] = back[ok]
    left = np.flatnonzero(~ok)
    if len(left):  # the place lies past the stretch's last window start: the same for all of the stretch's tail
        tail = np.unique(stretch[left])
        last = ends[tail] - 1
        found = np.full(len(lows), -1, dtype=np.int64)
        going, j = np.arange(len(tail)), last.copy()
        while len(going):
            j[going] += 1
            going = going[h[j[going]] != lows[tail[going]]]
        found[tail] = j
        out[left] = found[stretch[left]]
    return out


def first_runs(docs: DataFrame, depth: int) -> DataFrame:
    """RUNS of all suffixes that have depth bytes; doc is the row's key _row."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE):
            data, bounds = common.buffers(part.column("text"))
            start, n, place, core = anchors(data, bounds, depth)
            row = np.searchsorted(bounds, start, side="right") - 1
            rel = start - place
            lanes = [_full(common.Ranges(data, k), start, n, rel, depth) for k in (0, 1)]
            yield _batch(core, *lanes, part.column("_row").to_numpy()[row], start - bounds[row], n, rel)

    return docs.select("_row", "text").mapInArrow(run, RUNS)


def _full(ranges: common.Ranges, start: np.ndarray, n: np.ndarray, rel: np.ndarray, depth: int) -> np.ndarray:
    return common.mix(ranges(start, start + n - 1 + depth) ^ common.mix((n.astype(np.int64) << 32 | (rel.astype(np.int64) & 0xFFFFFFFF)).view(np.uint64)))


def _batch(core, full, twin, doc, start, n, rel) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(common.signed(x)) for x in (core, full, twin)), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)), pa.array(rel.astype(np.int32))], [*KIND, "doc", "start", "n", "rel"])


def split_runs(docs: DataFrame, depth: int, width: int) -> DataFrame:
    """RUNS of at most width suffixes from the runs in docs' column runs; blocks start at multiples of width from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE):
            data, bounds = common.buffers(part.column("text"))
            ranges, other = common.Ranges(data), common.Ranges(data, 1)
            lists = part.column("runs")
            own = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            above, start, n, rel = (own.field(c).to_numpy().astype(np.int64) for c in ("core", "start", "n", "rel"))
            block = rel // width
            blocks = (rel + n - 1) // width - block + 1
            i = np.repeat(np.arange(len(rel)), blocks)
            block = block[i] + np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            lo, hi = np.maximum(block * width, rel[i]), np.minimum(block * width + width, rel[i] + n[i])
            s = bounds[row[i]] + start[i] + lo - rel[i]
            # common to all suffixes of a block, wherever its runs begin and end
            anchor = s - lo
            core = common.mix(ranges(anchor + block * width + width - 1, anchor + block * width + depth) ^ common.mix(above[i].view(np.uint64) + block.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            yield _batch(core, *(_full(x, s, hi - lo, lo, depth) for x in (ranges, other)), part.column("_row").to_numpy()[row[i]], s - bounds[row[i]], hi - lo, lo)

    return docs.select("_row", "text", "runs").mapInArrow(run, RUNS)


def repeated_spans(docs: DataFrame, depth: int) -> DataFrame:
    """(doc, lo, hi): byte spans of each row of docs (_row, text) whose windows of depth bytes also start elsewhere. They may overlap."""
    found, runs = [], common.cut(first_runs(docs, depth))
    for width in (*WIDTHS, None):
        # written first: a join of two shuffled sides, of which Spark can split a hot core's
        shared = common.cut(runs.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"))
        live = common.cut(runs.join(shared, "core", "left_semi"))
        common.drop(runs, shared)
        kinds = common.cut(live.groupBy(*KIND).agg(F.count("*").alias("c"), F.min(F.struct("doc", "start", "n", "rel")).alias("first")))
        found.append(common.cut(live.join(kinds.where("c > 1").select(*KIND), KIND, "left_semi").select("doc", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + depth).alias("hi"))))
        common.drop(live)
        if width is None:
            common.drop(kinds)
            break
        several = common.cut(kinds.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core"))
        nxt = kinds.join(several, "core", "left_semi").select("core", "first.*")
        per_doc = common.cut(nxt.groupBy(F.col("doc").alias("_row")).agg(F.collect_list(F.struct("core", "start", "n", "rel")).alias("runs")))
        texts = common.may_hold(docs, per_doc, "_row", "_hit").where("_hit").select("_row", "text")
        runs = common.cut(split_runs(texts.join(per_doc, "_row"), depth, width))
        common.drop(kinds, several, per_doc)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover; touching ones are one."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > top[:-1]
    first = np.flatnonzero(new)
    return lo[first], top[np.r_[first[1:] - 1, len(lo) - 1]] if len(lo) else top


def dedup_substrings(docs: DataFrame, depth: int = 200, with_text: bool = False) -> DataFrame:
    """Removes every byte covered by a string of depth UTF-8 bytes that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the
    remaining bytes, with_text also kept (binary: a cut may fall inside a character). Strings never run from one text into
    another and are judged on the input. A null text is empty; a text shorter than depth loses nothing. Each row of docs is a
    text of its own, so of rows with equal ids each gets its row, and long repeated rows remove one another. Texts of any
    length are taken whole, each within one task, in a few dozen bytes of memory for each of its bytes. Other columns are ignored; an empty table gives no row.
    """
    common.ready(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    # the row's key: its id where ids are distinct, else a number dealt out once and kept
    distinct = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL").isEmpty()
    docs = docs.withColumn("_row", F.col("doc_id").cast("long")) if distinct else common.cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    spans = repeated_spans(docs, depth)
    per_row = common.cut(spans.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).withColumnRenamed("doc", "_row"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", SLICE):
            data, bounds = common.buffers(part.column("text"))
            rows = []
            for k, (doc, spans) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("spans"), strict=True)):
                own = data[bounds[k] : bounds[k + 1]]
                removed = n = 0
                left = own.tobytes()
                if spans.is_valid and len(spans.values):
                    lo, hi = merged(*(spans.values.field(c).to_numpy() for c in ("lo", "hi")))
                    removed, n = int((hi - lo).sum()), len(lo)
                    edges = [0, *np.stack([lo, hi], axis=1).reshape(-1).tolist(), len(left)]
                    left = b"".join([left[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                rows.append((doc, len(own), removed, n, hashlib.sha256(left).hexdigest(), *[left] * with_text))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)])

    split = common.may_hold(docs, per_row, "_row", "_hit")
    hit = split.where("_hit").join(per_row, "_row", "left").select("doc_id", "text", "spans")
    rest = split.where("NOT _hit").select("doc_id", "text", F.lit(None).cast(hit.schema["spans"].dataType).alias("spans"))
    return hit.unionByName(rest).mapInArrow(run, schema)
