"""What the operators of this subpackage share: tables, cut lineage, byte-level hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of text that a worker takes up at a time.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch to or from a Python worker: batches of whole texts would else hold tens of MB several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package by the driver's path where that exists (clusters install it), and keeps Arrow batches at most as large as BATCH."""
    for name, most in BATCH.items():
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder, but only if all of Spark runs in this one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'twinleaf-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def unused(name: str, *frames: DataFrame) -> str:
    """name, longer by underscores until none of the frames has such a column (Spark's names ignore case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def drop(*frames: DataFrame) -> None:
    """Deletes frames made by cut() that no later frame reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the id filter, whatever the input's size: half a MB.
FILTER_BITS = 1 << 22


def may_hold(docs: DataFrame, ids: DataFrame, key: str, hit: str) -> DataFrame:
    """docs with a column hit, which docs hasn't got: false only where key isn't among ids.

    ids become a bit array of FILTER_BITS bits, of one size for any input, which is broadcast
    as 128 rows. It fills up with more ids and then spares less, but stays right.
    """
    bucket, bits = unused("_bucket", docs), unused("_bits", docs)
    at = F.pmod(F.col(key), F.lit(FILTER_BITS))
    array = ids.select(at.alias("at")).where("at IS NOT NULL").groupBy(F.expr("bitmap_bucket_number(at)").alias(bucket)).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias(bits))
    spot = F.expr(f"bitmap_bit_position(pmod(`{key}`, {FILTER_BITS}L))")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.expr("1").bitwiseAND(F.call_function("shiftright", byte, F.pmod(spot, F.lit(8)).cast("int"))) == 1, F.lit(False))
    return docs.withColumn(bucket, F.expr(f"bitmap_bucket_number(pmod(`{key}`, {FILTER_BITS}L))")).join(F.broadcast(array), bucket, "left").withColumn(hit, there).drop(bucket, bits)


# --- texts as bytes -------------------------------------------------------------------------

_P = np.uint64((1 << 61) - 1)
_BITS = {n: np.uint64((1 << n) - 1) for n in (29, 30, 31, 32)}
_SHIFT = [np.uint64(n) for n in range(64)]
#: Fixed bases, drawn once at random below 2 ** 61 - 1.
_BASES = (1153742801913360737, 1877309266140420011)
#: Bytes whose powers are kept; longer buffers take up as many at a time.
_BLOCK = 1 << 20
#: Numbers worked on at a time.
_CACHE = 1 << 14
_kept: dict[int, np.ndarray] = {}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2 ** 61 - 1."""
    x = (x & _P) + (x >> _SHIFT[61])
    return x - _P * (x >= _P)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, both below it."""
    a1, a0, b1, b0 = a >> _SHIFT[31], a & _BITS[31], b >> _SHIFT[31], b & _BITS[31]
    mid = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << _SHIFT[1]) + (mid >> _SHIFT[30]) + ((mid & _BITS[30]) << _SHIFT[31]) + a0 * b0)


def powers(base: int) -> np.ndarray:
    """base ** 0 .. _BLOCK - 1 modulo 2 ** 61 - 1."""
    if base not in _kept:
        have = np.ones(_BLOCK, dtype=np.uint64)
        done = 1
        while done < _BLOCK:
            have[done : 2 * done] = times(have[:done], np.uint64(pow(base, done, int(_P))))
            done *= 2
        _kept[base] = have
    return _kept[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def halves(base: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower 32 bits of powers(base) and the bits above them."""
    if -base not in _kept:
        _kept[-base] = np.stack([powers(base) & _BITS[32], powers(base) >> _SHIFT[32]])
    return _kept[-base]


class Ranges:
    """Hashes of any byte range of a buffer: a polynomial in a random base modulo 2 ** 61 - 1.

    Two different strings of at most n bytes agree for at most n of the 2 ** 61 - 2 bases whatever their
    structure; lanes have independent bases, so in both lanes they agree with a chance of (n / 2 ** 61) ** 2.
    """

    def __init__(self, data: np.ndarray, lane: int = 0):
        self.inverse = pow(_BASES[lane], -1, int(_P))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        low, high = halves(_BASES[lane])
        step = pow(_BASES[lane], _BLOCK, int(_P))
        for at in range(0, len(data), _CACHE):
            code = data[at : at + _CACHE].astype(np.uint64)
            code += _SHIFT[1]
            own = slice(at % _BLOCK, at % _BLOCK + len(code))
            upper = np.cumsum(code * high[own])
            total = np.cumsum(code * low[own])
            total += upper >> _SHIFT[29]
            upper &= _BITS[29]
            upper <<= _SHIFT[32]
            total += upper
            if at >= _BLOCK:
                total = times(_reduced(total), np.uint64(pow(step, at // _BLOCK, int(_P))))
            total += self.sums[at]
            self.sums[at + 1 : at + 1 + len(code)] = _reduced(total)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back, blocks = powers(self.inverse), None
        if len(self.sums) > _BLOCK:
            step = pow(self.inverse, _BLOCK, int(_P))
            blocks = np.array([pow(step, k, int(_P)) for k in range((len(self.sums) - 1) // _BLOCK + 1)], dtype=np.uint64)
        out = np.empty(len(start), dtype=np.uint64)
        for at in range(0, len(start), _CACHE):
            s, e = start[at : at + _CACHE], end[at : at + _CACHE]
            scale = back[s] if blocks is None else times(back[s % _BLOCK], blocks[s // _BLOCK])
            x = self.sums[e]
            x += _P
            x -= self.sums[s]
            out[at : at + len(s)] = mix(times(_reduced(x), scale))
        return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[a : a + size] equals data[b : b + size] for all of them."""
    for lo, hi in chunks(np.cumsum(size), SLICE):
        n = size[lo:hi]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(a[lo:hi], n) + within], data[np.repeat(b[lo:hi], n) + within]):
            return False
    return True


def chunks(steps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a rising sum's places that come to most, or to one place."""
    lo = 0
    while lo < len(steps):
        done = steps[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(steps, done + most, side="right")))
        yield lo, hi
        lo = hi


def identify(data: np.ndarray, start: np.ndarray, end: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Numbers from 0 for the byte ranges, equal for equal bytes only: found by hash, decided on the bytes."""
    h, size = ranges(start, end), end - start
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    out = np.empty(len(h), dtype=np.int64)
    if np.array_equal(size[a], size[b]) and same_bytes(data, start[a], start[b], size[a]):
        out[order] = np.cumsum(np.r_[0, ~same]) if len(h) else []
        return out
    raw, known = data.tobytes(), {}
    for i, (lo, hi) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        out[i] = known.setdefault(raw[lo:hi], len(known))
    return out


def pair_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 for pairs of numbers below 2 ** 31, equal for equal pairs only."""
    return np.unique(a << 32 | b, return_inverse=True)[1].astype(np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and the n+1 bounds; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


def give_back() -> None:
    """Hands freed memory back to the system: Python workers outlive a task and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a column's texts come to most bytes, or to one row."""
    yield from _slices(batches, column, most)
    give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, bounds = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word [^\\x20\\x09-\\x0D]+ of the rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges + 1]
    last[edges - 1] |= inside[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    """Bounds (n+1) of each row's run in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
