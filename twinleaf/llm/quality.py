"""Quality rules with n-gram perplexity bands (operator 5).

A modified Kneser-Ney model over characters (UTF-16 units, so that no two characters are mixed up), one for each language, is counted by Spark from all
documents: the n-grams of the highest order are counted, and everything else in the model (lower orders'
continuation counts, discounts, back-off weights) follows from that table by joins. All counted strings stay, in
tables dealt out by hash; a text is scored against at most PASS_ENTRIES of them at a time, in as many passes as
the table needs. As every text is counted, none holds an unseen string. One pass's strings are kept in sorted hash
arrays with a slot index for the common case.

Each language's distinct texts give a median and a spread of log-perplexity for each octave of text lengths (means
over long texts scatter less), smoothed over lengths, and documents outside the band around it are rejected: below it
repetitive or templated text, above it noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: Strings that are sent to the workers at a time; more take more passes over the texts.
PASS_ENTRIES = 4_000_000
#: The band, in spreads (a normal distribution's deviation by its quartiles) below and above the median, and the least spread.
BELOW, ABOVE, LEAST_SPREAD = 4.0, 6.0, 0.002
#: The most votes that a language's other lengths have in an octave's band.
VOTES = 100
MIN_WORDS, MAX_REPEAT = 20, 30
WINDOW = 8
_PAD = 2
_STEP = 500  # bins per unit of log-perplexity

# --- the model ---------------------------------------------------------------------------


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code of the ORDER UTF-16 units up to each one (16 bits each, the last lowest), and its row; texts are lower-cased and padded in front."""
    texts = [t.encode("utf-16-le", "surrogatepass") for t in pc.utf8_lower(column.fill_null("")).to_pylist()]
    pad = chr(_PAD).encode("utf-16-le") * (ORDER - 1)
    c = np.frombuffer(b"".join([pad + t for t in texts]), dtype="<u2").astype(np.uint64)
    code = c.copy()
    for k in range(1, ORDER):
        code[k:] |= c[:-k] << np.uint64(16 * k)
    sizes = np.array([len(t) // 2 for t in texts], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(row)) + (row + 1) * (ORDER - 1)
    return code[at], row


class Table:
    """Values by key: sorted hashes, and for most keys a slot that holds them directly."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weight: np.ndarray | None = None):
        h = common.mix(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order].astype(np.float64)
        self.bits = max(4, min(20, int(2 * max(1, len(h))).bit_length()))
        common_last = np.argsort(np.zeros(len(h)) if weight is None else weight[order], kind="stable")
        self.slot = np.zeros(1 << self.bits, dtype=np.int32)
        self.slot[(self.hashes[common_last] >> np.uint64(64 - self.bits)).astype(np.int64)] = common_last

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values and whether there are any."""
        if not len(self.hashes):
            return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        h = common.mix(keys)
        at = self.slot[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        there = self.hashes[at] == h
        other = np.flatnonzero(~there)
        if len(other):
            far = np.minimum(np.searchsorted(self.hashes, h[other]), len(self.hashes) - 1)
            at[other] = far
            there[other] = self.hashes[far] == h[other]
        return self.values[at], there


def language(column: str = "lang"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_grams(docs: DataFrame) -> DataFrame:
    """_l, code and n of every string of ORDER characters in docs (_l, text); written and read again."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            part = part.take(pa.array(np.argsort(part.column("_l").to_numpy(), kind="stable")))
            code, row = grams(part.column("text"))
            names, first = np.unique(part.column("_l").to_numpy(), return_index=True)
            edges = np.searchsorted(row, np.r_[first, part.num_rows])
            for k, name in enumerate(names):
                key, n = np.unique(code[edges[k] : edges[k + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), name)), pa.array(common.signed(key)), pa.array(n)], ["_l", "code", "n"])

    return common.cut(docs.select("_l", "text").mapInArrow(run, "_l long, code long, n long").groupBy("_l", "code").agg(F.sum("n").alias("n")))


def probabilities(counts: DataFrame) -> DataFrame:
    """_l, code, n and p, the interpolated modified Kneser-Ney probability of a string's last character; written and read again."""
    levels = [counts]  # by falling order; below the highest, n counts kinds of left neighbours
    for n in range(ORDER - 1, 0, -1):
        levels.append(common.cut(levels[-1].groupBy("_l", F.col("code").bitwiseAND((1 << 16 * n) - 1).alias("code")).agg(F.count("*").alias("n"))))
    levels.reverse()
    n1, n2, n3, n4 = (F.greatest(F.col(f"n{k}"), F.lit(1)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [F.least(F.greatest(x, F.lit(0.05)), F.lit(most)).alias(f"d{k}") for k, x, most in ((1, 1 - 2 * y * n2 / n1, 0.95), (2, 2 - 3 * y * n3 / n2, 1.9), (3, 3 - 4 * y * n4 / n3, 2.85))]
    kinds = reduce(DataFrame.unionByName, (x.groupBy("_l").agg(F.count("*").alias("all"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).withColumn("order", F.lit(k)) for k, x in enumerate(levels, 1)))
    discounts = common.cut(kinds.select("_l", "order", *d, (1 / (F.col("all") + 1)).alias("unseen")))
    p: DataFrame | None = None
    for n, level in enumerate(levels, 1):
        own = level.withColumn("context", F.shiftrightunsigned("code", 16))
        sums = own.groupBy("_l", "context").agg(F.sum("n").alias("total"), F.expr("count_if(n = 1) AS c1"), F.expr("count_if(n = 2) AS c2"), F.expr("count_if(n >= 3) AS c3"))
        sums = sums.join(discounts.where(F.col("order") == n).drop("order"), "_l").withColumn("left", F.expr("(d1 * c1 + d2 * c2 + d3 * c3) / total")).drop("c1", "c2", "c3")
        own = own.join(sums, ["_l", "context"])
        if p is None:
            own = own.withColumn("lower", F.col("unseen"))
        else:
            own = own.withColumn("suffix", F.col("code").bitwiseAND((1 << 16 * (n - 1)) - 1)).join(p.select("_l", F.col("code").alias("suffix"), F.col("p").alias("lower")), ["_l", "suffix"])
        p = own.select("_l", "code", "n", F.expr("(n - CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / total + left * lower").alias("p"))
    out = common.cut(p)
    common.drop(discounts, *levels[:-1])
    return out


def keyed(code: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """One key for a string and its language's hash."""
    return common.mix(code) + lang.astype(np.int64).view(np.uint64)


def log_table(rows: DataFrame) -> Table:
    """The logarithms of p by keyed(), of one pass's rows."""
    own = rows.select("_l", "code", "n", "p").toArrow()
    code, lang, n, p = (own.column(c).to_numpy() for c in ("code", "_l", "n", "p"))
    return Table(keyed(code.astype(np.int64).view(np.uint64), lang), np.log(p), n)


# --- the base rules ----------------------------------------------------------------------


def base(column: pa.Array) -> dict[str, np.ndarray]:
    data, bounds = common.buffers(column)
    n = len(bounds) - 1
    start, end, row = common.words(data, bounds)
    ranges = common.Ranges(data)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return sums[bounds[1:]] - sums[bounds[:-1]]

    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_text(~common.SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(symbol[data]),
    }
    # lines: they end at \n or at the text's end
    brk = np.flatnonzero(data == 10)
    edges = np.unique(np.r_[bounds, brk + 1])
    lo, hi = edges[:-1], edges[1:]
    hi = hi - (data[hi - 1] == 10) if len(hi) else hi
    filled = np.r_[0, np.cumsum(~common.SPACE[data])]
    some = filled[hi] > filled[lo]
    lo, hi = lo[some], hi[some]
    line_row, line = np.searchsorted(bounds, lo, side="right") - 1, common.identify(data, lo, hi, ranges)
    order = np.lexsort((line, line_row))
    again = (line_row[order][1:] == line_row[order][:-1]) & (line[order][1:] == line[order][:-1])
    out["n_dup_lines"] = np.bincount(line_row[order][1:][again], minlength=n)
    # windows
    word = common.identify(data, start, end, ranges)
    first = np.flatnonzero(row[WINDOW - 1 :] == row[: len(row) - WINDOW + 1]) if len(row) >= WINDOW else np.zeros(0, dtype=np.int64)
    width = 1
    while width < WINDOW:  # numbers for runs of 2, 4 and 8 words
        word = common.pair_up(word[: len(word) - width], word[width:]) if len(word) > width else word[:0]
        width *= 2
    h = word[first]
    order = np.lexsort((h, row[first]))
    same = (row[first][order][1:] == row[first][order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(first), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(row) + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


# --- verdicts ----------------------------------------------------------------------------


def band(cells: dict[int, tuple[np.ndarray, np.ndarray]], octave: int) -> tuple[float, float]:
    """The lowest and highest log-perplexity at an octave, from a language's histograms (bins, counts) by octave.

    The octave's texts have a vote each. The language's others have together VOTES * n / (VOTES + n), where n is their number and
    those of an octave further off count a fourth: they decide where an octave has few texts, and fade out as it gets more.
    """
    near = {o: 4.0 ** -abs(o - octave) for o in cells}
    others = sum(n.sum() * near[o] for o, (_, n) in cells.items() if o != octave)
    bins = np.concatenate([x for x, _ in cells.values()])
    votes = np.concatenate([n * (1.0 if o == octave else near[o] * VOTES / (VOTES + others)) for o, (_, n) in cells.items()])
    order = np.argsort(bins, kind="stable")
    bins, upto = bins[order], np.cumsum(votes[order])
    q1, mid, q3 = (bins[min(np.searchsorted(upto, q * upto[-1]), len(bins) - 1)] / _STEP for q in (0.25, 0.5, 0.75))
    spread = max((q3 - q1) / 1.349, LEAST_SPREAD)
    return mid - BELOW * spread, mid + ABOVE * spread


def bands(scored: DataFrame) -> DataFrame:
    """_l, _octave, _low and _high, from the distinct texts that the base rules pass; written and read again."""
    texts = scored.where("NOT base_failed").select("_l", "_octave", "_text", F.round(F.col("log_perplexity") * _STEP).cast("int").alias("bin")).distinct()
    # a language's histogram has a bounded number of bins, whatever the number of its texts
    bins = texts.groupBy("_l", "_octave", "bin").agg(F.count("*").alias("n"))
    cells = bins.groupBy("_l", "_octave").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns"))
    langs = cells.groupBy("_l").agg(F.collect_list(F.struct("_octave", "bins", "ns")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, own in zip(batch.column("_l").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                by = {c["_octave"]: (np.array(c["bins"]), np.array(c["ns"], dtype=np.float64)) for c in sorted(own, key=lambda c: c["_octave"])}
                out += [(name, o, *map(float, band(by, o))) for o in by]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["_l", "_octave", "_low", "_high"])

    return common.cut(langs.mapInArrow(run, "_l long, _octave int, _low double, _high double"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _totals(part: pa.RecordBatch, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of the logarithms in table, and its characters."""
    code, row = grams(part.column("text"))
    value, there = table.get(keyed(code, part.column("_l").to_numpy()[row]))
    return np.bincount(row, np.where(there, value, 0.0), part.num_rows), np.bincount(row, minlength=part.num_rows)


def first_pass(docs: DataFrame, sent) -> DataFrame:
    """doc_id, _l, _text, COUNTS, base_failed, _octave, _length and total, the sum of the logarithms in the table sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part in common.slices(batches, "text"):
            out = base(part.column("text"))
            total, length = _totals(part, table)
            length = np.maximum(length, 1)
            octave = np.log2(length).astype(np.int32)
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * out["n_words"])
            same = ["doc_id", "_l", "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in same), *(pa.array(out[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(octave), pa.array(length.astype(np.int64)), pa.array(total)], [*same, *COUNTS, "base_failed", "_octave", "_length", "total"])

    schema = "doc_id long, _l long, _text long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, _octave int, _length long, total double"
    return docs.mapInArrow(run, schema)


def next_pass(docs: DataFrame, sent) -> DataFrame:
    """_l, _text and total of every row for another part of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("_l"), part.column("_text"), pa.array(_totals(part, table)[0])], ["_l", "_text", "total"])

    return docs.select("_l", "_text", "text").mapInArrow(run, "_l long, _text long, total double")


def quality(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed, log_perplexity and kept of every row of docs (doc_id, text, lang).

    A null text has no words and fails; every value of lang is a language of its own, null that of the empty string. Repeated rows count and are judged each for itself;
    texts of any length are taken whole, each within one task; other columns are ignored. An empty table gives no row.
    """
    spark = common.ready(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64(language()).alias("_l"), F.xxhash64("text").alias("_text"))
    counted = count_grams(docs)
    model = probabilities(counted)
    common.drop(counted)
    passes = max(1, -(-model.count() // PASS_ENTRIES))
    scored, later = None, []
    for k in range(passes):
        sent = spark.sparkContext.broadcast(log_table(model.where(F.pmod(F.xxhash64("_l", "code"), F.lit(passes)) == k)))
        if k == 0:
            scored = common.cut(first_pass(docs, sent))
        else:  # a text's sum is the same in all its rows
            later.append(common.cut(next_pass(docs, sent).groupBy("_l", "_text").agg(F.max("total").alias("total"))))
        sent.destroy()
    common.drop(model)
    if later:
        sums = common.cut(reduce(DataFrame.unionByName, later).groupBy("_l", "_text").agg(F.sum("total").alias("more")))
        whole = common.cut(scored.join(sums, ["_l", "_text"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).drop("more"))
        common.drop(scored, sums, *later)
        scored = whole
    scored = scored.withColumn("log_perplexity", -F.col("total") / F.col("_length"))
    judged = scored.join(bands(scored), ["_l", "_octave"], "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("_low"), F.col("_high")), F.lit(False))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity")
