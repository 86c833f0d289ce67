"""Toxicity by a linear-chain conditional random field over tokens (operator 9).

Tokens are runs of letters and digits, and a text's tokens in order are one chain, whatever its length. From labelled documents come labelled tokens: a token
of a toxic document is toxic if its word, or a beginning or end of it, is much likelier in toxic documents
than in clean ones. A two-state field (feature weights and transitions) is fitted to these tokens. Forward-backward
gives each token's marginal, and a logistic function of a document's marginals its score.

Chains are worked on in blocks of BLOCK tokens: first each block's transfer matrix, for all blocks at once, then what comes
into each block from before and after it, then the tokens of all blocks at once. The marginals are those of the whole chain.

What is learnt from is bounded by TRAIN_ROWS labelled rows, and for the field by those of them, in the order of their hashes, that
have up to TRAIN_TOKENS tokens together in either class, of up to TRAIN_LONGEST each. What is scored is not bounded. The model depends on the set of
labelled rows only, not on how they are partitioned or on repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 20_000
TRAIN_TOKENS, TRAIN_LONGEST = 300_000, 20_000
BLOCK = 64
KINDS = 5
#: Least toxic documents that a feature is in, and least log-odds for a token to be labelled by it.
SUPPORT, SURE = 4, 2.5
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SLOTS = 1 << 20


@dataclass
class Model:
    """Sorted feature hashes with weights, a bias, start and transition scores, and the score's coefficients."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    start: float
    transition: np.ndarray
    coefficients: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(_SLOTS, dtype=bool)
        self.maybe[(self.features & np.uint64(_SLOTS - 1)).astype(np.int64)] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte (in its row), row and features (n x KINDS) of every token of a text column."""
    data, bounds = common.buffers(column)
    low, low_bounds = common.buffers(pc.utf8_lower(column.fill_null("")))
    if np.array_equal(bounds, low_bounds):  # else a letter's lower case has another length; then only A-Z are lowered
        data = low
    else:
        data = common.LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _LETTER[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges + 1]
    last[edges - 1] |= inside[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    ranges = common.Ranges(data)
    found = np.empty((len(start), KINDS), dtype=np.uint64)
    found[:, 0] = ranges(start, end)
    for k, n in ((1, 4), (2, 5), (3, 6)):
        found[:, k] = common.mix(ranges(start, np.minimum(start + n, end)) + np.uint64(k))
    found[:, 4] = common.mix(ranges(np.maximum(end - 5, start), end) + np.uint64(4))
    return start - bounds[row], end - bounds[row], row, found


def look_up(features: np.ndarray, maybe: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Index of each hash among the sorted features, -1 for none."""
    out = np.full(found.shape, -1, dtype=np.int32)
    hit = maybe[(found & np.uint64(_SLOTS - 1)).astype(np.int64)]
    some = found[hit]
    at = np.minimum(np.searchsorted(features, some), max(len(features) - 1, 0))
    out[hit] = np.where(features[at] == some, at, -1) if len(features) else -1
    return out


def blocks(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block and place of every token, and each block's row; a row's blocks follow one another."""
    at = common.per_row(row, n)
    place = np.arange(len(row)) - at[row]
    per = -(-np.diff(at) // BLOCK)
    first = np.cumsum(per) - per
    return first[row] + place // BLOCK, place % BLOCK, np.repeat(np.arange(n), per)


def _steps(of: np.ndarray) -> list[np.ndarray]:
    """The blocks that are the k-th of their row, for each k from 1 on."""
    first = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, dtype=bool)
    number = np.arange(len(of)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    order = np.argsort(number, kind="stable")
    return np.split(order, np.searchsorted(number[order], np.arange(1, number.max(initial=0) + 1)))[1:]


def forward_backward(emission: np.ndarray, length: np.ndarray, of: np.ndarray, start: float, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 (blocks x places; 0 past a block's length), the odds of the token before by what precedes, and the backward odds."""
    t = np.exp(transition)
    e = np.exp(np.clip(emission, -30, 30))
    n, size = e.shape
    inside = np.arange(size) < length[:, None]
    begin = np.r_[True, of[1:] != of[:-1]] if n else np.zeros(0, dtype=bool)
    came, follows = np.zeros(n), np.ones(n)
    if steps := _steps(of):
        long = np.flatnonzero(np.r_[~begin[1:], False] | ~begin)  # of rows of several blocks
        m = np.zeros((2, 2, n))
        own = np.stack([np.ones(len(long)), np.zeros(len(long)), np.zeros(len(long)), np.ones(len(long))]).reshape(2, 2, -1)
        for k in range(size):
            x, on = e[long, k], inside[long, k]
            new = np.stack([[own[i, 0] * t[0, 0] + own[i, 1] * t[1, 0], (own[i, 0] * t[0, 1] + own[i, 1] * t[1, 1]) * x] for i in (0, 1)])
            if k == 0:  # a row's first token has none before it
                fresh = begin[long]
                new[:, 0, fresh], new[:, 1, fresh] = 1.0, np.exp(start) * x[fresh]
            new /= new[0, 0] + new[0, 1] + new[1, 0] + new[1, 1]
            own = np.where(on, new, own)
        m[:, :, long] = own
        ahead, after = np.stack([np.ones(n), np.zeros(n)]), np.ones((2, n))
        for at in steps:
            v = np.stack([ahead[0, at - 1] * m[0, j, at - 1] + ahead[1, at - 1] * m[1, j, at - 1] for j in (0, 1)])
            ahead[:, at] = v / (v[0] + v[1])
        for at in reversed(steps):
            v = np.stack([m[i, 0, at] * after[0, at] + m[i, 1, at] * after[1, at] for i in (0, 1)])
            after[:, at - 1] = v / (v[0] + v[1])
        came, follows = np.where(begin, 0.0, ahead[1] / ahead[0]), after[1] / after[0]
    before, back = np.empty((size, n)), np.empty((size, n))
    now = came
    for k in range(size):
        before[k] = now
        now = e[:, k] * (t[0, 1] + now * t[1, 1]) / (t[0, 0] + now * t[1, 0])
        if k == 0:
            now = np.where(begin, e[:, 0] * np.exp(start), now)
        back[k] = now  # forward odds for the time being
    forward = back.copy()
    back[size - 1] = follows
    for k in range(size - 2, -1, -1):
        x = e[:, k + 1] * back[k + 1]
        back[k] = np.where(inside[:, k + 1], (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), follows)
    odds = (forward * back).T
    return np.where(inside, odds / (1 + odds), 0.0), before.T, back.T


def linked(length: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Blocks x places: whether there is a token and one of the same row before it."""
    pairs = np.arange(size) < length[:, None]
    pairs[np.r_[True, of[1:] != of[:-1]] if len(of) else [], 0] = False
    return pairs


def pair_marginals(emission: np.ndarray, pairs: np.ndarray, transition: np.ndarray, before: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Expected number of each transition, summed over the chains."""
    t = np.exp(transition)
    x = np.exp(np.clip(emission, -30, 30)) * back
    parts = np.stack([np.full_like(x, t[0, 0]), t[0, 1] * x, t[1, 0] * before, t[1, 1] * before * x])
    return np.where(pairs, parts / parts.sum(axis=0), 0.0).sum(axis=(1, 2)).reshape(2, 2)


def fit_field(idx: np.ndarray, label: np.ndarray, length: np.ndarray, of: np.ndarray, n_features: int, steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Weights, bias, start and transition scores of the field, by Adam on the chains' likelihood. idx: blocks x places x KINDS."""
    size = idx.shape[1]
    inside = np.arange(size) < length[:, None]
    begin = np.r_[True, of[1:] != of[:-1]]
    pairs = linked(length, of, size)
    used = np.where(idx < 0, np.int32(n_features), idx)
    some = np.flatnonzero((idx >= 0).any(axis=2).reshape(-1))  # tokens with features: few
    kinds = used.reshape(-1, KINDS)[some]
    theta = np.zeros(n_features + 7)  # weights, a slot for none, bias, start, transitions
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    label = np.where(inside, label, 0)
    earlier = np.c_[np.r_[0, label[:-1, -1]], label[:, :-1]]
    seen = np.array([[(pairs & (earlier == a) & (label == b)).sum() for b in (0, 1)] for a in (0, 1)])
    total = max(1, inside.sum())
    for step in range(1, steps + 1):
        transition = theta[-4:].reshape(2, 2)
        emission = np.full(inside.size, theta[n_features + 1])
        emission[some] += theta[: n_features + 1][kinds].sum(axis=1)
        emission = emission.reshape(inside.shape)
        p, before, back = forward_backward(emission, length, of, theta[n_features + 2], transition)
        miss = np.where(inside, label - p, 0.0)
        grad = np.zeros_like(theta)
        grad[: n_features + 1] = np.bincount(kinds.reshape(-1), np.repeat(miss.reshape(-1)[some], KINDS), n_features + 1)
        grad[n_features] = 0
        grad[n_features + 1], grad[n_features + 2] = miss.sum(), miss[begin, 0].sum()
        grad[-4:] = (seen - pair_marginals(emission, pairs, transition, before, back)).reshape(-1)
        grad = grad / total * 1e3 - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate / (1 + step / 60) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features].copy(), float(theta[n_features + 1]), float(theta[n_features + 2]), theta[-4:].reshape(2, 2).copy()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(b)) / 100
        b += np.linalg.solve(hess, x.T @ (y - p) - ridge * len(y) * b / 100)
    return b


def measure(model: Model, column: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Three numbers per document from its tokens' marginals, and (start, end, row) of the toxic tokens."""
    start, end, row, found = tokens(column)
    n = len(column)
    block, place, of = blocks(row, n)
    weight = np.append(model.weights, 0.0)[look_up(model.features, model.maybe, found)].sum(axis=1)
    emission = np.zeros((len(of), BLOCK))
    emission[block, place] = weight + model.bias
    p, _, _ = forward_backward(emission, np.bincount(block, minlength=len(of)), of, model.start, model.transition)
    p = p[block, place]
    count = np.bincount(row, minlength=n)
    total = np.bincount(row, p, n)
    most = np.zeros(n)
    np.maximum.at(most, row, p)
    toxic = p > 0.5
    return np.stack([most, np.log1p(total), np.sqrt(total / np.maximum(count, 1))], axis=1), (start[toxic], end[toxic], row[toxic])


def logits(model: Model, x: np.ndarray) -> np.ndarray:
    c = model.coefficients
    return c[0] + x[:, 0] * c[1] + x[:, 1] * c[2] + x[:, 2] * c[3]


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the field on at most TRAIN_ROWS labelled rows that aren't held out; None if they aren't of both kinds.

    Rows that share id and text count once; an id with labels 0 and 1 is toxic, and null ids and other labels are passed over.
    """
    spark = common.ready(docs.sparkSession)
    chosen = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("rank", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "rank"])
    rows = common.cut(rows.select("doc_id", "text", "toxic", "rank"))
    ids = ["rank", "doc_id"]
    if rows.count() > TRAIN_ROWS:  # texts that share an id
        fewer = common.cut(rows.join(F.broadcast(rows.select(*ids).orderBy(*ids).limit(TRAIN_ROWS)), ids, "left_semi"))
        common.drop(rows)
        rows = fewer
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        common.drop(rows)
        return None

    def distinct(batches: Iterator[pa.RecordBatch], among: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            _, _, row, found = tokens(part.column("text"))
            both = found.reshape(-1)
            row = np.repeat(row, KINDS)
            if among is not None:
                hit = np.isin(both, among)
                both, row = both[hit], row[hit]
            order = np.lexsort((row, both))
            both, row = both[order], row[order]
            new = np.ones(len(both), dtype=bool)
            new[1:] = (both[1:] != both[:-1]) | (row[1:] != row[:-1])
            value, n = np.unique(both[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(value)), pa.array(n)], ["feature", "n"])

    def counted(kind: int, among: np.ndarray | None) -> DataFrame:
        return rows.where(f"toxic = {kind}").select("text").mapInArrow(lambda b: distinct(b, among), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    bad = common.cut(counted(1, None).where(f"n >= {SUPPORT}"))
    # the toxic documents' features are of the size of the sample
    feature = np.sort(bad.select("feature").toPandas()["feature"].to_numpy().astype(np.int64).view(np.uint64))
    good = counted(0, feature)
    odds = F.log((F.col("bad") + 0.5) / F.lit(sizes[1] + 1.0)) - F.log((F.coalesce("good", F.lit(0)) + 0.5) / F.lit(sizes[0] + 1.0))
    both = bad.withColumnRenamed("n", "bad").join(good.withColumnRenamed("n", "good"), "feature", "left").select("feature", odds.alias("odds")).where("odds > 0.7").toPandas()
    common.drop(bad)
    feature = both["feature"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(feature)
    feature, sure = feature[order], both["odds"].to_numpy()[order] > SURE
    model = Model(feature, np.zeros(len(feature)), 0.0, 0.0, np.zeros((2, 2)), np.zeros(4))
    sent = spark.sparkContext.broadcast((feature, model.maybe, sure))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, maybe, sure = sent.value
        for part in common.slices(batches, "text"):
            _, _, row, found = tokens(part.column("text"))
            idx = look_up(feature, maybe, found)
            toxic = part.column("toxic").to_numpy()
            label = np.append(sure, False)[idx].any(axis=1) & (toxic[row] == 1)
            at = common.per_row(row, part.num_rows)
            # a toxic document without a toxic token tells nothing sure
            use = np.flatnonzero((np.diff(at) > 0) & ((toxic == 0) | (np.bincount(row, label, part.num_rows) > 0)))
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(use)) for c in ("toxic", "rank", "doc_id")] + [pa.array(np.diff(at)[use]), pa.array([idx[at[i] : at[i + 1]].tobytes() for i in use], pa.binary()), pa.array([label[at[i] : at[i + 1]].tobytes() for i in use], pa.binary())], ["toxic", *ids, "n", "idx", "marks"])

    shown = common.cut(rows.mapInArrow(labelled, "toxic int, rank long, doc_id long, n long, idx binary, marks binary"))
    got = []
    for kind in (1, 0):  # first the sizes in order, then what as many as fit hold
        own = shown.where(f"toxic = {kind} AND n <= {TRAIN_LONGEST}")
        order = sorted((r.rank, r.doc_id, r.n) for r in own.select(*ids, "n").collect())
        fit = int(np.searchsorted(np.cumsum([n for _, _, n in order]), TRAIN_TOKENS, side="right"))
        if fit:
            last = order[fit - 1]
            own = own.where(F.struct(*ids) <= F.struct(F.lit(last[0]).cast("long"), F.lit(last[1]).cast("long")))
            got += sorted(own.collect(), key=lambda r: (r["rank"], r["doc_id"]))
    common.drop(shown)
    if got:
        row = np.repeat(np.arange(len(got)), [r.n for r in got])
        block, place, of = blocks(row, len(got))
        idx, marks = np.full((len(of), BLOCK, KINDS), -1, dtype=np.int32), np.zeros((len(of), BLOCK))
        idx[block, place] = np.frombuffer(b"".join(r.idx for r in got), dtype=np.int32).reshape(-1, KINDS)
        marks[block, place] = np.frombuffer(b"".join(r.marks for r in got), dtype=np.int8)
        model.weights, model.bias, model.start, model.transition = fit_field(idx, marks, np.bincount(block), of, len(feature))
    fitted = spark.sparkContext.broadcast(model)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            x, _ = measure(fitted.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["toxic", "a", "b", "c"])

    table = rows.select("text", "toxic").mapInArrow(numbers, "toxic int, a double, b double, c double").toPandas()
    table = table.sort_values(["toxic", "a", "b", "c"])
    model.coefficients = fit_logistic(table[["a", "b", "c"]].to_numpy(), table["toxic"].to_numpy().astype(float))
    common.drop(rows)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row of docs.

    spans are the toxic tokens' byte ranges. Empty and null texts get the score of a text without tokens. Without a
    model (no labels of both kinds) every score is 0. Repeated rows are scored alike; texts of any length are taken whole, each within
    one task; other columns are ignored, and an empty table gives no row.
    """
    spark = common.ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in common.slices(batches, "text"):
            n = part.num_rows
            if own is None:
                value, spans = np.zeros(n), pa.array([[]] * n, span)
            else:
                x, (start, end, row) = measure(own, part.column("text"))
                value = 1 / (1 + np.exp(-np.clip(logits(own, x), -30, 30)))
                spans = pa.ListArray.from_arrays(pa.array(common.per_row(row, n).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value), spans], ["doc_id", "score", "spans"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns whatever their names; decided row by row, so ids may repeat or be null. An empty table gives no row."""
    spark = common.ready(docs.sparkSession)
    if model is None:
        return docs
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in common.slices(batches, "text"):
            x, _ = measure(own, part.column("text"))
            yield part.filter(pa.array(logits(own, x) < 0))

    return docs.mapInArrow(run, docs.schema)
