"""Best-fit packing (operator 3): hierarchical residual packing.

Documents are tokenised and cut into pieces. Groups of pieces are packed best-fit decreasing
on their own; each group emits its bins but for a few, and those few go as items into the
next round, where eight groups meet in one. The last round emits all that is left.

What a group keeps back: after best-fit at most one of its bins is half full or less, and
only such a bin can still go into another. So of a merged group's fan-in of bins that may move, each
needs one host, and the emptiest KEPT_BACK bins of each group, KEPT_BACK not below that number,
offer room wherever any of the group's bins does. A round's tasks thus get a bounded number of bins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe_pieces import byte_characters

GROUP_ROWS = 50_000
FAN_IN = 8
KEPT_BACK = 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", grp long, bin long, offset long, done boolean"


class JsonBpe:
    """The ids that a byte-level BPE .json gives; texts that hold a special token's string go to its own library.

    The vocabulary as ranks gives the same ids if tokens are numbered in the order of their merges, one merge for each: two neighbours at any
    time are what their bytes alone come to by the merges so far, so neighbours that make up a token are those of its own merge. Else all texts go to the library.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        back = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        vocab, merges = model["model"]["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        plain = all(not model["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ranked = plain and made == sorted(set(made)) and all(len(back.keys() & {c}) and len(t) == 1 for t in vocab.keys() - {a + b for a, b in merges} - set(self.special) for c in t)
        self.fast = tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_encoders: dict[tuple[str, str], JsonBpe] = {}


def encoder(path: str, pattern: str) -> JsonBpe:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = JsonBpe(path, pattern)
    return _encoders[path, pattern]


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of the size, the first one maybe shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def pieces(docs: DataFrame, path: str, pattern: str, size: int = 2048, end: int = 0) -> DataFrame:
    """Every document's ids (a null text is empty), then the id end, cut into pieces of at most size ids."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for part in common.slices(batches, "text"):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(own.ids(text or ""), end).astype("<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut_pieces(len(ids), size))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def best_fit(lengths: list[int], size: int) -> list[int]:
    """The bin of each item: best-fit decreasing, ties in the given order."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    there, bins = 0, 0
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := there >> n:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                there &= ~(1 << left)
        else:
            b, left = bins, size
            bins += 1
        out[i] = b
        if left - n:
            room[left - n].append(b)
            there |= 1 << left - n
    return out


def _round(frame: DataFrame, number: int, size: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        got = [b.to_pandas() for b in batches if b.num_rows]
        for grp, rows in pd.concat(got).groupby("grp", sort=True) if got else ():
            rows = rows.sort_values(["bin", "offset", "doc_id", "piece"], kind="stable") if number else rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable")
            # in the first round each piece is an item, later each bin
            item = np.arange(len(rows)) if not number else np.unique(rows["bin"].to_numpy(), return_inverse=True)[1]
            fill = np.bincount(item, rows["length"]).astype(int)
            box = np.array(best_fit(fill.tolist(), size))
            filled = np.bincount(box, fill).astype(int)
            kept = np.zeros(len(filled), dtype=bool)
            if not last:
                kept[np.argsort(filled, kind="stable")[: KEPT_BACK + 1]] = True
                kept &= filled < size
            rows = rows.assign(bin=box[item])
            order = np.lexsort((np.arange(len(rows)), box[item]))
            rows = rows.iloc[order]
            n = rows["length"].to_numpy()
            before = np.cumsum(n) - n
            first = np.r_[True, np.diff(rows["bin"].to_numpy()) != 0]
            rows["offset"] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(rows)]))
            rows["done"] = ~kept[rows["bin"].to_numpy()]
            rows["bin"] += (number << 57) + (int(grp) << 25)
            yield pa.RecordBatch.from_pandas(rows, schema=frame_schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema

    frame_schema = to_arrow_schema(frame.schema)
    return frame.mapInArrow(run, frame.schema)


def pack(items: DataFrame, size: int = 2048) -> DataFrame:
    """Places pieces (PIECE) in sequences of at most size ids: adds sequence_id and offset.

    Every row is placed once, repeated rows too; lengths are 1 to size. An empty table gives no row.
    """
    spark = common.ready(items.sparkSession)
    items = common.cut(items)
    groups = max(1, -(-items.count() // GROUP_ROWS))
    # by a row's number in the table just written, so that rows of equal or null ids are spread like others
    number = F.monotonically_increasing_id()
    frame = items.withColumns({"grp": F.pmod(number + F.shiftright(number, 33), F.lit(groups)).cast("long"), "bin": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "done": F.lit(False)}).select(*(x.split()[0] for x in PLACED.split(", ")))
    out, number = [], 0
    while True:
        rounded = common.cut(_round(frame.repartition(groups, "grp"), number, size, groups == 1))
        out.append(rounded.where("done"))
        if groups == 1:
            break
        groups, number = -(-groups // FAN_IN), number + 1
        frame = rounded.where("NOT done").withColumn("grp", F.expr(f"grp div {FAN_IN}"))
    common.drop(items)
    placed = out[0]
    for more in out[1:]:
        placed = placed.unionByName(more)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, pattern: str, size: int = 2048) -> DataFrame:
    """Tokenises, cuts and packs all documents: PIECE with sequence_id and offset.

    Every row of docs counts as a document, whatever its id, repeated rows too; a null text is empty and still has its end id. Texts of
    any length are taken whole, each within one task. Other columns are ignored, and an empty table gives no row.
    """
    return pack(pieces(docs, path, pattern, size), size)
