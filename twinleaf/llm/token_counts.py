"""Token counts by rank-synchronous array merging (operator 8).

A sentencepiece BPE vocabulary with byte fallback and identity normalisation. Texts are cut into
units that no piece can straddle; the units not yet known are held together as ragged numpy
arrays of symbols. In each round every unit merges its own pair of lowest rank, all units
at once, until no pair is left; the symbols that survive are the tokens. Units of more than LONG characters, of which a
round would touch all symbols for each merge, take their merges from a heap, in the same order.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Characters of the units that a worker remembers before it starts anew, and of the longest unit that it remembers or merges together with others.
REMEMBERED, LONG = 4_000_000, 256
NONE = np.iinfo(np.int64).max
_SPACE = "▁"
_UNITS = re.compile(r" +[^ \n]*|\n[^ \n]*")


class RankMerger:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{_SPACE}]{_SPACE}|\n| ", p) for p in self.ids):
            raise ValueError("a piece goes on past a space or line end")
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        #: Whether no piece ranks before a piece that it is merged from; else equal pairs merge one by one.
        self.ordered = True
        for piece, whole in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = whole
                    if len(piece) > 2 and rank[whole] < max(rank[a] if k > 1 else -1, rank[b] if len(piece) - k > 1 else -1):
                        self.ordered = False
        keys = sorted(pairs)
        self.keys = np.array(keys, dtype=np.int64)
        self.merged = np.array([pairs[k] for k in keys], dtype=np.int64)
        self.rank = np.array([rank[pairs[k]] for k in keys], dtype=np.int64)
        self.order = order
        self.known: dict[str, int] = {}
        self.size = 0

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pair stands in keys, or -1. Unknown characters are below 0 and never merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def merge(self, units: list[str]) -> np.ndarray:
        """The number of tokens of each unit; spaces are already U+2581."""
        out = np.zeros(len(units), dtype=np.int64)
        text = "".join(units)
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        symbol = np.array([self.ids.get(c, -len(c.encode())) for c in text], dtype=np.int64)
        unit = np.repeat(np.arange(len(units)), lengths)
        pair = np.full(len(symbol), -1, dtype=np.int64)
        fresh = np.arange(len(symbol))
        while len(symbol):
            fresh = fresh[fresh < len(symbol) - 1]
            same = unit[fresh] == unit[fresh + 1]
            pair[fresh] = np.where(same, self.look_up(symbol[fresh], symbol[fresh + 1]), -1)
            pair[-1] = -1
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[start, len(unit)])
            least = np.repeat(np.minimum.reduceat(rank, start), sizes)
            over = least == NONE
            if over.any():  # these units are done
                out += np.bincount(unit[over], np.where(symbol[over] < 0, -symbol[over], 1), len(units)).astype(np.int64)
                symbol, unit, pair, rank, least = symbol[~over], unit[~over], pair[~over], rank[~over], least[~over]
                if not len(symbol):
                    break
            hit = rank == least
            if not self.ordered:
                at = np.flatnonzero(hit)
                hit[:] = False
                hit[at[np.r_[True, unit[at][1:] != unit[at][:-1]]]] = True
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # of neighbouring pairs every second one
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbol[at] = self.merged[pair[at]]
            stays = np.ones(len(symbol), dtype=bool)
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            fresh = np.unique(np.r_[place[at], np.maximum(place[at] - 1, 0)])
            symbol, unit, pair = symbol[stays], unit[stays], pair[stays]
        return out

    def merge_long(self, unit: str) -> int:
        """merge() of one unit, in time that grows little faster than its length."""
        symbol = np.array([self.ids.get(c, -len(c.encode())) for c in unit], dtype=np.int64)
        n = len(symbol)
        pair = self.look_up(symbol[:-1], symbol[1:])
        rank = np.where(pair >= 0, self.rank[pair], -1)
        heap = (rank << 32 | np.arange(n - 1))[rank >= 0].tolist()
        heapq.heapify(heap)
        own, now, after, before = symbol.tolist(), [*rank.tolist(), -1], list(range(1, n + 1)), list(range(-1, n - 1))
        if not hasattr(self, "by_pair"):
            self.by_pair = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))
        dead = bytearray(n)
        while heap:
            top = heapq.heappop(heap)
            at = top & 0xFFFFFFFF
            if dead[at] or now[at] != top >> 32:
                continue
            own[at] = self.order[top >> 32]
            gone = after[at]
            dead[gone] = 1
            after[at] = right = after[gone]
            if right < n:
                before[right] = at
            for left in (before[at], at):
                right = after[left] if left >= 0 else n
                if left < 0:
                    continue
                now[left] = -1
                if right < n and own[left] >= 0 and own[right] >= 0 and (found := self.by_pair.get(own[left] << 32 | own[right])) is not None:
                    now[left] = found
                    heapq.heappush(heap, found << 32 | left)
        return sum([max(-x, 1) if x < 0 else 1 for x, d in zip(own, dead, strict=True) if not d])

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without begin or end; an empty text has none."""
        found = [_UNITS.findall(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        new = {u for us in found for u in us if u not in self.known}
        long = {u: self.merge_long(u.replace(" ", _SPACE)) for u in new if len(u) > LONG}
        new = [u for u in new if u not in long]
        self.known.update(zip(new, self.merge([u.replace(" ", _SPACE) for u in new]).tolist(), strict=True))
        self.size += sum(map(len, new))
        return [sum([long[u] if u in long else self.known[u] for u in us]) if long else sum(map(self.known.__getitem__, us)) for us in found]


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null or empty text has 0 bytes and 0 tokens. Every row of docs gives one row, repeated
    ids included; other columns are ignored, and an empty table gives no row. Texts of any length are taken whole, each within
    one task; runs without a space take little longer than their length.
    """
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for part in common.slices(batches, "text"):
            _, bounds = common.buffers(part.column("text"))
            n = np.array(own.count([t or "" for t in part.column("text").to_pylist()]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
