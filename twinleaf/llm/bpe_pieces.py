"""Byte-level BPE encoding and decoding (operator 7).

The ranks of a byte-level vocabulary are serialised straight into a sentencepiece BPE model:
every token becomes a piece whose bytes are mapped one to one to printable characters, scored
by its negative rank, under identity normalisation. Pre-tokens are encoded with that model;
ids are decoded by looking up their pieces and inverting the byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Characters of the pre-tokens that a worker remembers before it starts anew, and of the longest one that it remembers.
REMEMBERED, LONG = 2_000_000, 256


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where it is one, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in found:
            found[b] = chr(spare)
            spare += 1
    return [found[b] for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by rank; ranks have to be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("the ranks have gaps")
    return tokens


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file: piece i is token i, scored -i; after them one unknown piece."""
    to = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(to[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # model_type BPE; the unknown id is the only special one
    out += _field(2, _field(3, 2) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    # no dummy prefix, no white space removed or escaped
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class PieceCodec:
    """Encodes texts to ids and ids to bytes by the serialised model."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = load_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.findall = regex.compile(pattern).findall
        to = byte_characters()
        self.forward = {b: c for b, c in enumerate(to)}
        self.back = {ord(c): b for b, c in enumerate(to)}
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.size = 0

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """A pre-token that is a token stands whole; all others are merged by the model."""
        raw = [p.encode() for p in pretokens]
        ids = self.model.encode([x.decode("latin-1").translate(self.forward) for x in raw], out_type=int, num_threads=1)
        return [[self.whole[x]] if x in self.whole else found for x, found in zip(raw, ids, strict=True)]

    def encode(self, text: str) -> list[int]:
        pretokens = self.findall(text)
        return [i for ids in self.encode_pretokens(pretokens) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        """The ids' pieces, each character turned back into its byte."""
        return "".join(self.model.id_to_piece(list(ids))).translate(self.back).encode("latin-1")

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, the digest of the ids and the digest of what they decode to."""
        found = [self.findall(t) for t in texts]
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        new = list({p for ps in found for p in ps if p not in self.known})
        long = {}
        for p, ids in zip(new, self.encode_pretokens(new), strict=True):
            (self.known if len(p) <= LONG else long)[p] = len(ids), ",".join(map(str, ids)), self.decode(ids)
            self.size += len(p) if len(p) <= LONG else 0
        for ps in found:
            parts = [long[p] if p in long else self.known[p] for p in ps] if long else [self.known[p] for p in ps]
            ids = hashlib.sha256(",".join([x[1] for x in parts]).encode()).hexdigest()
            decoded = hashlib.sha256(b"".join([x[2] for x in parts])).hexdigest()
            yield sum([x[0] for x in parts]), ids, decoded


_codecs: dict[tuple[str, str], PieceCodec] = {}


def codec(path: str, pattern: str) -> PieceCodec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = PieceCodec(path, pattern)
    return _codecs[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    A null or empty text has 0 tokens and the digests of nothing. Every row of docs gives one
    row, repeated ids included; other columns are ignored, and an empty table gives no row. Texts of any length are taken whole, each within one task.
    """
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in common.slices(batches, "text"):
            rows = list(own.digests([t or "" for t in part.column("text").to_pylist()]))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
