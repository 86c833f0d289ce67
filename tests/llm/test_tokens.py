import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from twinleaf.llm import bpe_pieces, packing, token_counts

ODD = ["", " ", "  a  ", "a  b\n<s> x▁y\tz\0q", "▁▁ a", "aaaaaaaaaaaaaaaaa" * 30, "don't we'll\r\n\r\n  x", "ﬁ① é é 梦想", "<|endoftext|> a<|endoftext|>", "1234567 89", "é" * 301, "\n\n\n  \n", "x" * 5000, "a b　c 😀😀"]


def texts(n=150):
    rng = random.Random(5)
    some = ["the", "ing", "schl", "éau", "ción", " ", "  ", "\n", "=", "0x1f", "ABC", "▁", "😀", "\t", "'s", "."]
    return ODD + ["".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_pieces_match_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ts = texts()
    df = frame(spark, [(i, t, "x") for i, t in enumerate(ts)] + [(9999, None, None)])
    got = {r[0]: r[1:] for r in bpe_pieces.round_trip(df, path, P.PATTERN).collect()}
    for i, t in [*enumerate(ts), (9999, "")]:
        ids = own.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), t
    assert bpe_pieces.round_trip(frame(spark, []), path, P.PATTERN).count() == 0
    codec = bpe_pieces.codec(path, P.PATTERN)
    assert codec.decode(codec.encode("naïve 梦\n")) == "naïve 梦\n".encode()


def test_every_token_is_reached_or_stands_whole():
    codec = bpe_pieces.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(codec.whole[t] == i for i, t in enumerate(codec.tokens))
    assert codec.model.vocab_size() == len(codec.tokens) + 1


def test_counts_match_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    ts = texts()
    df = frame(spark, [(i, t, "x") for i, t in enumerate(ts)] + [(9999, None, None), (0, "again", None)])
    got = sorted(map(tuple, token_counts.count_tokens(df, path, 100).collect()))
    want = sorted((i, len(t.encode()), len(own.encode(t)), len(own.encode(t)) > 100) for i, t in [*enumerate(ts), (9999, ""), (0, "again")])
    assert got == want
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_counts_without_ordered_ranks():
    own = token_counts.RankMerger(P.path("piece_bpe_32k.model"))
    units = ["▁" + t.replace(" ", "") for t in texts(40) if t.strip() and "\n" not in t and len(t) < 400]
    together = own.merge(units)
    own.ordered = False
    assert (own.merge(units) == together).all()


def test_long_runs_match_the_libraries(spark):
    import sentencepiece
    import tiktoken

    rng = random.Random(6)
    letters = "".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(300_000))
    long = [letters, "a" * 100_000, "é☃" * 20_000, " ".join([letters[:9000]] * 5), letters * 7]
    path = P.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    df = frame(spark, [(i, t, "x") for i, t in enumerate(long)])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()}
    assert got == {i: len(own.encode(t)) for i, t in enumerate(long)} and len(long[-1]) > 2_000_000
    merger = token_counts.merger(path)
    units = ["▁" + t.replace(" ", "") for t in texts(40) if t.strip() and "\n" not in t and len(t) < 400]
    assert [merger.merge_long(u) for u in units] == merger.merge(units).tolist()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_pieces.round_trip(df, path, P.PATTERN).collect()}
    for i, t in enumerate(long[:-1]):
        ids = own.encode_ordinary(t)
        assert got[i][1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_memories_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 1000)
    monkeypatch.setattr(bpe_pieces, "REMEMBERED", 1000)
    merger = token_counts.RankMerger(P.path("piece_bpe_32k.model"))
    codec = bpe_pieces.PieceCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for k in range(30):
        merger.count([" ".join(f"{k}x{j}" for j in range(50)) + " " + "y" * 5000])
        list(codec.digests([" ".join(f"k{k}x{j}" for j in range(50)) + " " + "y" * 5000]))
    assert sum(map(len, merger.known)) < 2000 and sum(map(len, codec.known)) < 2000


def test_ranks_stand_for_the_merges():
    own = packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert own.fast is not None
    for token, i in own.own.get_vocab().items():
        if token not in own.special:
            assert [t.id for t in own.own.model.tokenize(token)] == [i]


@pytest.mark.parametrize("n,cuts", [(0, []), (1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cuts(n, cuts):
    assert packing.cut_pieces(n, 8) == cuts


def test_pieces_match_tokenizers(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    ts = texts()
    df = frame(spark, [(i, t, "x") for i, t in enumerate(ts)] + [(9999, None, None)])
    got = sorted(map(tuple, packing.pieces(df, path, P.PATTERN, 64).collect()))
    want = []
    for i, t in [*enumerate(ts), (9999, "")]:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut_pieces(len(ids), 64))]
    assert got == sorted(want)


@pytest.mark.parametrize("rows", [700, 40])
def test_packing_is_tight(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "GROUP_ROWS", 30)
    rng = random.Random(3)
    lengths = [rng.choice([64, rng.randrange(1, 20), rng.randrange(20, 64)]) for _ in range(rows)]
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE)
    got = packing.pack(df, 64).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 64
    whole = len(set(packing.best_fit(lengths, 64)))
    assert len(bins) <= whole * 1.03 + 1


def least_bins(lengths, size):
    """The least number of bins, by dynamic programming over subsets."""
    best = [(0, 0)] + [(99, 0)] * ((1 << len(lengths)) - 1)
    for chosen in range(1 << len(lengths)):
        bins, fill = best[chosen]
        for i, n in enumerate(lengths):
            if not chosen >> i & 1:
                new = (bins, fill + n) if bins and fill + n <= size else (bins + 1, n)
                best[chosen | 1 << i] = min(best[chosen | 1 << i], new)
    return best[-1][0]


def test_packing_is_near_the_least(spark):
    rng = random.Random(8)
    over = 0
    for _ in range(150):
        lengths = [rng.choice([rng.randrange(1, 41), rng.randrange(10, 30)]) for _ in range(rng.randrange(1, 10))]
        used, least = len(set(packing.best_fit(lengths, 40))), least_bins(lengths, 40)
        assert least <= used <= least + 1
        over += used - least
    assert over <= 15


def test_rows_of_equal_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    df = spark.createDataFrame([(None if i % 2 else 7, 0, 0, 5, 1) for i in range(1000)], packing.PIECE)
    sizes = []
    plain = packing._round
    monkeypatch.setattr(packing, "_round", lambda frame, *a: sizes.extend(r[1] for r in frame.groupBy("grp").count().collect()) or plain(frame, *a))
    got = packing.pack(df, 64).collect()
    assert len(got) == 1000 and len({r.sequence_id for r in got}) <= 90 and max(sizes[:10]) < 150


def test_packing_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, 7)] * 4, packing.PIECE)
    got = packing.pack(df, 10).collect()
    assert len(got) == 4 and sorted((r.sequence_id, r.offset) for r in got)[0][1] == 0 and len({r.sequence_id for r in got}) == 2
    assert packing.pack(df.limit(0), 10).count() == 0
