import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa

from twinleaf.llm import toxicity


def corpus(n=700):
    rng = random.Random(4)
    plain = [a + b for a in ("the", "sta", "ren", "öl", "qua", "mi") for b in ("ti", "no", "ra", "é", "sh", "pe")]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = [rng.choice(plain) for _ in range(rng.choice([5, 40, 150]))]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["Clown", "clown,", "vequ" + rng.choice(["ta", "no", "lle"])]))
        rows.append((i, " ".join(w) + rng.choice([".", "\n", ""])))
        if i % 10 != 9:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in [*rows, (9001, None), (9002, ""), (None, "clown"), (0, "clown vequta clown")]], "doc_id long, text string, toxic int")
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in range(len(rows)):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and 0 < r.doc_id < 9000]
    assert len(held) > 80 and sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.98 * len(held)
    assert by[9001].score == by[9002].score < 0.5
    text = dict(rows)[6].encode()
    assert {text[s.start : s.end].decode()[:4].lower() for s in by[6].spans} <= {"clow", "vequ"} and by[6].spans
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in got)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a clown")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None
    assert toxicity.score(docs, None).first().score == 0
    assert toxicity.score(docs.limit(0), None).count() == 0 and toxicity.drop_toxic(docs, None).count() == 1


def test_marginals_of_whole_chains_by_enumeration():
    rng = np.random.default_rng(3)
    t, start = rng.normal(size=(2, 2)), 0.4
    for size in (3, 10):  # chains cut into blocks, or in one
        lengths = [6, 4, 9, 1, 3]
        row = np.repeat(np.arange(5), lengths)
        place = np.concatenate([np.arange(n) for n in lengths])
        e = rng.normal(size=len(row))
        per = [-(-n // size) for n in lengths]
        first = np.cumsum(per) - per
        block, at, of = first[row] + place // size, place % size, np.repeat(np.arange(5), per)
        emission = np.full((len(of), size), 7.0)
        emission[block, at] = e
        length = np.bincount(block)
        p, before, back = toxicity.forward_backward(emission, length, of, start, t)
        pairs = toxicity.pair_marginals(emission, toxicity.linked(length, of, size), t, before, back)
        want_pairs = np.zeros((2, 2))
        for r, n in enumerate(lengths):
            own = e[row == r]
            weights = {}
            for ys in itertools.product((0, 1), repeat=n):
                weights[ys] = math.exp(start * ys[0] + sum(own[k] * y for k, y in enumerate(ys)) + sum(t[a, b] for a, b in zip(ys, ys[1:])))
            z = sum(weights.values())
            got = p[block, at][row == r]
            assert np.allclose(got, [sum(w for ys, w in weights.items() if ys[k]) / z for k in range(n)], atol=1e-9)
            for ys, w in weights.items():
                for a, b in zip(ys, ys[1:]):
                    want_pairs[a, b] += w / z
        assert np.allclose(pairs, want_pairs)


def scores(docs, labels):
    return {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}


def test_scores_by_hand_under_any_partitioning_and_with_repeated_rows(spark):
    rows, labels = corpus(300)
    rows.append((5000, "clown " + "staen " * 40_000 + "vequta"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.repartition(3), table)
    first = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert first == scores(docs.repartition(7).unionByName(docs.where("doc_id < 40")), table.repartition(5).union(table))
    # each score from its definition: one walk over the whole chain
    t = np.exp(model.transition)
    for i, text in [*rows[:25], rows[-1]]:
        _, _, _, found = toxicity.tokens(pa.array([text]))
        e = np.exp(np.append(model.weights, 0.0)[toxicity.look_up(model.features, model.maybe, found)].sum(axis=1) + model.bias)
        ahead, back = np.empty(len(e)), np.ones(len(e))
        for k in range(len(e)):
            ahead[k] = e[k] * (math.exp(model.start) if k == 0 else (t[0, 1] + ahead[k - 1] * t[1, 1]) / (t[0, 0] + ahead[k - 1] * t[1, 0]))
        for k in range(len(e) - 2, -1, -1):
            x = e[k + 1] * back[k + 1]
            back[k] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        p = ahead * back / (1 + ahead * back)
        c = model.coefficients
        z = c[0] + c[1] * p.max() + c[2] * math.log1p(p.sum()) + c[3] * math.sqrt(p.mean())
        assert abs(first[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_tokens_cross_no_rows():
    start, end, row, found = toxicity.tokens(pa.array(["ab", "ÀB c", None, "İx", "ab"]))
    assert list(zip(start, end, row)) == [(0, 2, 0), (0, 3, 1), (4, 5, 1), (0, 3, 3), (0, 2, 4)]
    assert (found[0] == found[4]).all()
