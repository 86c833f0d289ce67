import hashlib
import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from twinleaf.llm import packing, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(12)
    plain = [a + b for a in ("the", "sta", "ren", "öl", "qua", "mi", "do") for b in ("ti", "no", "ra", "é", "sh", "pe")]
    rows, labels = [], []

    def add(text):
        i = len(rows)
        rows.append((i, text, "en", f"s{i % 13}", None if text is None else len(text)))
        return i

    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.choice([20, 60, 200]))]
        if i % 7 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "vequ" + rng.choice(["ta", "no"]))
        text = " ".join(w)
        if i % 5 == 1:
            text += "\nAll rights reserved by nobody.\n" + rng.choice(plain)
        if i % 11 == 2:
            text += f'\ntoken = "{hashlib.sha1(str(i).encode()).hexdigest()}"'
        labels.append((add(text), int(i % 7 == 0)))
        if i % 9 == 3:
            add(text)
            add(text.replace(" ", "  ", 3) + " once")
    add(None), add("")
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {r[0]: r[1] for r in rows}, dict(labels)


def five_word_sets(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_each_stage_against_brute_force(spark, corpus, tmp_path):
    path, texts, labels = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            kept.append({r.doc_id: r for r in out.collect()})
        docs = out
    # 1: decided by the model, right for all but noise
    predicted = {r.doc_id: r.predicted for r in toxicity.score(spark.read.parquet(f"{path}/documents.parquet"), toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))).collect()}
    assert set(kept[0]) == {i for i in texts if not predicted[i]}
    assert sum(predicted[i] != y for i, y in labels.items()) <= 0.02 * len(labels)
    # 2: the shared line goes, texts are otherwise as they were
    line = "All rights reserved by nobody.\n"
    assert set(kept[1]) == set(kept[0]) and any(line in r.text for r in kept[0].values() if r.text)
    for i, r in kept[1].items():
        before = kept[0][i].text
        assert r.text == (before if before is None else before.replace(line, "")) and r.n_chars == (None if r.text is None else len(r.text))
    # 3: all pairs
    ids = sorted(kept[1])
    sets = {i: five_word_sets(kept[1][i].text) for i in ids}
    root = {i: i for i in ids}
    for y in ids:
        for x in ids:
            if x >= y:
                break
            a, b = sets[x], sets[y]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                rx, ry = root[x], root[y]
                for i in ids:
                    if root[i] == max(rx, ry):
                        root[i] = min(rx, ry)
    assert set(kept[2]) == {i for i in ids if root[i] == i} and len(kept[2]) < len(ids)
    # 4: the secret goes, nothing else does
    marked = 0
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        before = kept[2][i].text
        assert r.text == (before if before is None else re.sub("[0-9a-f]{40}", secrets.MARK, before))
        marked += r.text != before
    assert marked > 20
    # 5: every piece is placed once, without overlap
    import public_tokenizers as P

    encode = packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(kept[3])
    total = {i: len(encode.ids(r.text or "")) + 1 for i, r in kept[3].items()}
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in total} == total
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for o2, n in own if o2 < o) for o, _ in sorted(own)]
    assert len(bins) <= -(-sum(total.values()) // 2048) + 2
    assert corpus_pipeline.run(spark, path).count() == len(pieces)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
