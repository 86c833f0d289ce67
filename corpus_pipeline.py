"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Null texts, empty tables, repeated rows and further columns pass through as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinleaf.llm import common, line_dedup, minhash, packing, secrets, toxicity


def _with_text_of(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars, where there is one, counts the new text's characters."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field rejects go; it learns from the labels that aren't held out."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share are taken out of the texts; every document stays."""
    return _with_text_of(line_dedup.remove_boilerplate(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: words in fives, a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, 5, 80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    words = secrets.dictionary(docs)
    forest = secrets.train_forest(secrets.sample_findings(spark), words)
    return _with_text_of(secrets.redact(docs, forest, words), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces packed in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Toxicity and secrets are learnt models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each stage's result written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
