"""The queries of this subpackage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), 200)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), 50, 5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _pattern())


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 2, 80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = table(spark, sf_dir, "documents")
    words = secrets.dictionary(docs)
    return secrets.scan(docs, secrets.train_forest(secrets.sample_findings(spark), words), words)


def op7_bpe_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), _pattern())


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_neighbours, op3_packing, op4_near_duplicates, op5_quality, op6_secrets, op7_bpe_pieces, op8_token_counts, op9_toxicity, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup, minhash

    return {"op4_near_duplicates": minhash.oracle(2, 80), "op10_line_dedup": line_dedup.oracle()}
