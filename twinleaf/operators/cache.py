"""Subtrees kept from run to run, by content: a table instead of a file for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnonymizationSettings

#: Raise with any change of a front-end's node shapes or digests.
FRONTEND_VERSION = "1"


def cache_key(settings: AnonymizationSettings, frontend: str):
    flags = "".join(str(int(x)) for x in (settings.variables, settings.literals, settings.names, settings.identifiers))
    return F.lit(f"{frontend}-{FRONTEND_VERSION}-{flags}")


def split(files: DataFrame, cached: DataFrame, settings: AnonymizationSettings, frontend: str, content: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): a file is a hit if a cached row has its content's digest under the same flags and front-end.

    The threshold isn't part of the key: all subtrees are kept and filtered later.
    """
    keyed = files.withColumn("content_md5", F.md5(F.col(content).cast("binary"))).withColumn("cache_key", cache_key(settings, frontend))
    known = cached.select("content_md5", "cache_key").distinct()
    return keyed.join(known, ["content_md5", "cache_key"], "left_semi"), keyed.join(known, ["content_md5", "cache_key"], "left_anti")


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The cached rows; none where there is no table.

    Files that can't be read count as missing, so their contents are parsed anew, and a node that was
    written twice, by a run that was tried again or by two at a time, is there once.
    """
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.dropDuplicates(["content_md5", "cache_key", "post_ord"])


def write(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)
