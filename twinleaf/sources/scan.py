"""File scans and path predicates."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UserError


def not_excluded(path: Column, excludes: list[str]) -> Column:
    """True for paths that are no exclude and lie in none."""
    keep = F.lit(True)
    for e in excludes:
        keep = keep & ~((path == e) | F.startswith(path, F.lit(e.rstrip("/") + "/")))
    return keep


def union_paths(parts: list[DataFrame], order: str) -> DataFrame:
    """The union of path lists, each path once, with its least order."""
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.groupBy("path").agg(F.min(order).alias(order))


def list_files(paths: list[str], excludes: list[str] = (), suffix: str = ".php") -> list[str]:
    """The canonical paths of files with the suffix, sorted within each given path, each once."""
    away = [os.path.realpath(e) for e in excludes]
    seen: dict[str, None] = {}
    for path in paths:
        if not os.path.exists(path):
            raise UserError(f"Path not found: {path}")
        if os.path.isfile(path):
            found = [path]
        else:
            found = sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)
        for f in map(os.path.realpath, found):
            if os.path.splitext(f)[1] == suffix and not any(f == e or f.startswith(e.rstrip(os.sep) + os.sep) for e in away):
                seen[f] = None
    return list(seen)


def read_files(spark: SparkSession, paths: list[str], excludes: list[str] = (), glob: str = "*.php") -> DataFrame:
    """file, file_ord, text of all matching files under paths, read by the executors; file_ord follows the sorted paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(paths))
    named = found.select(F.regexp_replace("path", "^file:/*", "/").alias("file"), F.col("content").cast("string").alias("text"))
    kept = named.where(not_excluded(F.col("file"), [os.path.realpath(e) for e in excludes])).dropDuplicates(["file"])
    # rising with the sorted path; gaps don't matter to an order
    return kept.orderBy("file").select("file", F.monotonically_increasing_id().alias("file_ord"), "text")


def read_listed(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, file_ord (the place in files) and text of the listed files, read by the executors. Bytes that aren't UTF-8 become U+FFFD."""
    for f in files:
        if not os.access(f, os.R_OK):
            raise UserError(f"File can't be read: {f}")

    def run(batches):
        for batch in batches:
            texts = []
            for f in batch["file"]:
                try:
                    with open(f, "rb") as source:
                        texts.append(source.read().decode("utf-8", "replace"))
                except OSError as e:
                    raise UserError(f"File can't be read: {f}") from e
            yield batch.assign(text=texts)

    parts = max(1, min(len(files) // 50, 10_000))
    names = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "file string, file_ord long").repartition(parts)
    return names.mapInPandas(run, "file string, file_ord long, text string")
