"""Front-end for text: a document is a tree of lines, a line a tree of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnonymizationSettings
from ..functions.text import anonymized, is_blank, word_count

LITERALS_ONLY = AnonymizationSettings(variables=False, literals=True)


def subtrees(files: DataFrame, settings: AnonymizationSettings = LITERALS_ONLY, fold_case: bool = True, least: int = 1) -> DataFrame:
    """SUBTREES of files (file, file_ord, text): one node for each line that isn't blank, and one for the document.

    A line's node count is 1 and its words; a document's 1, its lines' and their words. A null text has no nodes. The threshold
    least is applied before anything is hashed.
    """
    shaped = F.transform(
        F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("t"))), lambda s: ~is_blank(s["t"])),
        lambda s: F.struct(s["line"].alias("line"), s["t"].alias("t"), word_count(s["t"]).alias("words")),
    )
    docs = files.where("text IS NOT NULL").select("file", "file_ord", "text", F.size(F.split("text", "\n", -1)).alias("n"), shaped.alias("ls"))
    line_nodes = docs.select("file", "file_ord", F.explode(F.filter("ls", lambda s: s["words"] + 1 >= least)).alias("s")).select(
        "file", "file_ord", F.col("s.line").cast("long").alias("post_ord"), F.col("s.line").alias("start_line"), F.col("s.line").alias("end_line"),
        (F.col("s.words") + 1).alias("node_count"), _digest("L|", F.col("s.t"), settings, fold_case))
    total = 1 + F.size("ls") + F.aggregate("ls", F.lit(0), lambda n, s: n + s["words"])
    doc_nodes = docs.withColumn("total", total).where(F.col("total") >= least).select(
        "file", "file_ord", (F.col("n") + 1).cast("long").alias("post_ord"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"),
        F.col("total").alias("node_count"), _digest("D|", F.col("text"), settings, fold_case))
    return line_nodes.unionByName(doc_nodes)


def _digest(tag: str, text, settings: AnonymizationSettings, fold_case: bool):
    return F.unhex(F.md5(F.concat(F.lit(tag), anonymized(text, settings, fold_case)).cast("binary"))).alias("hash")


def documents(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table's rows as files: named by their key and ordered by it."""
    return table.select(F.col(key).cast("string").alias("file"), F.col(key).cast("long").alias("file_ord"), F.col(text).alias("text"))


def conversations(table: DataFrame) -> DataFrame:
    """A conversation's turns, in order and one under the other, as one file."""
    turns = table.where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select(F.col("conv_id").cast("string").alias("file"), F.col("conv_id").cast("long").alias("file_ord"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))
