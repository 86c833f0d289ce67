"""Report relations: dedented lines, unified rows with variants, fallback rows, label widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_prefix, expand_tabs, is_blank, trimmed


def instance_lines(inst: DataFrame, files: DataFrame) -> DataFrame:
    """hash, inst (0.. in order), file, line, t for every line of every instance, tabs expanded.

    inst numbers come from a window over a group's instances; texts are joined in afterwards.
    """
    numbered = inst.withColumn("inst", (F.row_number().over(Window.partitionBy("hash").orderBy("file_ord", "post_ord")) - 1).cast("int"))
    texts = files.select("file", "text")
    cut = F.slice(F.split("text", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    found = numbered.join(texts, "file").select("hash", "inst", "file", "start_line", F.posexplode(cut).alias("k", "t"))
    return found.select("hash", "inst", "file", (F.col("start_line") + F.col("k")).alias("line"), expand_tabs(F.col("t")).alias("t"))


def dedented(rows: DataFrame, *key: str) -> DataFrame:
    """rows with the longest run of spaces and tabs that begins all of a key's lines, blank ones aside, taken off.

    Of a set of strings the least and the greatest share what all of them share. A line without that run becomes empty.
    """
    lead = F.when(~is_blank(F.col("t")), F.regexp_extract("t", r"^[ \t]*", 0))
    cut = rows.groupBy(*key).agg(F.coalesce(common_prefix(F.min(lead), F.max(lead)), F.lit(0)).alias("_cut"), F.min(lead).alias("_lead"))
    prefix = F.left(F.coalesce("_lead", F.lit("")), F.col("_cut"))
    both = rows.join(cut, list(key))
    return both.withColumn("t", F.when(F.startswith("t", prefix), F.substr("t", F.col("_cut") + 1)).otherwise("")).drop("_cut", "_lead")


def content_numbered(rows: DataFrame) -> DataFrame:
    """rows (hash, inst, line, t) with idx: a line's number among its instance's lines that aren't blank; null for blank ones."""
    w = Window.partitionBy("hash", "inst").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    blank = is_blank(F.col("t"))
    return rows.withColumn("idx", F.when(~blank, F.sum(F.when(blank, 0).otherwise(1)).over(w)))


def unifiable(numbered: DataFrame) -> DataFrame:
    """hash of the groups whose instances all have as many lines that aren't blank."""
    per = numbered.groupBy("hash", "inst").agg(F.count("idx").alias("n"))
    return per.groupBy("hash").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a = b").select("hash")


def unified_rows(numbered: DataFrame) -> DataFrame:
    """hash, line0, variant, labels, text, alternative for the unifiable groups.

    A position whose lines agree but for white space at their ends is one row labelled with the first instance's line. Where they
    differ there is a row for each text, in the order of instances, labelled with the lines of all that have it; all but the first are
    alternatives. The first instance's blank lines stay.
    """
    rows = numbered.join(unifiable(numbered), "hash", "left_semi")
    full = rows.where("idx IS NOT NULL").withColumn("key", trimmed(F.col("t")))
    variants = full.groupBy("hash", "idx", "key").agg(F.min(F.struct("inst", "line", "t")).alias("first"), F.array_sort(F.collect_list(F.struct("inst", "line"))).alias("all"))
    w = Window.partitionBy("hash", "idx")
    placed = variants.withColumn("variant", F.row_number().over(w.orderBy("first.inst")) - 1).withColumn("several", F.count("*").over(w) > 1).withColumn("line0", F.min(F.when(F.col("first.inst") == 0, F.col("first.line"))).over(w))
    labels = F.when(F.col("several"), F.array_join(F.transform("all", lambda x: x["line"].cast("string")), ", ")).otherwise(F.col("line0").cast("string"))
    content = placed.select("hash", "line0", "variant", labels.alias("labels"), F.col("first.t").alias("text"), (F.col("variant") > 0).alias("alternative"))
    blank = rows.where("idx IS NULL AND inst = 0").select("hash", F.col("line").alias("line0"), F.lit(0).alias("variant"), F.col("line").cast("string").alias("labels"), F.lit("").alias("text"), F.lit(False).alias("alternative"))
    return content.unionByName(blank)


def fallback_rows(numbered: DataFrame) -> DataFrame:
    """hash, inst, line, text: every line of the groups that can't be unified."""
    rows = numbered.join(unifiable(numbered), "hash", "left_anti")
    return rows.select("hash", "inst", "line", F.col("t").alias("text"))


def exact_matches(rows: DataFrame) -> DataFrame:
    """hash, exact: whether all instances' dedented lines are the same."""
    joined = rows.groupBy("hash", "inst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("body"))
    return joined.groupBy("hash").agg((F.min("body") == F.max("body")).alias("exact"))


def label_widths(inst: DataFrame) -> DataFrame:
    """hash, width: digits of the greatest end line, 3 at least."""
    return inst.groupBy("hash").agg(F.greatest(F.lit(3), F.length(F.max("end_line").cast("string"))).cast("long").alias("width"))
