"""Subtrees to clone groups, as declarative plans.

Shuffles: one on hash to count, one to bring the repeated subtrees together with their group, one
on file for the range anti-join. Counting combines within map tasks, and only hashes that
repeat go on, so the later steps are of the size of what is duplicated. detect() extracts once: subtrees, groups
and instances are written before they are used again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

ORDINAL = ("file_ord", "post_ord")


def hash_groups(subtrees: DataFrame) -> DataFrame:
    """hash, node_count (of the first instance), instance_count and first (its ordinals) for hashes with two instances or more."""
    first = F.min(F.struct(*ORDINAL, "node_count"))
    counted = subtrees.groupBy("hash").agg(F.count("*").alias("instance_count"), first.alias("x")).where("instance_count >= 2")
    return counted.select("hash", F.col("x.node_count").alias("node_count"), "instance_count", F.struct("x.file_ord", "x.post_ord").alias("first"))


def instances(subtrees: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The subtrees of groups, each with its group's node count (group_nodes)."""
    groups = hash_groups(subtrees) if groups is None else groups
    return subtrees.join(groups.select("hash", F.col("node_count").alias("group_nodes")), "hash")


def islands(changed_lines: DataFrame) -> DataFrame:
    """file, lo, hi: the unbroken runs of changed lines."""
    w = Window.partitionBy("file").orderBy("line")
    runs = changed_lines.distinct().withColumn("run", F.col("line") - F.row_number().over(w))
    return runs.groupBy("file", "run").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).drop("run")


def _touched(inst: DataFrame, runs: DataFrame) -> Column:
    return (inst["file"] == runs["i_file"]) & (runs["lo"] <= inst["start_line"]) & (runs["hi"] >= inst["end_line"])


def changed(inst: DataFrame, changed_lines: DataFrame) -> DataFrame:
    """inst with changed: whether every line of the instance is among the changed ones. A file without changes has none."""
    runs = islands(changed_lines).withColumnRenamed("file", "i_file")
    yes = inst.join(runs, _touched(inst, runs), "left_semi").withColumn("changed", F.lit(True))
    runs = islands(changed_lines).withColumnRenamed("file", "i_file")
    no = inst.join(runs, _touched(inst, runs), "left_anti").withColumn("changed", F.lit(False))
    return yes.unionByName(no)


def patch_filter(inst: DataFrame, changed_lines: DataFrame) -> DataFrame:
    """The instances of groups of which any instance lies wholly in changed lines."""
    runs = islands(changed_lines).withColumnRenamed("file", "i_file")
    touched = inst.join(runs, _touched(inst, runs), "left_semi").select("hash").distinct()
    return inst.join(touched, "hash", "left_semi")


def _covers(i: DataFrame, b: DataFrame) -> Column:
    return (b["c_file"] == i["file"]) & (b["c_nodes"] > i["group_nodes"]) & (b["c_start"] <= i["start_line"]) & (b["c_end"] >= i["end_line"])


def _ranges(inst: DataFrame) -> DataFrame:
    """What can cover: by file and range the largest node count, so repeated ranges are one row."""
    return inst.groupBy(F.col("file").alias("c_file"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end")).agg(F.max("group_nodes").alias("c_nodes"))


def covered(inst: DataFrame) -> DataFrame:
    """inst with covered: whether a range of a group with strictly more nodes holds it."""
    by = _ranges(inst)
    yes = inst.join(by, _covers(inst, by), "left_semi").withColumn("covered", F.lit(True))
    by = _ranges(inst)
    no = inst.join(by, _covers(inst, by), "left_anti").withColumn("covered", F.lit(False))
    return yes.unionByName(no)


def subsumption(inst: DataFrame) -> DataFrame:
    """The instances of groups that have one that no larger group covers.

    A group whose instances all lie in larger ones goes, whether or not those groups stay themselves: containment
    is transitive, so a largest one stays. Hence one anti-join does what a walk from the largest group down would.
    """
    by = _ranges(inst)
    alive = inst.join(by, _covers(inst, by), "left_anti").select("hash").distinct()
    return inst.join(alive, "hash", "left_semi")


def as_groups(inst: DataFrame) -> DataFrame:
    """One row for each group: hash, node_count, instance_count, first and the ordered instances."""
    one = F.struct(*ORDINAL, "file", "start_line", "end_line", "node_count")
    grouped = inst.groupBy("hash").agg(F.array_sort(F.collect_list(one)).alias("instances"))
    return grouped.select("hash", F.col("instances")[0]["node_count"].alias("node_count"), F.size("instances").cast("long").alias("instance_count"), F.struct(F.col("instances")[0]["file_ord"].alias("file_ord"), F.col("instances")[0]["post_ord"].alias("post_ord")).alias("first"), "instances")


def summarized(inst: DataFrame) -> DataFrame:
    """as_groups() without the list: partial aggregation only."""
    first = F.min(F.struct(*ORDINAL, "node_count"))
    return inst.groupBy("hash").agg(F.count("*").alias("instance_count"), first.alias("x")).select("hash", F.col("x.node_count").alias("node_count"), "instance_count", F.struct("x.file_ord", "x.post_ord").alias("first"))


def ordering() -> list[Column]:
    """Largest first, then most instances, then first appearance."""
    return [F.desc("node_count"), F.desc("instance_count"), F.asc("first.file_ord"), F.asc("first.post_ord")]


def ranked(groups: DataFrame) -> DataFrame:
    """groups with clone_no 1.. in report order.

    Numbers come from range partitions and their sizes, not from a window over one partition.
    """
    spark = groups.sparkSession
    placed = groups.orderBy(*ordering()).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = written(placed)
    sizes = {r[0]: r[1] for r in placed.groupBy("_part").count().collect()}  # a row for each partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = spark.createDataFrame(before, "_part int, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn("clone_no", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def detect(subtrees: DataFrame, min_node_count: int = 50, changed_lines: DataFrame | None = None) -> DataFrame:
    """Instances of the clone groups that stay: threshold, groups, patch filter, subsumption, in this order."""
    inst = repeated(subtrees.where(F.col("node_count") >= min_node_count))
    if changed_lines is not None:
        inst = written(patch_filter(inst, changed_lines))
    return subsumption(inst)


def repeated(subtrees: DataFrame) -> DataFrame:
    """instances(), written; the subtrees are made once. The groups are written too: a join of tables, of which Spark can split a hot hash's side."""
    kept = written(subtrees)
    return written(instances(kept, written(hash_groups(kept))))
