"""Queries over the driver's tables and their SQL counterparts.

The tables hold text rather than code, so the operators run on the trees that text has (documents of lines of
words, conversations of turns), where SQL can say what is right. Markup is parsed by a front-end of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnonymizationSettings
from ..functions import text as fx
from ..operators import cache, detect, diff, report
from ..sources import html, text

THRESHOLD = 10
CHAT_THRESHOLD = 4
FLAGS = {
    "variables": AnonymizationSettings(True, False, False, False),
    "literals": AnonymizationSettings(False, True, False, False),
    "names": AnonymizationSettings(False, False, True, False),
    "identifiers": AnonymizationSettings(False, False, False, True),
    "all": AnonymizationSettings(True, True, True, True),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.documents(_table(spark, sf_dir, "documents"))


def _nodes(spark: SparkSession, sf_dir: str, least: int = THRESHOLD) -> DataFrame:
    return text.subtrees(_files(spark, sf_dir), least=least)


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.repeated(_nodes(spark, sf_dir))


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", F.lower(F.hex("hash")))


def _groups(inst: DataFrame) -> DataFrame:
    return _hex(detect.summarized(inst)).select("hash", F.col("node_count").cast("long").alias("node_count"), "instance_count")


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def changed_lines_model(files: DataFrame) -> DataFrame:
    """A made-up patch: all lines of files with an ordinal divisible by 5, even lines of those divisible by 7."""
    all_lines = files.where("text IS NOT NULL AND (file_ord % 5 = 0 OR file_ord % 7 = 0)").select("file", "file_ord", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n", -1)))).alias("line"))
    return all_lines.where("file_ord % 5 = 0 OR line % 2 = 0").select("file", "line")


def doc_lines(spark, sf_dir):
    rows = _files(spark, sf_dir).select("file_ord", F.posexplode(fx.lines(F.col("text"))).alias("k", "t"))
    numbered = report.content_numbered(rows.select(F.lit(0).alias("hash"), F.col("file_ord").alias("inst"), (F.col("k") + 1).alias("line"), "t"))
    return numbered.select(F.col("inst").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("idx").cast("long").alias("content_no"), F.md5(F.col("t").cast("binary")).alias("line_md5"))


def doc_subtrees(spark, sf_dir):
    return _longs(_hex(_nodes(spark, sf_dir, 1)).select("file", "post_ord", "start_line", "end_line", "node_count", "hash"), "start_line", "end_line", "node_count")


def _anon(name):
    def query(spark, sf_dir):
        nodes = text.subtrees(_files(spark, sf_dir), FLAGS[name], fold_case=False, least=THRESHOLD)
        return _groups(detect.instances(nodes))

    query.__name__ = f"anon_{name}"
    return query


def _least(n):
    def query(spark, sf_dir):
        return _nodes(spark, sf_dir, n).groupBy("file").agg(F.count("*").alias("subtrees"), F.sum(F.col("node_count").cast("long")).alias("nodes"))

    query.__name__ = f"min_node_count_filter_{n}"
    return query


def hash_groups(spark, sf_dir):
    g = _hex(detect.hash_groups(_nodes(spark, sf_dir)))
    return g.select("hash", F.col("node_count").cast("long").alias("node_count"), "instance_count", F.col("first.file_ord").alias("first_file"), F.col("first.post_ord").alias("first_node"))


def clone_instances(spark, sf_dir):
    return _longs(_hex(_instances(spark, sf_dir)).select("hash", "file", "post_ord", "start_line", "end_line", "group_nodes"), "start_line", "end_line", "group_nodes")


def changed_lines(spark, sf_dir):
    return _longs(changed_lines_model(_files(spark, sf_dir)), "line")


def _changed(spark, sf_dir):
    return detect.changed(_instances(spark, sf_dir), changed_lines_model(_files(spark, sf_dir)))


def patch_contains_range(spark, sf_dir):
    return _hex(_changed(spark, sf_dir)).select("hash", "file", "post_ord", "changed")


def patch_filter(spark, sf_dir):
    return _groups(detect.patch_filter(_instances(spark, sf_dir), changed_lines_model(_files(spark, sf_dir))))


def patch_new_vs_existing(spark, sf_dir):
    g = _changed(spark, sf_dir).groupBy("hash").agg(F.count_if("changed").alias("new"), F.count_if(~F.col("changed")).alias("existing")).where("new > 0")
    return _hex(g.withColumn("intra_patch", F.col("existing") == 0))


def subsumption_covered(spark, sf_dir):
    return _hex(detect.covered(_instances(spark, sf_dir))).select("hash", "file", "post_ord", "covered")


def subsumption_filter(spark, sf_dir):
    inst = detect.subsumption(_instances(spark, sf_dir))
    return _hex(inst).select("hash", "file", "post_ord")


def clone_groups(spark, sf_dir):
    return _groups(detect.detect(_nodes(spark, sf_dir), THRESHOLD))


def clone_groups_patch(spark, sf_dir):
    return _groups(detect.detect(_nodes(spark, sf_dir), THRESHOLD, changed_lines_model(_files(spark, sf_dir))))


def clone_groups_ranked(spark, sf_dir):
    g = detect.ranked(detect.summarized(detect.detect(_nodes(spark, sf_dir), THRESHOLD)))
    return _longs(_hex(g).select("clone_no", "hash", "node_count", "instance_count"), "node_count")


def flagship(spark, sf_dir):
    return clone_groups_ranked(spark, sf_dir)


_EXCLUDED = ("https://spam-farm.example.org", "http://blog.ththan.example.net/en", "https://ththin.example.com/en/671")


def exclude_filter(spark, sf_dir):
    from ..sources.scan import not_excluded

    return _table(spark, sf_dir, "pages").where(not_excluded(F.col("url"), list(_EXCLUDED))).select("page_id", "url")


def scan_dedup(spark, sf_dir):
    from ..sources.scan import union_paths

    pages = _table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("ord"))
    return union_paths([pages.where(F.startswith("path", F.lit(p))) for p in ("https://", "http://", "https://spam-farm", "http://blog")] + [pages], "ord").select("path", F.col("ord").alias("first_page"))


def _report_lines(spark, sf_dir):
    rows = report.instance_lines(_instances(spark, sf_dir), _files(spark, sf_dir))
    return report.dedented(rows, "hash", "inst")


def exact_match(spark, sf_dir):
    return _hex(report.exact_matches(_report_lines(spark, sf_dir)))


def dedent_lines(spark, sf_dir):
    rows = _files(spark, sf_dir).select("file", F.posexplode(fx.lines(F.col("text"))).alias("k", "t")).select("file", (F.col("k") + 1).cast("long").alias("line"), fx.expand_tabs(F.col("t")).alias("t"))
    return report.dedented(rows, "file").select("file", "line", F.md5(F.col("t").cast("binary")).alias("text_md5"))


def unified_rows(spark, sf_dir):
    rows = report.unified_rows(report.content_numbered(_report_lines(spark, sf_dir)))
    return _longs(_hex(rows), "line0", "variant")


def unified_fallback(spark, sf_dir):
    """Groups of unlike instances: whole documents that begin with the same line."""
    files = _files(spark, sf_dir)
    whole = files.where("text IS NOT NULL").withColumns({"hash": F.unhex(F.md5(F.split("text", "\n")[0].cast("binary"))), "post_ord": F.lit(1).cast("long"), "start_line": F.lit(1), "end_line": F.size(F.split("text", "\n", -1)), "node_count": F.lit(1)}).drop("text")
    lines = report.dedented(report.instance_lines(detect.instances(whole), files), "hash", "inst")
    rows = report.fallback_rows(report.content_numbered(lines))
    return _longs(_hex(rows), "inst", "line")


def line_label_width(spark, sf_dir):
    return _hex(report.label_widths(_instances(spark, sf_dir)))


def diff_ranges(spark, sf_dir):
    rows = report.content_numbered(_report_lines(spark, sf_dir))
    return _longs(_hex(diff.diff_ranges(rows)), "inst", "line")


def cache_hit_miss(spark, sf_dir):
    files = _files(spark, sf_dir).where("text IS NOT NULL")
    settings = text.LITERALS_ONLY
    earlier, _ = cache.split(files, files.where("file_ord % 3 = 0").select(F.md5(F.col("text").cast("binary")).alias("content_md5"), cache.cache_key(settings, "text").alias("cache_key")), settings, "text")
    stored = text.subtrees(earlier, least=THRESHOLD).withColumn("hit", F.lit(True))
    known = earlier.select("content_md5", "cache_key")
    _, fresh = cache.split(files, known, settings, "text")
    both = stored.unionByName(text.subtrees(fresh, least=THRESHOLD).withColumn("hit", F.lit(False)))
    return both.groupBy("file", "hit").agg(F.count("*").alias("subtrees"))


def chat_clone_groups(spark, sf_dir):
    nodes = text.subtrees(text.conversations(_table(spark, sf_dir, "conversations")), least=CHAT_THRESHOLD)
    return _groups(detect.detect(nodes, CHAT_THRESHOLD))


def html_subtrees(spark, sf_dir):
    return _longs(_hex(html.subtrees(_table(spark, sf_dir, "pages"))).select("file", "post_ord", "start_line", "end_line", "node_count", "hash"), "start_line", "end_line", "node_count")


def html_clone_groups(spark, sf_dir):
    return _groups(detect.detect(html.subtrees(_table(spark, sf_dir, "pages")), THRESHOLD))


def benchmark_overlap(spark, sf_dir):
    """Lines that documents share with benchmark items: the benchmark is the patch side."""
    bench = text.subtrees(text.documents(_table(spark, sf_dir, "benchmark"), "item_id")).where("start_line = end_line").select("hash").distinct()
    nodes = _nodes(spark, sf_dir, 1).join(bench, "hash", "left_semi")
    return nodes.groupBy(F.col("file_ord").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum(F.col("node_count").cast("long")).alias("nodes"))


QUERIES = (
    doc_lines, doc_subtrees, *map(_anon, FLAGS), *map(_least, (5, 10, 50)), hash_groups, clone_instances, changed_lines, patch_contains_range,
    patch_filter, patch_new_vs_existing, subsumption_covered, subsumption_filter, clone_groups, clone_groups_patch, clone_groups_ranked,
    exclude_filter, scan_dedup, exact_match, dedent_lines, unified_rows, unified_fallback, line_label_width, diff_ranges, cache_hit_miss,
    chat_clone_groups, html_subtrees, html_clone_groups, benchmark_overlap,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.statements()
