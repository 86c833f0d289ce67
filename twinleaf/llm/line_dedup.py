"""Removal of lines that many sites share (operator 10), in DataFrame functions only.

A HyperLogLog sketch of the sites is kept for each line's hash and merged by aggregation, so a line of
many documents is condensed before it is shuffled. Only lines whose estimate is near the
threshold get an exact distinct count. Lines at or above the threshold are boilerplate and removed wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_SITES = 10
#: Of the sketch: 4096 registers, a relative error of 1.6 %; estimates within NEAR of the threshold are counted exactly.
LG_K, NEAR = 12, 0.15


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, site, key for each document's distinct lines that aren't blank."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _bare(x) != ""), _key))
    return docs.select("doc_id", F.when(F.col("source").isNotNull(), F.xxhash64("source")).alias("site"), F.explode(keys).alias("key"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key of every line that at least min_sites distinct sites have; a null site is none."""
    lines = line_keys(docs).where("site IS NOT NULL").select("key", "site")
    spread = common.cut(lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate")).where(F.col("estimate") >= min_sites * (1 - NEAR)))
    sure = spread.where(F.col("estimate") > min_sites * (1 + NEAR)).select("key")
    near = spread.where(F.col("estimate") <= min_sites * (1 + NEAR)).select("key")
    pairs = lines.join(near, "key", "left_semi").groupBy("key", "site").agg(F.lit(1))
    return sure.unionByName(pairs.groupBy("key").count().where(F.col("count") >= min_sites).select("key"))


def removed_lines(docs: DataFrame, bad: DataFrame, names: dict[str, str]) -> DataFrame:
    """For each document and text with lines of a key in bad: names' id, hash (of id and text), gone (for its lines up to the last such one whether they go) and n (of them); written and read again."""
    lines = docs.select(F.col("doc_id").alias(names["id"]), F.xxhash64("doc_id", "text").alias(names["hash"]), F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.when(_bare(x) != "", _key(x)))).alias("at", "key")).where("key IS NOT NULL")
    found = lines.join(bad, "key", "left_semi").groupBy(names["id"], names["hash"]).agg(F.sort_array(F.collect_set("at")).alias("at"))
    before = F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1))
    steps = F.zip_with("at", before, lambda x, y: F.concat(F.array_repeat(F.lit(False), x - y - 1), F.array(F.lit(True))))
    return common.cut(found.select(names["id"], names["hash"], F.flatten(steps).alias(names["gone"]), F.size("at").cast("long").alias(names["n"])))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with their text less the boilerplate lines, and n_lines and n_removed (lines that aren't blank).

    Lines end at \\n and are compared without spaces, tabs and carriage returns at their ends; blank lines stay. A null text stays null and has no lines.
    A row is judged by its own text: rows that share an id, repeat or have a null id lose their boilerplate like all others. Texts of any length are taken whole, in work
    and memory that grow with the number of their lines. Columns n_lines and n_removed of docs are replaced; all others are kept, whatever their names. An empty table gives no row.
    """
    names = {k: common.unused(f"_{k}", docs) for k in ("id", "hash", "gone", "n", "hit")}
    bad = common.cut(boilerplate(docs, min_sites))
    hits = removed_lines(docs, bad, names)
    hashed = docs.withColumn(names["hash"], F.xxhash64("doc_id", "text"))
    split = common.may_hold(hashed, hits, names["hash"], names["hit"])
    both = [names["gone"], names["n"]]
    some = split.where(names["hit"]).withColumnRenamed(names["hash"], names["hit"] + "_").drop(names["hit"])
    some = some.join(hits, (some[names["hit"] + "_"] == hits[names["hash"]]) & some["doc_id"].eqNullSafe(hits[names["id"]]), "left")
    none = split.where(f"NOT {names['hit']}").withColumns({c: F.lit(None).cast(hits.schema[c].dataType) for c in both})
    out = some.select(*docs.columns, *both).unionByName(none.select(*docs.columns, *both))
    gone, n = F.col(names["gone"]), F.col(names["n"])
    left = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False))), "\n")
    n_lines = F.coalesce(F.size(F.filter(_lines(F.col("text")), lambda x: _bare(x) != "")), F.lit(0)).cast("long")
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    return out.select(*others, F.when(n.isNull(), F.col("text")).otherwise(left).alias("text"), n_lines.alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the text that is left (null for a null text) of every row; see remove_boilerplate()."""
    return remove_boilerplate(docs.select("doc_id", "source", "text"), min_sites).select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
bad AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {sites}
), b AS (SELECT list(bare) AS bares FROM bad),
y AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls,
    list_filter(string_split(text, chr(10)), lambda y: NOT list_contains(coalesce(bares, []), trim(y, ' ' || chr(9) || chr(13)))) AS kept
  FROM documents, b
)
SELECT doc_id, CAST(coalesce(len(list_filter(ls, lambda v: trim(v, ' ' || chr(9) || chr(13)) <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_removed, CASE WHEN text IS NOT NULL THEN md5(array_to_string(kept, chr(10))) END AS text_md5
FROM y
"""


def oracle(min_sites: int = MIN_SITES) -> str:
    return ORACLE.replace("{sites}", str(min_sites))
