import os

from twinleaf import cli
from twinleaf.config import AnonymizationSettings
from twinleaf.operators import cache

FLAGS = AnonymizationSettings()


def table(spark, n, md5="m"):
    return spark.createDataFrame([(k, 1, 1, 5, bytearray(b"h"), md5, "php-1-1000") for k in range(n)], cli.CACHED)


def test_no_table_and_a_table_of_garbage(spark, tmp_path):
    assert cache.read(spark, str(tmp_path / "none"), cli.CACHED).count() == 0
    folder = tmp_path / "garbage"
    folder.mkdir()
    (folder / "part-0.parquet").write_bytes(b"no parquet at all, but long enough to be read as one")
    assert cache.read(spark, str(folder), cli.CACHED).count() == 0
    cache.write(table(spark, 3), str(folder))
    assert cache.read(spark, str(folder), cli.CACHED).count() == 3


def test_rows_written_twice_count_once(spark, tmp_path):
    folder = str(tmp_path / "twice")
    for _ in range(2):
        cache.write(table(spark, 4), folder)
    cache.write(table(spark, 2, "other"), folder)
    assert cache.read(spark, folder, cli.CACHED).groupBy("content_md5").count().orderBy("count").collect() == [("other", 2), ("m", 4)]


def test_other_flags_front_ends_and_contents_miss(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("d", None)], "file string, text string")
    known = spark.createDataFrame([("9dd4e461268c8034f5c8564e155c67a6", "php-1-1000")], "content_md5 string, cache_key string")  # of x
    sizes = []
    for flags, frontend in ((FLAGS, "php"), (FLAGS, "python"), (AnonymizationSettings(True, True, False, False), "php")):
        hits, misses = cache.split(files, known, flags, frontend)
        sizes.append((hits.count(), misses.count()))
    assert sizes == [(2, 2), (0, 4), (0, 4)]


def test_a_broken_cache_is_made_anew(spark, tmp_path):
    body = "<?php function f($a) { $b = $a + 1; return $b * 2; }"
    files = []
    for name in ("one.php", "two.php"):
        (tmp_path / name).write_text(body)
        files.append(str(tmp_path / name))
    folder = str(tmp_path / "cache")

    def groups():
        found = cli.find(spark, files, 5, FLAGS, cli.php.parse, "php", folder)
        return [(g.node_count, [(os.path.basename(i.file), i.start) for i in g.instances]) for g in found]

    first = groups()
    assert first and groups() == first
    for part in (tmp_path / "cache" / "subtrees").glob("*.parquet"):
        part.write_bytes(b"broken" * 50)
    for crc in (tmp_path / "cache" / "subtrees").glob(".*.crc"):
        crc.unlink()
    assert groups() == first
    cache.write(cache.read(spark, f"{folder}/subtrees", cli.CACHED).limit(0).unionByName(cache.read(spark, f"{folder}/subtrees", cli.CACHED)), f"{folder}/subtrees")
    assert groups() == first
