from twinleaf.model import SUBTREES
from twinleaf.streaming.incremental import arriving_clones


def test_groups_are_reported_from_their_second_instance(spark, tmp_path):
    def batch(*rows):
        frame = spark.createDataFrame([(f, k, 1, s, s + 2, n, bytearray(h.encode())) for k, (f, s, n, h) in enumerate(rows)], SUBTREES)
        frame.write.mode("append").parquet(str(tmp_path / "in"))

    batch(("a", 1, 60, "x"), ("b", 4, 60, "x"), ("c", 1, 60, "y"), ("d", 1, 3, "small"), ("e", 1, 3, "small"))
    source = spark.readStream.schema(SUBTREES).parquet(str(tmp_path / "in"))
    query = arriving_clones(source).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        got = [(bytes(r.hash).decode(), r.instance_no, r.file, r.first_file) for r in spark.table("arrived").collect()]
        assert got == [("x", 2, "b", "a")]
        batch(("f", 9, 70, "y"), ("g", 9, 70, "x"))
        query.processAllAvailable()
        got = {(bytes(r.hash).decode(), r.instance_no, r.file, r.first_file) for r in spark.table("arrived").collect()}
        assert got == {("x", 2, "b", "a"), ("y", 2, "f", "c"), ("x", 3, "g", "a")}
    finally:
        query.stop()


def test_a_frequent_digest_is_numbered_without_gaps(spark, tmp_path):
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.createDataFrame([(f"f{k}", k, 1, 1, 3, 60, bytearray(b"hot")) for k in range(50)], SUBTREES).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SUBTREES).parquet(str(tmp_path / "in"))
    query = arriving_clones(source).writeStream.format("memory").queryName("frequent").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        got = spark.table("frequent").collect()
        assert sorted(r.instance_no for r in got) == list(range(2, 51))
        assert len({r.first_file for r in got}) == 1 and len({r.file for r in got} | {got[0].first_file}) == 50
    finally:
        query.stop()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
