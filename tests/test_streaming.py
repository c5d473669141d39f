import datetime as dt

from tessera.streaming.changes import watch

T = lambda n: dt.datetime(2025, 1, n)
SCHEMA = "path string, sha256 string, scanned_at timestamp, extra int"


def test_watch(spark, tmp_path):
    batches = [
        [("a", "1", T(1), 0), ("b", "1", T(2), 0), (None, "1", T(1), 0), ("n", "1", None, 0)],
        [("a", "2", T(5), 0), ("a", "old", T(3), 0), ("b", "1", T(6), 0)],
        [("a", "older", T(4), 0), ("b", None, T(7), 0), ("c", None, T(1), 0)],
    ]
    source = tmp_path / "in"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)) if source.mkdir() is None else None
    q = watch(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        got = [(r.path, r.change, r.sha256) for r in spark.sql("SELECT * FROM changes").collect()]
    finally:
        q.stop()
    assert sorted(got, key=str) == sorted([("a", "new", "1"), ("b", "new", "1"), ("a", "changed", "old"), ("a", "changed", "2"), ("b", "deleted", None)], key=str)
