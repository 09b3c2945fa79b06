import datetime as dt

from pyspark.sql import Row

from vellum.streaming import events


def write(spark, path, rows):
    spark.createDataFrame(rows, "key string, ts timestamp, event_id long, outcome string").coalesce(1).write.mode("append").parquet(path)


def test_idempotent_stream_matches_its_batch_twin(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    first = [("a", t(0), 1, "failed"), ("b", t(0), 2, "completed"), ("c", t(0), 3, "processing")]
    second = [("a", t(1), 4, "completed"), ("a", t(2), 5, "completed"), ("b", t(1), 6, "failed"), ("c", t(1), 7, "completed")]
    source = str(tmp_path / "in")
    write(spark, source, first)
    stream = spark.readStream.schema("key string, ts timestamp, event_id long, outcome string").parquet(source)
    q = events.deduplicated(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        write(spark, source, second)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.event_id: (r.started, r.status, r.attempts) for r in spark.table("decided").collect()}
    assert got == {1: (True, "failed", 1), 2: (True, "completed", 1), 3: (True, "processing", 1), 4: (True, "completed", 2), 5: (False, "completed", 2), 6: (False, "completed", 1), 7: (False, "completed", 1)}
    batch = spark.createDataFrame(first + second, "key string, ts timestamp, event_id long, outcome string")
    assert {r.event_id: (r.started, r.status) for r in events.replayed(batch).collect()} == {k: v[:2] for k, v in got.items()}


def test_windows_with_watermark(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    spark.read.parquet(f"{data}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream, size="1 day").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(r.n for r in spark.table("windows").collect()) == spark.read.parquet(f"{data}/events.parquet").count()


def test_keys_and_status(spark):
    df = spark.createDataFrame([Row(i=None, e="ocr", d=5, v=None), Row(i="x", e="ocr", d=5, v=2)], "i string, e string, d int, v int")
    assert [r.k for r in df.select(events.event_key(df.i, df.e, df.d, df.v).alias("k")).collect()] == ["ocr:doc:5:version:unknown", "x"]
