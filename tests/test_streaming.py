import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import windows


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(dt.datetime(2024, 1, 1, 0, m, s), "job", "k", 10) for m in range(30) for s in (1, 2)]
    spark.createDataFrame(rows, "ts timestamp, metric string, key string, chars long").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, metric string, key string, chars long").parquet(str(source))
    got = run(spark, windows.bucketed_counts(stream), "buckets", "complete")
    assert got.count() == 30 and got.agg(F.sum("count")).first()[0] == 60
    got = run(spark, windows.quota_counts(stream), "quota", "complete")
    assert [(r.requests, r.chars) for r in got.collect()] == [(60, 600)]
    got = run(spark, windows.session_counts(stream), "sessions", "complete")
    assert got.count() == 30


def test_incidents(spark, tmp_path):
    source = tmp_path / "in"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("api", at(0), True), ("api", at(1), True), ("api", at(2), False), ("api", at(3), False), ("api", at(60), True), ("api", at(61), False), ("api", at(62), False), ("api", at(600), True)]
    spark.createDataFrame(rows, "component_id string, ts timestamp, failing boolean").write.parquet(str(source))
    stream = spark.readStream.schema("component_id string, ts timestamp, failing boolean").parquet(str(source))
    got = run(spark, windows.incident_states(stream), "incidents").orderBy("ts").collect()
    assert [(r.incident_no, r.status) for r in got] == [
        (1, "investigating"), (1, "identified"), (1, "monitoring"), (1, "resolved"),
        (1, "investigating"), (1, "monitoring"), (1, "resolved"), (2, "investigating"),
    ]


def test_event_lines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text('{"type":"result_chunk","data":{"cues":[{"id":1,"translation":"a"},{"id":2,"translation":"b"}]}}\n{"type":"result_chunk","data":{"cues":[{"id":1,"translation":"a"}]}}\n')
    got = run(spark, windows.latest_cues(spark.readStream.text(str(source))), "cues")
    assert sorted((r.id, r.translation) for r in got.collect()) == [(1, "a"), (2, "b")]


def test_upserts_count_each_batch_once(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    write = windows.upsert_batches(path, ["key"], "n")
    batch = lambda *rows: spark.createDataFrame(list(rows), "key string, n long")
    write(batch(("a", 1), ("a", 2), ("b", 5)), 0)
    write(batch(("a", 10), ("c", 1)), 1)
    write(batch(("a", 10), ("c", 1)), 1)  # comes again after a failure
    write(batch(("b", 1)), 2)
    assert sorted(map(tuple, windows.upserted(spark, path).collect())) == [("a", 13), ("b", 6), ("c", 1)]


def test_upserts_from_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n long").repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema("key string, n long").option("maxFilesPerTrigger", 1).parquet(str(source))
    path = f"file://{tmp_path}/table"
    q = stream.writeStream.foreachBatch(windows.upsert_batches(path, ["key"], "n")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, windows.upserted(spark, path).collect())) == [("a", 3), ("b", 3)]
