"""Streams give what batches give over the same events."""

from pyspark.sql import functions as F

from tessera.operators import jobs
from tessera.streaming import events

SF = "/root/testdata/sf0.001"


def _drain(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_failure_windows(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), rows.schema)
    got = _drain(spark, events.failure_windows(stream), "complete", "failures")
    want = jobs.failure_windows(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_envelopes(spark, tmp_path):
    good = '{"destination":"/a","type":"TOPIC","payload":"p"}'
    user = '{"destination":"/b","type":"USER","user_id":"u","payload":"p"}'
    raw = spark.createDataFrame([(good,), (user,), ("broken",), ('{"destination":"/c","type":"USER"}',), (None,)], "value string")
    ok, bad = events.envelopes(raw)
    assert sorted(r.route for r in ok.collect()) == ["/a", "/user/u/b"] and bad.count() == 3
    raw.write.parquet(str(tmp_path / "in"))
    parsed, _ = events.envelopes(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")))
    for _ in range(2):
        events.deliver(parsed, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_job_states(spark, tmp_path):
    """Batches that each bring parts of jobs leave the states of the whole log; one that runs again changes nothing."""
    from tessera.plans.flows import _job_log
    from tessera.sources.store import TableStore

    log = _job_log(spark, SF).withColumn("at", F.col("at").cast("timestamp"))
    states = TableStore(spark, str(tmp_path / "states"), partition_by=())
    want = {tuple(r) for r in jobs.state(log).collect()}
    for n in range(3):
        log.where(f"event_id % 3 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.keep_state(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), states, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in states.read().select(*jobs.state(log).columns).collect()} == want
    events.keep_state(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), states, str(tmp_path / "cp-lost")).awaitTermination()
    assert {tuple(r) for r in states.read().select(*jobs.state(log).columns).collect()} == want


def test_late_failures_are_dropped_and_windows_close(spark, tmp_path):
    """In append mode a window is shown once the watermark has passed it, and what comes later than that is dropped."""
    row = lambda minute, user: (f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", user)
    batches = [[row(5, 1), row(10, 1)], [row(200, 1)], [row(20, 1), row(205, 1)], [row(500, 2)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "ts string, user_id int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.failure_windows(events.event_stream(spark, str(tmp_path / "in"), "ts timestamp, user_id int"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.user_id, str(r.period_start), r.failures) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "2024-01-01 00:00:00", 2), (1, "2024-01-01 03:00:00", 2)}


def test_messages_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "b")]
    spark.createDataFrame(rows, "at string, id string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = events.deduplicated(events.event_stream(spark, str(tmp_path / "in"), "at timestamp, id string"), "id", "at")
    assert sorted(r.id for r in _drain(spark, stream, "append", "once").collect()) == ["a", "b"]
