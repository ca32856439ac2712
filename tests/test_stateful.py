"""Folds with state: streams give what batches give, and what has expired is gone."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import conversations, indexing, jobs
from tessera.sources.changes import ChangeStore
from tessera.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture
def put(spark, tmp_path):
    """Writes a batch of rows for a stream to find, and runs the stream on it."""
    stateful.use_state_store(spark)

    def run(rows, make, mode="append", **trigger):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        out = []
        q = stream.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(**trigger or {"availableNow": True}).start()
        q.awaitTermination()
        return out

    return run


def test_job_states_are_those_of_the_batch(spark, tmp_path):
    """Parts of jobs in any order, repeated events and a restart leave the states of the whole log."""
    from tessera.plans.flows import _job_log

    log = _job_log(spark, SF).withColumn("at", F.col("at").cast("timestamp"))
    log = log.join(log.select("job_id").distinct().orderBy("job_id").limit(25), "job_id", "left_semi").select(*log.columns).persist()
    states = ChangeStore(spark, str(tmp_path / "states"), ["job_id"], ["job_id"], 2)
    for n in range(3):
        log.where(f"event_id % 3 = {n} or event_id % 7 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stateful.keep_job_states(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), states, str(tmp_path / "cp"), late="3650 days").awaitTermination()
    want = jobs.state(log)
    got = states.read().select(*want.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 10


def test_late_events_and_forgotten_jobs(spark, put):
    schema = "job_id long, event_id long, at timestamp, code string, value long"
    rows = lambda *r: spark.createDataFrame([(j, e, None, c, v) for j, e, _, c, v in r], schema).withColumn("at", F.element_at(F.array(*[F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp") for h in range(24)]), F.element_at(F.create_map(*[F.lit(x) for _, e, h, _, _ in r for x in (e, h + 1)]), F.col("event_id"))))
    make = lambda s: stateful.job_states(s, late="1 hour", keep_ms=3 * 3_600_000)
    first = put(rows((1, 1, 0, "JOB_CREATED", None), (1, 2, 1, "JOB_STARTED", None)), make, "update")
    assert [(r.job_id, r.status) for r in first] == [(1, "RUNNING")]
    put(rows((2, 3, 8, "JOB_STARTED", None)), make, "update")
    later = put(rows((1, 4, 2, "JOB_FAILED", None), (2, 5, 9, "JOB_SUCCEEDED", None)), make, "update")
    assert [(r.job_id, r.status, r.duration_ms) for r in later] == [(2, "SUCCEEDED", 3_600_000)]  # hour 2 is behind the watermark
    again = put(rows((1, 6, 10, "CHUNKED", 5)), make, "update")
    assert [(r.job_id, r.status, r.chunk_count, r.started_at) for r in again] == [(1, None, 5, None)]  # job 1 was forgotten


def test_memories_are_those_of_the_batch(spark, put):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    events = [(1, 1, 0, "a"), (1, 2, 5, "b"), (1, 3, 6, None), (2, 4, 6, None), (1, 5, 14, None), (1, 6, 23, None), (1, 7, 24, "c"), (1, 8, 25, "d"), (1, 9, 26, None), (1, 10, 36, None), (1, 11, 46, None)]
    df = spark.createDataFrame([(c, s, at(m), x) for c, s, m, x in events], "conv_id long, seq long, at string, message string").withColumn("at", F.col("at").cast("timestamp"))
    want = {(r.conv_id, r.seq): r.messages for r in conversations.memory_reads(df, 600, 2).collect()}
    assert want == {(1, 3): ["a", "b"], (2, 4): [], (1, 5): ["a", "b"], (1, 6): ["a", "b"], (1, 9): ["c", "d"], (1, 10): [], (1, 11): []}
    make = lambda s: stateful.memories(s, 600_000, 2)
    got = {}
    for low in (0, 6, 9):
        got |= {(r.conv_id, r.seq): list(r.messages) for r in put(df.where(f"seq > {low} and seq <= {low + (6 if low == 0 else 3)}"), make)}
    assert got == want


def test_a_text_is_embedded_once_while_it_is_remembered(spark, put):
    ttl = 20
    make = lambda s: stateful.embedded(s, lambda: indexing.hash_embedding(8), ttl_ms=1000 * ttl)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, text string")
    once = {"once": True}
    first = put(rows((1, "x y"), (2, "x y"), (3, "z"), (4, None)), make, **once)
    assert {(r.id, r.cached) for r in first} == {(1, False), (2, False), (3, False)}
    vector = {r.id: list(r.embedding) for r in first}
    assert vector[1] == vector[2] != vector[3]
    time.sleep(ttl + 1)
    late = put(rows((7, "x y"), (8, "x y")), make, **once)
    assert {(r.id, r.cached) for r in late} == {(7, False), (8, False)} and list(late[0].embedding) == vector[1]
    soon = put(rows((9, "x y"), (10, "new")), make, **once)
    assert {(r.id, r.cached) for r in soon} == {(9, True), (10, False)}
