"""Structured Streaming forms of the event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import jobs
from tessera.sources.store import TableStore, upsert

ENVELOPE = "destination string, user_id string, type string, payload string, payload_type string, timestamp timestamp, trace_id string"


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def failure_windows(events: DataFrame, period: str = "1 hour", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Failures by user and period; state of periods older than the watermark is dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy("user_id", F.window(at, period).alias("w")).agg(F.count("*").alias("failures")).select("user_id", F.col("w.start").alias("period_start"), "failures")


def envelopes(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages parsed from JSON: good ones with their route, and the malformed ones as they came.

    A user message needs a user; anything else is for its topic.
    """
    parsed = raw.withColumn("e", F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE"}))
    ok = F.col("e").isNotNull() & F.col("e.destination").isNotNull() & F.coalesce(F.col("e.type").isin("TOPIC", "USER"), F.lit(False)) & ((F.col("e.type") == "TOPIC") | F.col("e.user_id").isNotNull())
    route = F.when(F.col("e.type") == "USER", F.concat(F.lit("/user/"), F.col("e.user_id"), F.col("e.destination"))).otherwise(F.col("e.destination"))
    return parsed.where(ok).select("e.*", route.alias("route")), parsed.where(~F.coalesce(ok, F.lit(False))).select(column)


def deliver(messages: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes routed messages, each batch to a folder of its own: a batch that is run again replaces its folder, so
    nothing is delivered twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("type").parquet(f"{sink}/batch={number}")

    writer = messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_state(log: DataFrame, folder: str, states: TableStore, checkpoint: str) -> StreamingQuery:
    """Keeps job states in a table. Each batch of log events becomes a part of the log in ``folder``, named by the
    batch's number, and the states of the jobs it touches are folded anew from all their events, with the fold that
    batch jobs use. A batch that runs again replaces its part and gives the same states."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        jobs_seen = spark.read.parquet(f"{folder}/batch={number}").select("job_id").distinct()
        touched = spark.read.schema(batch.schema).parquet(folder).join(jobs_seen, "job_id", "left_semi")
        new, before = jobs.state(touched.select(*batch.columns)), states.version()
        states.commit(upsert(states.read(), new, ["job_id"]) if before >= 0 else new, before)

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(messages: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Messages once by key within the watermark."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
