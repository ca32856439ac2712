"""Index jobs as folds of their log, and login and token events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events of a job's log and the status that each leads to.
STATUS = {"JOB_CREATED": "PENDING", "JOB_STARTED": "RUNNING", "JOB_SUCCEEDED": "SUCCEEDED", "JOB_WARNING": "WARNING", "JOB_FAILED": "FAILED", "JOB_CANCELLED": "CANCELLED", "RETRY_REQUESTED": "PENDING"}
TERMINAL = ("SUCCEEDED", "WARNING", "FAILED", "CANCELLED")


def visible(log: DataFrame) -> DataFrame:
    """Events that count: a job's events of one run end at its first cancellation; a retry begins a new run. Of several rows
    of one event the earliest counts, of those the one whose other columns come first."""
    order = Window.partitionBy("job_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.struct("at", *(c for c in log.columns if c not in ("at", "event_id")))).alias("_e")
    runs = log.groupBy("event_id").agg(first).select("event_id", "_e.*").select(*log.columns).withColumn("run", F.sum((F.col("code") == "RETRY_REQUESTED").cast("int")).over(order))
    before = Window.partitionBy("job_id", "run").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_off", F.max((F.col("code") == "JOB_CANCELLED").cast("int")).over(before)).where("coalesce(_off, 0) = 0").drop("_off")


def state(log: DataFrame) -> DataFrame:
    """One row per job: status, counts and times of its last run. log: job_id, event_id, at, code, value.

    A finished job with warnings has the status WARNING. All is one aggregation over the visible events.
    """
    rows = visible(log)
    last = rows.join(rows.groupBy("job_id").agg(F.max("run").alias("run")), ["job_id", "run"])
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    step = F.element_at(known, F.col("code"))
    when = F.struct("at", "event_id")
    count = lambda code, f: F.coalesce(f(F.when(F.col("code") == code, F.col("value"))), F.lit(0)).cast("long")
    folded = last.withColumn("step", step).groupBy("job_id").agg(
        F.max_by("step", F.when(F.col("step").isNotNull(), when)).alias("last_status"),
        count("CHUNKED", F.max).alias("chunk_count"),
        count("EMBEDDED", F.max).alias("embedded_count"),
        count("INDEXED", F.max).alias("indexed_count"),
        F.count(F.when(F.col("code") == "WARN", 1)).alias("warning_count"),
        F.min(F.when(F.col("step") == "RUNNING", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("step").isin(*TERMINAL), F.col("at"))).alias("finished_at"),
        F.max("run").alias("retries"),
    )
    status = F.when((F.col("last_status") == "SUCCEEDED") & (F.col("warning_count") > 0), "WARNING").otherwise(F.col("last_status"))
    took = F.greatest(F.lit(0), F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")))
    return folded.withColumns({"status": status, "duration_ms": F.when(status.isin(*TERMINAL), took)}).drop("last_status")


def failures_since(events: DataFrame, user: str | int, since: Column, user_col: str = "user_id", at: str = "ts") -> DataFrame:
    """Number of a user's failures since a time."""
    return events.where((F.col(user_col) == user) & (F.col(at) >= since)).agg(F.count("*").alias("failures"))


def failure_windows(events: DataFrame, period: str = "1 hour", user_col: str = "user_id", at: str = "ts") -> DataFrame:
    """Number of failures of each user in each period."""
    return events.groupBy(user_col, F.window(at, period).alias("w")).agg(F.count("*").alias("failures")).select(user_col, F.col("w.start").alias("period_start"), "failures")


def purged(events: DataFrame, cutoff: Column, at: str = "ts") -> DataFrame:
    """What a retention purge leaves."""
    return events.where(F.col(at) >= cutoff)


def active_token(tokens: DataFrame, user: str = "user_id", at: str = "created_at") -> DataFrame:
    """Each user's newest token that is active."""
    rows = tokens.where("active")
    return rows.groupBy(user).agg(F.max_by(F.struct(*rows.columns), F.struct(at, "token_id")).alias("t")).select("t.*")


def tally(results: DataFrame, ok: Column, group: list[str]) -> DataFrame:
    """Processed, succeeded and failed items of each group."""
    return results.groupBy(*group).agg(F.count("*").alias("processed"), F.count(F.when(ok, 1)).alias("succeeded"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("failed"))
