"""Queries over jobs, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import conversations, jobs, paging
from tessera.plans.registry import query
from tessera.session import scan
from tessera.sources.statements import StatementCatalog
from tessera.streaming import events


@query("SELECT count(*) AS failures FROM events WHERE user_id = 5 AND event_type = 'error' AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def login_failures_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", "user_id", "ts", "event_type").where("event_type = 'error'")
    return jobs.failures_since(rows, 5, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query("""SELECT user_id, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS period_start, count(*) AS failures FROM events
WHERE event_type = 'error' GROUP BY 1, 2""")
def login_failures_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", "user_id", "ts", "event_type").where("event_type = 'error'")
    return jobs.failure_windows(rows).withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd HH:mm"))


@query("SELECT count(*) AS left_over, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = jobs.purged(scan(spark, sf_dir, "events", "event_id", "ts"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return left.agg(F.count("*").alias("left_over"), F.min("event_id").alias("first_id"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS token_id FROM events WHERE event_type = 'signup' GROUP BY user_id""")
def latest_active_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = scan(spark, sf_dir, "events", "user_id", F.col("event_id").alias("token_id"), F.col("ts").alias("created_at"), (F.col("event_type") == "signup").alias("active"))
    return jobs.active_token(tokens).select("user_id", "token_id")


@query("SELECT event_type, count(*) AS processed, count(*) FILTER (value > 50) AS succeeded, count(*) FILTER (value IS NULL OR value <= 50) AS failed FROM events GROUP BY event_type")
def sync_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.tally(scan(spark, sf_dir, "events", "event_type", "value"), F.col("value") > 50, ["event_type"])


CODES = ("JOB_CREATED", "JOB_STARTED", "CHUNKED", "EMBEDDED", "INDEXED", "WARN", "JOB_SUCCEEDED", "JOB_CANCELLED", "RETRY_REQUESTED", "JOB_STARTED", "JOB_FAILED")


def _job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: a user's events of a day are a job's."""
    rows = scan(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    codes = F.array(*[F.lit(c) for c in CODES])
    job = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    return rows.select(job.alias("job_id"), "event_id", F.col("ts").alias("at"), F.element_at(codes, (F.col("event_id") % len(CODES) + 1).cast("int")).alias("code"), F.floor("value").alias("value"))


JOBS = f"""log AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS job_id, event_id, ts AS t, {list(CODES)}[CAST(event_id % {len(CODES)} + 1 AS INTEGER)] AS code, CAST(floor(value) AS BIGINT) AS amount FROM events),
runs AS (SELECT *, sum(CASE WHEN code = 'RETRY_REQUESTED' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t, event_id) AS run FROM log),
seen AS (SELECT *, coalesce(max(CASE WHEN code = 'JOB_CANCELLED' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, run ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  max(run) OVER (PARTITION BY job_id) AS last_run FROM runs),
steps AS (SELECT *, CASE code WHEN 'JOB_CREATED' THEN 'PENDING' WHEN 'JOB_STARTED' THEN 'RUNNING' WHEN 'JOB_SUCCEEDED' THEN 'SUCCEEDED' WHEN 'JOB_FAILED' THEN 'FAILED'
  WHEN 'JOB_CANCELLED' THEN 'CANCELLED' WHEN 'RETRY_REQUESTED' THEN 'PENDING' END AS step FROM seen WHERE gone = 0 AND run = last_run),
folded AS (SELECT job_id, arg_max(step, (t, event_id)) FILTER (step IS NOT NULL) AS last_status,
  CAST(coalesce(max(amount) FILTER (code = 'CHUNKED'), 0) AS BIGINT) AS chunk_count, count(*) FILTER (code = 'WARN') AS warning_count, CAST(max(run) AS BIGINT) AS retries FROM steps GROUP BY job_id),
states AS (SELECT *, CASE WHEN last_status = 'SUCCEEDED' AND warning_count > 0 THEN 'WARNING' ELSE last_status END AS status FROM folded)"""


@query(f"WITH {JOBS} SELECT job_id, status, chunk_count, warning_count, retries FROM states")
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.state(_job_log(spark, sf_dir)).select("job_id", "status", "chunk_count", "warning_count", "retries")


@query(f"""WITH {JOBS}, times AS (SELECT job_id, min(t) FILTER (step = 'RUNNING') AS began, max(t) FILTER (step IN ('SUCCEEDED', 'FAILED', 'CANCELLED')) AS ended FROM steps GROUP BY job_id)
SELECT job_id, CASE WHEN status IN ('SUCCEEDED', 'WARNING', 'FAILED', 'CANCELLED') THEN greatest(0::BIGINT, epoch_us(ended) // 1000 - epoch_us(began) // 1000) END AS duration_ms FROM states JOIN times USING (job_id)""")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.state(_job_log(spark, sf_dir)).select("job_id", "duration_ms")


@query(f"WITH {JOBS} SELECT job_id, status FROM states WHERE status = 'SUCCEEDED' OR status = 'WARNING' ORDER BY chunk_count DESC NULLS LAST, job_id LIMIT 50")
def job_list_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.state(_job_log(spark, sf_dir)).where(F.col("status").isin("SUCCEEDED", "WARNING"))
    allowed = {"chunkCount": F.col("chunk_count"), "createdAt": F.col("started_at")}
    return paging.page(rows, paging.ordering(allowed, "createdAt", "chunkcount", True, F.col("job_id")), paging.PageRequest()).select("job_id", "status")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def conv_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.last_messages(scan(spark, sf_dir, "conversations", "conv_id", "turn", "role"), 3)


CUTS = "SELECT conv_id, 2 AS at_turn FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 0"


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "conversations", "conv_id").distinct().where("conv_id % 3 = 0").withColumn("at_turn", F.lit(2))


@query(f"SELECT m.conv_id, m.turn, c.at_turn IS NULL OR m.turn <= c.at_turn AS active FROM conversations m LEFT JOIN ({CUTS}) c USING (conv_id)")
def conv_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.truncated(scan(spark, sf_dir, "conversations", "conv_id", "turn"), _cuts(spark, sf_dir))


@query(f"SELECT m.conv_id, count(*) FILTER (c.at_turn IS NULL OR m.turn <= c.at_turn) AS message_count FROM conversations m LEFT JOIN ({CUTS}) c USING (conv_id) GROUP BY m.conv_id")
def conv_active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.active_counts(conversations.truncated(scan(spark, sf_dir, "conversations", "conv_id", "turn"), _cuts(spark, sf_dir)))


@query(f"""SELECT m.conv_id + 1000000 AS conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn) - 1 AS turn, m.role, m.conv_id AS parent_conv_id, m.turn AS forked_from_turn
FROM conversations m JOIN ({CUTS}) c USING (conv_id) WHERE m.turn <= c.at_turn""")
def conv_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    forks = _cuts(spark, sf_dir).withColumn("new_id", F.col("conv_id") + 1000000)
    return conversations.forked(scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), forks).drop("text")


@query("""SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) FILTER (role <> 'user') AS answer FROM conversations
GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0""")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "ERROR").when(F.col("role") == "user", "USAGE").otherwise("DELTA")
    rows = scan(spark, sf_dir, "conversations", F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), "role", "text").withColumn("kind", kind)
    return conversations.streamed_answers(rows).withColumn("answer", F.when(F.col("answer") != "", F.col("answer")))


@query("SELECT c_custkey AS conv_id, c_custkey % 10 AS root, CAST(c_custkey // 10 AS INTEGER) AS depth FROM customer")
def conv_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "customer", F.col("c_custkey").alias("conv_id"))
    return conversations.ancestry(rows.withColumn("parent_conv_id", F.when(F.col("conv_id") >= 10, F.col("conv_id") - 10)))


@query("SELECT conv_id, owner_id FROM (SELECT DISTINCT conv_id, CAST(conv_id % 5 AS VARCHAR) AS owner_id, conv_id * 37 % 1000 AS changed FROM conversations WHERE conv_id % 7 > 0) WHERE owner_id = '1' ORDER BY changed DESC, conv_id LIMIT 100")
def conv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "conversations", "conv_id").distinct()
    owned = rows.select("conv_id", (F.col("conv_id") % 5).cast("string").alias("owner_id"), F.when(F.col("conv_id") % 7 == 0, "DELETED").otherwise("ACTIVE").alias("status"), (F.col("conv_id") * 37 % 1000).alias("last_updated_at"))
    return conversations.listed(owned, "1", 1000).select("conv_id", "owner_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 3 <> 1) WHERE n <= 2")
def conv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "conversations", "conv_id", "turn", "role").withColumn("active", F.col("turn") % 3 != 1)
    return conversations.listed_messages(rows, 2).drop("active")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
WHERE n <= 3 AND last >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7200 SECOND""")
def conv_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", "user_id", "event_id", "ts")
    return conversations.remembered(rows, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 7200, 3, key="user_id", tie=["event_id"]).select("user_id", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 > 0 THEN event_type || event_id END AS message FROM events),
p AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 86400000000 THEN 1 ELSE 0 END AS pause FROM e),
l AS (SELECT *, sum(pause) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM p),
n AS (SELECT *, count(message) OVER (PARTITION BY user_id, life ORDER BY ts, event_id) AS n FROM l)
SELECT r.user_id AS conv_id, r.event_id AS seq, coalesce((SELECT string_agg(w.message, ',' ORDER BY w.n) FROM n w WHERE w.user_id = r.user_id AND w.life = r.life AND w.message IS NOT NULL AND w.n > r.n - 4 AND w.n <= r.n), '') AS messages
FROM n r WHERE r.message IS NULL""")
def conv_memory_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that end a day after the last access: every third event of a user reads, the others write."""
    e = scan(spark, sf_dir, "events", F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), "event_type")
    asked = e.withColumn("message", F.when(F.col("seq") % 3 > 0, F.concat("event_type", F.col("seq").cast("string"))))
    return conversations.memory_reads(asked, 86400, 4).select("conv_id", "seq", F.array_join("messages", ",").alias("messages"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 'malformed' WHEN event_id % 5 = 2 THEN '/user/' || user_id || '/jobs' ELSE '/topic/' || event_type END AS route FROM events""")
def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    kind = F.col("event_id") % 5
    payload = F.col("event_id").cast("string").alias("payload")
    user = F.to_json(F.struct(F.lit("/jobs").alias("destination"), F.lit("USER").alias("type"), F.when(kind == 2, F.col("user_id").cast("string")).alias("user_id"), payload))
    topic = F.to_json(F.struct(F.concat(F.lit("/topic/"), "event_type").alias("destination"), F.lit("TOPIC").alias("type"), payload))
    good, bad = events.envelopes(rows.select(F.when(kind == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).when(kind < 3, user).otherwise(topic).alias("value")))
    return good.select(F.col("payload").cast("long").alias("event_id"), "route").unionByName(bad.select(F.regexp_extract("value", "([0-9]+)[^0-9]*$", 1).cast("long").alias("event_id"), F.lit("malformed").alias("route")))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' ORDER BY n_name LIMIT 3")
def named_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = StatementCatalog().load_xml('<sqlset namespace="geo"><sql-query id="byRegion">SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = :region ORDER BY n_name</sql-query></sqlset>')
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("nation", "region")}
    catalog.statements["geo.byRegion"] = catalog.statements["geo.byRegion"].format(**tables)
    return catalog.page(spark, "geo.byRegion", 3, region="EUROPE")
