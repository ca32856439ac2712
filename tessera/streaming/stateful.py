"""Folds that keep their state between batches, with times to live: job states, conversation memories, embeddings.

Each is keyed (job, conversation, text), so state is spread by key and a batch costs what its own rows cost; nothing reads
the log again. State lies in RocksDB state stores, versioned with the stream's checkpoint: a batch that runs again finds
the state that it found before. Timers follow the watermark of event time (jobs, memories) or the clock (embeddings).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessera.operators import jobs
from tessera.sources.changes import ChangeStore

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_STATE = "job_id {}, chunk_count long, embedded_count long, indexed_count long, warning_count long, started_at timestamp, finished_at timestamp, retries long, status string, duration_ms long"


def use_state_store(spark: SparkSession) -> None:
    """The state store that these folds need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(at: pd.Timestamp) -> int:
    return at.value // 1000


def _stamp(micros: int | None) -> pd.Timestamp:
    return pd.NaT if micros is None else pd.Timestamp(micros * 1000)


def fold_job(events: list[tuple[int, object, str, int | None]]) -> dict:
    """The state of a job from its events (at in microseconds, event id, code, value): what ``jobs.state`` says of them."""
    rows, run, off = [], 0, False
    for e in sorted(events, key=lambda e: e[:2]):
        if e[2] == "RETRY_REQUESTED":
            rows, run, off = [], run + 1, False
        if not off:
            rows.append(e)
        off = off or e[2] == "JOB_CANCELLED"
    steps = [(at, jobs.STATUS[code]) for at, _, code, _ in rows if code in jobs.STATUS]
    most = lambda code: max((v for _, _, c, v in rows if c == code and v is not None), default=0)
    warned = sum(c == "WARN" for _, _, c, _ in rows)
    started = min((at for at, s in steps if s == "RUNNING"), default=None)
    finished = max((at for at, s in steps if s in jobs.TERMINAL), default=None)
    status = steps[-1][1] if steps else None
    status = "WARNING" if status == "SUCCEEDED" and warned else status
    took = max(0, finished // 1000 - started // 1000) if started is not None and finished is not None else 0
    return {
        "chunk_count": most("CHUNKED"), "embedded_count": most("EMBEDDED"), "indexed_count": most("INDEXED"), "warning_count": warned, "started_at": _stamp(started),
        "finished_at": _stamp(finished), "retries": run, "status": status, "duration_ms": took if status in jobs.TERMINAL else None,
    }


class _JobFold(StatefulProcessor):
    """Holds a job's events until ``keep_ms`` after the latest of them."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_id string", "at long, id long, code string, value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, event, code, value in zip(part["at"], part["event_id"], part["code"], part["value"], strict=True):
                new = (_micros(at), int(event), code, None if pd.isna(value) else int(value))
                old = self.events.getValue((str(event),)) if self.events.containsKey((str(event),)) else None
                # of several rows of an event the one that comes first by its columns counts, as in a batch
                if old is None or _first(new) < _first(tuple(old)):
                    self.events.updateValue((str(event),), new)
        held = [tuple(v) for v in self.events.values()]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(max(e[0] for e in held) // 1000 + self.keep_ms)
        yield pd.DataFrame([{"job_id": key[0], **fold_job(held)}]).astype({"duration_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def _first(event: tuple) -> tuple:
    at, _, code, value = event
    return at, code is not None, code or "", value is not None, value or 0


def job_states(log: DataFrame, late: str = "1 hour", keep_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """The state of each job that a batch brings events of (job_id, event_id, at, code, value), from all its events so far.
    Events that come ``late`` behind the latest, and jobs without events for ``keep_ms``, are forgotten; a job that is
    heard of again begins anew."""
    kind = log.schema["job_id"].dataType.simpleString()
    timed = log.select("job_id", "event_id", F.col("at").cast("timestamp").alias("at"), "code", F.col("value").cast("long").alias("value")).withWatermark("at", late)
    return timed.groupBy("job_id").transformWithStateInPandas(_JobFold(keep_ms), JOB_STATE.format(kind), "Update", "EventTime")


def keep_job_states(log: DataFrame, states: ChangeStore, checkpoint: str, **options) -> StreamingQuery:
    """Keeps job states in a store of changes: a batch writes the states that it changes, and the same ones if it runs
    again."""
    use_state_store(log.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        if states.version() < 0:
            states.create(batch)
        else:
            states.upsert(batch)

    return job_states(log, **options).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Memory(StatefulProcessor):
    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, messages array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, messages = self.held.get() if self.held.exists() else (None, [])
        messages, out = list(messages), []
        events = [(_micros(at), seq, message) for part in rows for at, seq, message in zip(part["at"], part["seq"], part["message"], strict=True)]
        for at, seq, message in sorted(events, key=lambda e: e[:2]):
            if last is not None and at - last >= self.ttl_ms * 1000:
                messages = []
            last = at if last is None else max(last, at)
            if message is None:
                out.append({"conv_id": key[0], "seq": seq, "messages": list(messages)})
            else:
                messages = (messages + [message])[-self.most :]
        self.held.update((last, messages))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(last // 1000 + self.ttl_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def memories(events: DataFrame, ttl_ms: int, most: int, late: str = "1 hour") -> DataFrame:
    """What reads of conversations find: conv_id, seq, messages. ``events``: conv_id, seq, at, message, null for a read. A
    conversation's memory holds the last ``most`` messages and ends when nobody has written or read it for ``ttl_ms``.
    Events of a batch are taken in order of time and seq; the batch form is ``conversations.memory_reads``."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("conv_id", "seq")}
    timed = events.select("conv_id", "seq", F.col("at").cast("timestamp").alias("at"), "message").withWatermark("at", late)
    return timed.groupBy("conv_id").transformWithStateInPandas(_Memory(ttl_ms, most), f"conv_id {kinds['conv_id']}, seq {kinds['seq']}, messages array<string>", "Append", "EventTime")


class _Cache(StatefulProcessor):
    def __init__(self, make: Callable, ttl_ms: int):
        self.make, self.ttl_ms = make, ttl_ms

    def init(self, handle) -> None:
        self.embed = self.make()
        self.vector = handle.getValueState("vector", "v array<float>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        known = self.vector.exists()
        vector = list(self.vector.get()[0]) if known else [float(x) for x in self.embed([parts["text"].iloc[0]])[0]]
        if not known:
            self.vector.update((vector,))
        yield pd.DataFrame({"id": parts["id"], "text": parts["text"], "embedding": [vector] * len(parts), "cached": known})

    def close(self) -> None:
        pass


def embedded(texts: DataFrame, make: Callable, ttl_ms: int = 600_000) -> DataFrame:
    """id, text, ``embedding`` and whether it was ``cached``: the model (made once a task by ``make``) sees a text once
    until ``ttl_ms`` after it last saw it. ``texts``: id, text; null texts are left out. As its times go by the clock, Spark
    runs batches for it as long as the stream runs; an ``availableNow`` trigger would not end."""
    kind = texts.schema["id"].dataType.simpleString()
    keyed = texts.where("text is not null").select("id", "text", F.sha2("text", 256).alias("_hash"))
    return keyed.groupBy("_hash").transformWithStateInPandas(_Cache(make, ttl_ms), f"id {kind}, text string, embedding array<float>, cached boolean", "Append", "ProcessingTime")
