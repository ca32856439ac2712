"""Conversations: memory, truncation, forks, listings and streamed answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.paging import newest
from tessera.session import written


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    return newest(messages, ["conv_id"], [F.desc("turn")], n)


def truncated(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``active``: messages behind a conversation's cut (conv_id, at_turn) aren't."""
    joined = messages.join(cuts, "conv_id", "left")
    return joined.withColumn("active", F.col("at_turn").isNull() | (F.col("turn") <= F.col("at_turn"))).drop("at_turn")


def forked(messages: DataFrame, forks: DataFrame) -> DataFrame:
    """The messages of new conversations (new_id, conv_id, at_turn): those up to the turn, numbered anew, each with
    the message it comes from."""
    taken = messages.join(forks, "conv_id").where(F.col("turn") <= F.col("at_turn"))
    order = F.row_number().over(Window.partitionBy("new_id").orderBy("turn")) - 1
    return taken.select(F.col("new_id").alias("conv_id"), order.cast("long").alias("turn"), "role", "text", F.col("conv_id").alias("parent_conv_id"), F.col("turn").alias("forked_from_turn"))


def active_counts(messages: DataFrame) -> DataFrame:
    """Number of each conversation's active messages."""
    return messages.groupBy("conv_id").agg(F.count(F.when(F.col("active"), 1)).alias("message_count"))


def listed(conversations: DataFrame, owner: str | None, limit: int, most: int = 100) -> DataFrame:
    """An owner's conversations that aren't deleted, newest first."""
    rows = conversations.where("status <> 'DELETED'")
    rows = rows if owner is None else rows.where(F.col("owner_id") == owner)
    return rows.orderBy(F.desc("last_updated_at"), "conv_id").limit(min(most, max(1, limit)))


def listed_messages(messages: DataFrame, limit: int, most: int = 500) -> DataFrame:
    """The first active messages of each conversation, oldest first."""
    return newest(messages.where("active"), ["conv_id"], [F.asc("turn")], min(most, max(1, limit)))


def ancestry(conversations: DataFrame) -> DataFrame:
    """conv_id, root and depth in the fork tree of every conversation; one whose parent isn't there is a root.
    Conversations that are in a cycle, or come from one, have no root and no depth.

    Each round doubles how far a conversation looks up, so there are about log2 of the largest depth; a round is
    written to the shared folder and the driver gets the number of conversations that still look up.
    """
    rows = conversations.select("conv_id", F.col("parent_conv_id").alias("up"))
    there = rows.select(F.col("conv_id").alias("up"), F.lit(True).alias("there")).distinct()
    # merges at every size, as what is broadcast goes through the driver
    first = rows.join(there.hint("merge"), "up", "left").select("conv_id", F.when(F.col("there"), F.col("up")).alias("up"))
    now = written(first.select("conv_id", "up", F.when(F.col("up").isNull(), F.col("conv_id")).alias("root"), F.col("up").isNotNull().cast("int").alias("depth")), "ancestry")
    left, before = now.where("up is not null").count(), None
    while left and left != before:  # if a round finds no root, none of the others has one
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        met = now.where("up is not null").join(above.hint("merge"), "up").select("conv_id", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))
        now = written(now.where("up is null").unionByName(met), "ancestry")
        left, before = now.where("up is not null").count(), left
    return now.select("conv_id", "root", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def streamed_answers(events: DataFrame) -> DataFrame:
    """Answers of streamed events (stream_id, seq, kind, text): deltas in order; a stream with an error has none."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == "DELTA", F.struct("seq", "text"))))
    return (
        events.groupBy("stream_id")
        .agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("answer"), F.max((F.col("kind") == "ERROR").cast("int")).alias("failed"))
        .where("failed = 0")
        .drop("failed")
    )


def remembered(messages: DataFrame, now: Column, ttl_seconds: int, n: int, at: str = "ts", key: str = "conv_id", tie: Sequence[str] = ()) -> DataFrame:
    """What a memory with a time to live holds: the last n messages of conversations whose last message is recent."""
    last = messages.groupBy(key).agg(F.max(at).alias("_last")).where(F.col("_last") >= now - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")).select(key)
    return newest(messages.join(last, key, "left_semi"), [key], [F.desc(at), *map(F.desc, tie)], n)


def memory_reads(events: DataFrame, ttl_seconds: int, most: int) -> DataFrame:
    """What reads of conversations find: conv_id, seq, messages. ``events``: conv_id, seq, at, message, null for a read.

    A memory ends when nobody has written or read its conversation for ``ttl_seconds``, so events with no such pause between
    them are one life of it; of a life a read finds the last ``most`` messages before it.
    """
    order = Window.partitionBy("conv_id").orderBy("at", "seq")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    pause = F.coalesce(micros - F.lag(micros).over(order) >= ttl_seconds * 1_000_000, F.lit(False))
    lives = events.withColumn("_pause", pause.cast("int")).withColumn("_life", F.sum("_pause").over(order))
    life = Window.partitionBy("conv_id", "_life")
    written_ = F.count("message").over(life.orderBy("at", "seq"))
    # what is written after a read has a number of its own, so a range of numbers holds the messages before it
    found = F.collect_list("message").over(life.orderBy("_n").rangeBetween(1 - most, 0))
    return lives.withColumn("_n", written_).withColumn("messages", found).where("message is null").select("conv_id", "seq", "messages")
