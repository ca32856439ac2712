"""Pages, limits and listings. Every order ends in a unique key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import fresh_folder

DEFAULT_LIMIT, MAX_LIMIT = 20, 200


@dataclass(frozen=True)
class PageRequest:
    """Offset and limit, clamped: a limit of 0 or less is the default, none exceeds the maximum."""

    offset: int = 0
    limit: int = 0
    default: int = 50
    most: int = MAX_LIMIT

    @property
    def clamped(self) -> tuple[int, int]:
        return max(0, self.offset), min(self.most, self.limit if self.limit > 0 else self.default)


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    return min(most, limit if limit and limit > 0 else default)


def ordering(allowed: dict[str, Column], default: str, asked: str | None, descending: bool, tie: Column) -> list[Column]:
    """The asked order if it is allowed, else the default; nulls last, ties by the unique key."""
    by = {k.lower(): v for k, v in allowed.items()}
    c = by.get((asked or "").strip().lower(), allowed[default])
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), tie.asc()]


def page(df: DataFrame, order: list[Column], request: PageRequest) -> DataFrame:
    """The page's rows. Without an offset the plan is a distributed top-n."""
    offset, limit = request.clamped
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], request: PageRequest) -> DataFrame:
    """The page's rows with the number of all rows; the total is one aggregate row, so its join moves nothing."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, request).crossJoin(F.broadcast(total))  # one row


def page_with_more(df: DataFrame, order: list[Column], request: PageRequest) -> DataFrame:
    """The page's rows and whether more follow, by taking one row beyond it."""
    offset, limit = request.clamped
    taken = df.orderBy(*order).offset(offset).limit(limit + 1)
    w = Window.orderBy(*order)  # over limit + 1 rows
    numbered = taken.withColumn("n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
    return numbered.where(F.col("n") <= limit).drop("n")


class PageIndex:
    """Rows in order, written in ranges, with the number of rows of each: a deep page reads only the ranges that it lies
    in, found by adding up counts.

    The order must end in a unique key; rows of equal keys are in one range. The driver holds one number a range, which is
    a stated count, not one that follows the rows. What changes after the index was built isn't in its pages.
    """

    def __init__(self, df: DataFrame, order: list[Column], ranges: int = 64):
        self.order = order
        path = fresh_folder(df.sparkSession, "pages")
        df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        self.rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
        counts = self.rows.groupBy("_range").count().collect()  # one row a range
        self.ends, self.total = [], 0
        for r in sorted(counts, key=lambda r: r["_range"]):
            self.total += r["count"]
            self.ends.append((r["_range"], self.total - r["count"], self.total))

    def page(self, request: PageRequest) -> DataFrame:
        """The page's rows, by reading the ranges that meet it."""
        offset, limit = request.clamped
        met = [(n, low) for n, low, high in self.ends if low < offset + limit and high > offset]
        rows = self.rows.where(F.col("_range").isin([n for n, _ in met])).drop("_range")
        return rows.orderBy(*self.order).offset(offset - met[0][1]).limit(limit) if met else rows


def after_token(df: DataFrame, key: str, token: str | None, limit: int, prefix: str = "") -> DataFrame:
    """The next keys of a listing in order, from behind a continuation token."""
    rows = df.where(F.col(key).startswith(prefix)) if prefix else df
    return (rows.where(F.col(key) > F.lit(token)) if token is not None else rows).orderBy(key).limit(limit)


def newest(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each partition to n a group before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
