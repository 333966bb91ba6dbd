"""Coarser grains of a series: last values, prices per period, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import bucket

#: Buckets are few, however long the series: windows over them run in one task.


def dense(buckets: DataFrame, name: str = "bucket") -> DataFrame:
    """All buckets from 0 to the last one that occurs."""
    return buckets.agg(F.max(name).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias(name))


def last_of(df: DataFrame, grain: str, values: list[str], idx: str = "idx", ts: str = "ts", from_: int | None = None) -> DataFrame:
    """(bucket, values): the last value of each period from bucket ``from_`` (by default the first) on; null in empty periods."""
    found = df.groupBy(bucket(F.col(ts), grain).alias("bucket")).agg(*(F.max_by(v, idx).alias(v) for v in values))
    span = found.agg((F.min("bucket") if from_ is None else F.lit(from_).cast("long")).alias("a"), F.max("bucket").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("bucket")).join(found, "bucket", "left")


def last_by_height(df: DataFrame, grain: str, values: list[str], idx: str = "idx") -> DataFrame:
    """The last value of each halving or difficulty epoch; the current one has the last so far."""
    return df.groupBy(bucket(F.col(idx), grain).alias("bucket")).agg(*(F.max_by(v, idx).alias(v) for v in values))


def ohlc(df: DataFrame, grain: str, price: str, idx: str = "idx", ts: str = "ts") -> DataFrame:
    """(bucket, open, high, low, close); a period without rows has the close before it in all four."""
    found = df.groupBy(bucket(F.col(ts), grain).alias("bucket")).agg(F.min_by(price, idx).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, idx).alias("close"))
    every = found.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.sequence("a", "b")).alias("bucket")).join(found, "bucket", "left")
    before = F.last("close", ignorenulls=True).over(W.partitionBy().orderBy("bucket"))
    filled = every.withColumn("_before", before)
    return filled.select("bucket", *(F.coalesce(c, "_before").alias(c) for c in ("open", "high", "low", "close")))


def since(df: DataFrame, value: str, at: Column, by: list[str] | None = None, idx: str = "idx") -> DataFrame:
    """``since``: a cumulative column minus its value at the last row where ``at`` doesn't hold yet (0 before any)."""
    base = df.filter(~at).groupBy(*(by or [])).agg(F.max_by(value, idx).alias("_base"))
    joined = df.join(base, by, "left") if by else df.crossJoin(F.broadcast(base))  # one row
    return joined.withColumn("since", F.when(at, F.col(value) - F.coalesce("_base", F.lit(0))).otherwise(F.lit(0))).drop("_base")
