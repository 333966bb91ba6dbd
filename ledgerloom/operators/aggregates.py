"""Horizontal, ragged (parent and children) and distribution aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERCENTILES = {"min": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}


def _some(columns: Sequence[Column]) -> None:
    if not columns:
        raise ValueError("at least one column is needed")


def sum_of(columns: Sequence[Column]) -> Column:
    _some(columns)
    return reduce(lambda a, b: a + b, columns)


def min_of(columns: Sequence[Column]) -> Column:
    _some(columns)
    return F.least(*columns) if len(columns) > 1 else columns[0]


def max_of(columns: Sequence[Column]) -> Column:
    _some(columns)
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def weighted_average_of(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Sum of weight x value over sum of weights, of (weight, value) pairs with a weight above 0; 0 without any."""
    _some(pairs)
    total = sum_of([F.when(w > 0, w).otherwise(F.lit(0)) for w, _ in pairs])
    mass = sum_of([F.when(w > 0, w * v).otherwise(F.lit(0)) for w, v in pairs])
    return F.when(total > 0, mass / total).otherwise(F.lit(0.0))


def per_parent(parents: DataFrame, children: DataFrame, parent: str, folds: dict[str, Column]) -> DataFrame:
    """``parents`` with aggregates of their children; what is null for a parent without children becomes 0."""
    found = children.groupBy(parent).agg(*(c.alias(n) for n, c in folds.items()))
    return parents.join(found, parent, "left").na.fill(0, list(folds))


def filtered_sum(value: Column, holds: Column) -> Column:
    return F.sum(F.when(holds, value).otherwise(F.lit(0)))


def filtered_count(holds: Column) -> Column:
    return F.count_if(holds)


def count_from_firsts(firsts: DataFrame, first: str, children: int, out: str = "n", idx: str = "idx", chunk: int = 100_000) -> DataFrame:
    """Children per parent from each parent's first child; the last parent's reach to the number of children."""
    from .ordered import in_rows

    ahead = firsts.withColumn("_back", -F.col(idx))  # the next row is one row back in the reversed index
    low = -(1 << 40)
    return in_rows(ahead.withColumn("_r", F.col("_back") - low), 1, lambda w: {out: F.coalesce(F.lag(first, 1).over(w), F.lit(children)) - F.col(first)}, None, "_r", chunk).drop("_r", "_back")


def first_per_bucket(df: DataFrame, bucket: str, buckets: DataFrame, idx: str = "idx") -> DataFrame:
    """Each bucket's first index; an empty bucket has that of the next that isn't, so that its length is 0.

    ``buckets``: all buckets, dense; there are few of them.
    """
    firsts = df.groupBy(bucket).agg(F.min(idx).alias("first"))
    after = W.partitionBy().orderBy(bucket).rowsBetween(0, W.unboundedFollowing)
    return buckets.join(firsts, bucket, "left").withColumn("first", F.first("first", ignorenulls=True).over(after))


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[round((n - 1) p)] of sorted values, halves rounded up; 0 of nothing."""
    return F.coalesce(F.get(values, F.floor((F.size(values) - 1) * F.lit(p) + 0.5).cast("int")), F.lit(0))


def rank_distribution(df: DataFrame, group: str, value: str, idx: str, skip: int = 0) -> DataFrame:
    """Per group the nearest-rank PERCENTILES of its values. With ``skip``, the first rows of a group (by ``idx``) and all values
    of 0 or less are left out; all are 0 where nothing is left."""
    rows = df.select(group, F.struct(F.col(idx).alias("i"), F.col(value).alias("v")).alias("x")).groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    kept = F.transform(F.slice("xs", skip + 1, F.greatest(F.size("xs"), F.lit(1))), lambda x: x["v"])
    kept = F.array_sort(F.filter(kept, lambda v: v > 0) if skip else kept)
    return rows.select(group, kept.alias("vs")).select(group, *(nearest_rank(F.col("vs"), p).alias(n) for n, p in PERCENTILES.items()))


def weighted_distribution(df: DataFrame, group: str, value: str, weight: str, percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """Per group, for each percentile, the first value whose cumulated weight reaches round(total x p); 0 of nothing."""
    merged = df.groupBy(group, value).agg(F.sum(weight).alias("w"))
    order = W.partitionBy(group).orderBy(value)
    run = merged.withColumn("cum", F.sum("w").over(order)).withColumn("total", F.sum("w").over(W.partitionBy(group)))
    return run.groupBy(group).agg(*(F.coalesce(F.min(F.when(F.col("cum") >= F.floor(F.col("total") * p + 0.5), F.col(value))), F.lit(0)).alias(n) for n, p in percentiles.items()))


def pooled_distribution(df: DataFrame, heights: DataFrame, height: str, value: str, blocks: int) -> DataFrame:
    """For each of ``heights``, the nearest-rank PERCENTILES over the values of that height and the ``blocks`` - 1 before it."""
    spread = df.select(F.explode(F.sequence(F.col(height), F.col(height) + blocks - 1)).alias(height), F.col(value).alias("v"))
    pooled = spread.join(heights.select(height), height).groupBy(height).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return pooled.select(height, *(nearest_rank(F.col("vs"), p).alias(n) for n, p in PERCENTILES.items()))


def bucket_means(df: DataFrame, ts: str, width: int, values: list[str]) -> DataFrame:
    """Means of integers over buckets of ``width`` seconds, halves rounded up."""
    mean = lambda c: F.floor((F.sum(c) + F.floor(F.count(c) / 2)) / F.count(c)).cast("long")
    return df.groupBy(F.floor(F.col(ts) / width).cast("long").alias("bucket")).agg(*(mean(v).alias(f"avg_{v}") for v in values))


def gini(df: DataFrame, wealth: str, count: str, by: list[str], order: str) -> DataFrame:
    """1 - 2 x the area under the Lorenz curve of bucketed wealth: ``order`` sorts buckets by wealth per head; 0 of nothing."""
    w = W.partitionBy(*by).orderBy(order)
    run = df.withColumn("cw", F.sum(wealth).over(w)).withColumn("tw", F.sum(wealth).over(W.partitionBy(*by))).withColumn("tc", F.sum(count).over(W.partitionBy(*by)))
    share = F.when(F.col("tw") > 0, F.col("cw") / F.col("tw")).otherwise(0.0)
    before = F.when(F.col("tw") > 0, (F.col("cw") - F.col(wealth)) / F.col("tw")).otherwise(0.0)
    area = F.sum(F.col(count) / F.col("tc") * (share + before) / 2)
    return run.groupBy(*by).agg(F.when(F.max("tw") > 0, 1 - 2 * area).otherwise(0.0).alias("gini"))


def ranking(df: DataFrame, group: str) -> DataFrame:
    """Groups by falling number of rows (ties by name) with ``rank`` and ``share``."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    all_ = W.partitionBy()
    return counts.withColumn("rank", F.row_number().over(all_.orderBy(F.desc("n"), group))).withColumn("share", F.col("n") / F.sum("n").over(all_))


