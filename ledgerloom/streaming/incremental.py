"""Series that grow by batches: recomputing from a height, reorganisations, and streams of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import SeriesTable


def replace_from(old: DataFrame, fresh: DataFrame, height: str = "idx") -> DataFrame:
    """``old`` with everything from ``fresh``'s lowest height on replaced by ``fresh``: a reorganisation."""
    low = fresh.agg(F.min(height).alias("_low"))
    kept = old.crossJoin(F.broadcast(low)).filter(F.col("_low").isNull() | (F.col(height) < F.col("_low"))).drop("_low")  # one row
    return kept.unionByName(fresh)


def fork_height(ours: DataFrame, theirs: DataFrame, height: str = "idx", hash_: str = "hash") -> DataFrame:
    """(fork): the lowest height at which two chains differ; null if they don't."""
    b = theirs.select(height, F.col(hash_).alias("_theirs"))
    return ours.join(b, height, "full").filter(~F.col(hash_).eqNullSafe(F.col("_theirs"))).agg(F.min(height).alias("fork"))


def continue_from(table: SeriesTable, source: DataFrame, compute: Callable[[DataFrame], DataFrame], back: int, stamp: int, safe: int | None = None) -> None:
    """Writes ``compute(source)`` for the positions the table lacks, reading ``back`` positions before them for its frames.

    ``safe``: positions from it on may still change and are computed again.
    """
    old = table.read()
    at = 0 if old is None else (old.agg(F.max("idx")).first()[0] or -1) + 1
    at = at if safe is None else min(at, safe)
    new = compute(source.filter(F.col("idx") >= at - back)).filter(F.col("idx") >= at)
    table.write(new if old is None else old.drop("span").filter(F.col("idx") < at).unionByName(new), stamp)


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per window of ``width`` and keys; events later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs a stream over all that is there, a batch at a time, and stops."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
