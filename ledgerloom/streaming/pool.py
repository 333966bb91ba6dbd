"""The pool of unconfirmed transactions over time: who comes, goes and comes back, from a stream of snapshots or from a table of them.

A snapshot is the rows (at timestamp, txid, ...) of what is in the pool at one moment; there is one ``every`` so many seconds. A
transaction that the next snapshot lacks has vanished at that moment. It is remembered for less than ``retention`` seconds more;
the pool forgets after each snapshot, so the first one after that still finds it, and a transaction that comes back until then is
revived. Later it's fresh again.

Both forms give the same rows (txid, at, change, body), change being fresh, revived or vanished and body the other columns as
JSON: ``changes`` over a table by windows, ``run_changes`` over a stream by the same windows, each batch of snapshots together with
a table of what is known from those before. That depends on rows and their times alone, not on how a stream is cut into batches, so
a stream that starts again gives what it would have given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds that a vanished transaction is remembered.
RETENTION = 3600
CHANGES = "txid string, at timestamp, change string, body string"
KNOWN = "txid string, at timestamp, body string, live boolean"


def _body(snapshots: DataFrame) -> DataFrame:
    """(txid, at, body); rows without an id or a time aren't of a snapshot."""
    others = [F.col(f"`{c}`") for c in snapshots.columns if c not in ("txid", "at")]
    return snapshots.filter("txid is not null and at is not null").select("txid", "at", F.to_json(F.struct(*others) if others else F.struct()).alias("body"))


def _later(at: Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), at)


def _steps(rows: DataFrame, every: int, retention: int, last: DataFrame) -> DataFrame:
    """Rows (txid, at, body, live) with ``_last`` (a row of ``last``) and ``_told``: the changes that each brings. ``live`` is null for
    rows of snapshots; for what was known before (at being when it was last seen) it says whether it was in the pool then."""
    w = W.partitionBy("txid").orderBy("at")
    near = rows.select("*", F.lag("at").over(w).alias("_before"), F.lead("at").over(w).alias("_after")).crossJoin(F.broadcast(last))  # one row
    known = _later(F.col("_before"), 2 * every + retention) > F.col("at")
    new = F.col("live").isNull() & (F.col("_before").isNull() | (_later(F.col("_before"), every) < F.col("at")))
    comes = F.when(new, F.struct("at", F.when(known, "revived").otherwise("fresh").alias("change")))
    gone = _later(F.col("at"), every)
    left = F.coalesce("live", F.lit(True)) & (F.col("_after").isNull() | (gone < F.col("_after"))) & (gone <= F.col("_last"))
    goes = F.when(left, F.struct(gone.alias("at"), F.lit("vanished").alias("change")))
    return near.withColumn("_told", F.array_compact(F.array(comes, goes)))


def _told(steps: DataFrame) -> DataFrame:
    return steps.select("txid", "body", F.explode("_told").alias("_c")).select("txid", "_c.at", "_c.change", "body")


def _once(rows: DataFrame) -> DataFrame:
    """Repeated rows count once. Dealt by txid alone, so that the windows by txid need no further shuffle."""
    return rows.repartition("txid").groupBy("txid", "at").agg(F.first("body").alias("body"))


def changes(snapshots: DataFrame, every: int, retention: int = RETENTION) -> DataFrame:
    """Changes (txid, at, change, body) up to the last snapshot of a table of them. Repeated rows count once."""
    rows = _once(_body(snapshots)).withColumn("live", F.lit(None).cast("boolean"))
    return _told(_steps(rows, every, retention, snapshots.agg(F.max("at").alias("_last"))))


def fold_batch(rows: DataFrame, known: DataFrame | None, every: int, retention: int = RETENTION) -> tuple[DataFrame, DataFrame]:
    """The changes that a batch of whole snapshots brings, and what is known after it, as (txid, at, body, live).

    ``known`` is what was known after the batch before. Rows no newer than its last snapshot are too late and don't count.
    """
    rows = _body(rows)
    if known is not None:
        seen = known.agg(F.max("at").alias("_seen"))
        rows = rows.crossJoin(F.broadcast(seen)).filter(F.col("_seen").isNull() | (F.col("at") > F.col("_seen"))).drop("_seen")  # one row
    every_row = _once(rows).withColumn("live", F.lit(None).cast("boolean"))
    last = rows.agg(F.max("at").alias("_last"))
    if known is not None:
        every_row = every_row.unionByName(known)
        last = last.crossJoin(F.broadcast(seen)).select(F.coalesce("_last", "_seen").alias("_last"))
    steps = _steps(every_row, every, retention, last)
    newest = steps.filter(F.col("_after").isNull() & (_later(F.col("at"), 2 * every + retention) > F.col("_last")))
    return _told(steps), newest.select("txid", "at", "body", (_later(F.col("at"), every) > F.col("_last")).alias("live"))


def run_changes(snapshots: DataFrame, every: int, to: str, checkpoint: str, retention: int = RETENTION) -> StreamingQuery:
    """Runs a stream over all that is there and stops. A batch holds whole snapshots, in order of time.

    What is known is a table beside the stream's marks, written anew by each batch from that of the batch before, so a batch is one
    join by txid. Each batch overwrites its own folder under ``to`` and never the table it reads, so one that runs again after a
    loss doesn't count twice.
    """
    spark = snapshots.sparkSession

    def batch(rows: DataFrame, n: int) -> None:
        known = spark.read.schema(KNOWN).parquet(f"{checkpoint}/known/{(n - 1) % 2}") if n else None
        found, after = fold_batch(rows, known, every, retention)
        found.write.mode("overwrite").parquet(f"{to}/batch={n}")
        after.write.mode("overwrite").parquet(f"{checkpoint}/known/{n % 2}")

    q = snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stored_changes(spark: SparkSession, to: str) -> DataFrame:
    return spark.read.schema(f"{CHANGES}, batch int").parquet(to).drop("batch")


def replaced(found: DataFrame) -> DataFrame:
    """``changes`` with ``by``: a transaction that vanishes when a fresh one spends one of its inputs (``spends`` of the body, an
    array of strings) is replaced by that of the first such input (of several fresh ones the smallest)."""
    rows = found.withColumn("_spends", F.from_json(F.get_json_object("body", "$.spends"), "array<string>"))
    new = rows.filter("change = 'fresh'").select("at", F.explode("_spends").alias("_out"), F.col("txid").alias("_by"))
    gone = rows.filter("change = 'vanished'").select("txid", "at", F.posexplode("_spends").alias("_nth", "_out"))
    by = gone.join(new, ["at", "_out"]).filter("_by <> txid").groupBy("txid", "at").agg(F.min_by("_by", F.struct("_nth", "_by")).alias("by")).withColumn("change", F.lit("vanished"))
    out = found.join(by, ["txid", "at", "change"], "left")
    return out.select("txid", "at", F.when(F.col("by").isNotNull(), "replaced").otherwise(F.col("change")).alias("change"), "body", "by")


def live_counts(found: DataFrame, arrays: list[str]) -> DataFrame:
    """(kind, bin, n): how often each bin of the body's ``arrays`` of numbers is in the pool, each change adding or taking its own.

    The same over a table and, in complete mode, over a stream of changes; bins that nobody holds any more have n = 0.
    """
    sign = F.when(F.col("change") == "vanished", -1).otherwise(1)
    bins = lambda a: F.transform(F.from_json(F.get_json_object("body", f"$.{a}"), "array<long>"), lambda b: F.struct(F.lit(a).alias("kind"), b.alias("bin")))
    every = F.concat(*(F.coalesce(bins(a), F.array().cast("array<struct<kind:string,bin:bigint>>")) for a in arrays))
    signed = found.select(sign.alias("_sign"), F.explode(every).alias("_b")).filter("_b.bin is not null")
    return signed.groupBy("_b.kind", "_b.bin").agg(F.sum("_sign").alias("n"))
