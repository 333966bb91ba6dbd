"""Series kept as Parquet under versions: appending, cutting, filling, rolling back, and keyed upserts.

A table is a folder of version folders, each written whole before a reader can see it; the newest complete one counts. A
height range is a partition, so an append or a reorganisation rewrites only what it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import newest

#: Heights of a partition.
SPAN = 10_000


class SeriesTable:
    """A table of rows by ``idx`` in ``path``, with a stamp for every write."""

    def __init__(self, spark: SparkSession, path: str, version: int = 1):
        self.spark, self.path, self.version = spark, path, version
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def stamps(self) -> list[int]:
        """Stamps of this version's complete writes, in order. Those of another version don't count, so all is computed anew."""
        jvm = self.spark._jvm
        if not self._fs.exists(self._at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at)]
        mine = [n for n in names if n.startswith(f"v{self.version}-") and self._fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("-")[1]) for n in mine)

    def _folder(self, stamp: int) -> str:
        return f"{self.path}/v{self.version}-{stamp}"

    def read(self, stamp: int | None = None) -> DataFrame | None:
        stamps = self.stamps()
        stamp = stamps[-1] if stamp is None and stamps else stamp
        return None if stamp is None else self.spark.read.parquet(self._folder(stamp))

    def write(self, df: DataFrame, stamp: int) -> None:
        if self.stamps() and stamp <= self.stamps()[-1]:
            raise ValueError("stamps only grow; roll back first")
        part = f"{self.path}/_tmp-{uuid.uuid4()}"
        df.withColumn("span", F.floor(F.col("idx") / SPAN)).repartition("span").sortWithinPartitions("idx").write.partitionBy("span").parquet(part)
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs.rename(p(part), p(self._folder(stamp)))

    def append(self, df: DataFrame, stamp: int) -> None:
        """Rows that go on where the table ends, without a gap; anything else fails."""
        old = self.read()
        next_ = 0 if old is None else (old.agg(F.max("idx")).first()[0] or -1) + 1
        seen = df.agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n")).first()
        if seen.n and (seen.a != next_ or seen.b - seen.a + 1 != seen.n):
            raise ValueError(f"rows {seen.a} to {seen.b} ({seen.n}) don't follow {next_ - 1}")
        self.write(df if old is None else old.drop("span").unionByName(df), stamp)

    def truncate(self, length: int, stamp: int) -> None:
        old = self.read()
        if old is not None:
            self.write(old.drop("span").filter(F.col("idx") < length), stamp)

    def rollback_before(self, stamp: int) -> None:
        """Undoes every write of ``stamp`` and later."""
        for s in self.stamps():
            if s >= stamp:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(s)), True)


def fill_to(df: DataFrame, length: int, value, column: str = "value") -> DataFrame:
    """All positions below ``length``; those that ``df`` lacks have ``value``."""
    return df.sparkSession.range(length).withColumnRenamed("id", "idx").join(df, "idx", "left").withColumn(column, F.coalesce(column, F.lit(value)))


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], order: str, dead: str) -> DataFrame:
    """``old`` with ``changes`` (in order of ``order``; ``dead`` rows delete) merged by key: the last one wins."""
    base = old.withColumn(order, F.lit(-1).cast(changes.schema[order].dataType)).withColumn(dead, F.lit(False))
    return newest(base.unionByName(changes), keys, order, dead).drop(order, dead)


def key_range(df: DataFrame, key: str, lo=None, hi=None) -> DataFrame:
    """Rows whose key is ``lo`` or above and below ``hi``, in order of the key."""
    df = df if lo is None else df.filter(F.col(key) >= F.lit(lo))
    return (df if hi is None else df.filter(F.col(key) < F.lit(hi))).orderBy(key)


def key_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.filter(F.startswith(F.col(key), F.lit(prefix))).orderBy(key)


def by_prefix(df: DataFrame, key: str, prefix: str, most: int = 100) -> tuple[DataFrame, bool]:
    """At most ``most`` rows of a key prefix, and whether there are more."""
    found = key_prefix(df, key, prefix).limit(most + 1)
    return found.limit(most), found.count() > most


def compact(df: DataFrame, keep: Column) -> DataFrame:
    """What a compaction with a filter leaves, as rows past their time to live go."""
    return df.filter(keep)


def raw_range(spark: SparkSession, path: str, position: int, size: int) -> DataFrame:
    """(path, bytes): ``size`` bytes at ``position`` of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring("content", F.lit(position + 1), F.lit(size)).alias("bytes"))
