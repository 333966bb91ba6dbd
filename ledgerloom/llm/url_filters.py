"""URL filters as a sort-merge range join of reversed-host keys with a sweep that keeps a stack of nested rules.

A rule is a host, which stands for itself and all its subdomains, and a path prefix. With its labels reversed and each
followed by a dot (``www.example.net`` becomes ``net.example.www.``), a host's subdomains are exactly the keys that start
with its own key, so a rule's host is an interval of the sorted keys and any two intervals are nested or apart. The same
holds for path prefixes. One sweep over sorted keys and interval starts therefore needs, for each nesting depth, only the
interval opened last: together they are the stack, and an entry is active if the key starts with it.

The sweep runs twice, on distinct hosts and then on distinct (host interval, path) pairs, so a host that holds a third of
the pages costs one row in the first. Keys are dealt to partitions by range; each partition's window starts from the
stack that is open at its first key. Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` (grp long, key string; distinct) with ``open``, the ids of the intervals that hold the key, outermost first.

    ``intervals`` (id long, grp long, lo string; distinct in grp and lo): all keys of the group that start with ``lo``.
    Their number may be large; only their nesting depth, which for hosts is the number of labels, bounds the stack.
    """
    nested = (
        intervals.alias("a")
        .join(_prefixes(intervals).alias("b"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.lo") == F.col("b.lo")))
        .groupBy(F.col("b.id").alias("id"))
        .agg(F.count("*").cast("int").alias("depth"))
    )
    rules = cut(intervals.join(nested, "id").select("id", "grp", "lo", "depth"))
    deepest = rules.agg(F.max("depth")).first()[0] or 0
    events = points.select("grp", "key", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("id")).unionByName(
        rules.select("grp", F.col("lo").alias("key"), "depth", "id")
    )
    dealt = cut(events.repartitionByRange("grp", "key").withColumn("part", F.spark_partition_id()))
    # What is open where a partition begins: the rules that are a proper prefix of its first key, one row a partition.
    first = dealt.groupBy("part").agg(F.min(F.struct("grp", "key")).alias("at")).select("part", "at.grp", F.col("at.key").alias("head"))
    heads = first.select("part", "grp", "head", F.explode(_cuts("head")).alias("lo")).filter(F.col("lo") < F.col("head"))
    carried = rules.join(heads, ["grp", "lo"]).select("grp", F.col("lo").alias("key"), "depth", "id", "part")
    order = W.partitionBy("part").orderBy("grp", "key", F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    stack = [F.last(F.when(F.col("depth") == d, F.struct("grp", F.col("key").alias("lo"), "id")), ignorenulls=True).over(order) for d in range(1, deepest + 1)]
    swept = dealt.unionByName(carried).select("grp", "key", "depth", F.array(*stack).alias("stack") if stack else F.expr("array()").cast("array<struct<grp:bigint,lo:string,id:bigint>>").alias("stack"))
    return swept.filter(F.col("depth") == 0).select(
        "grp", "key", F.transform(F.filter("stack", lambda s: (s["grp"] == F.col("grp")) & F.startswith(F.col("key"), s["lo"])), lambda s: s["id"]).alias("open")
    )


def _prefixes(intervals: DataFrame) -> DataFrame:
    """Each interval with each prefix of its own ``lo``, itself included: rules x their length, before the self-join."""
    return intervals.select("id", "grp", F.explode(_cuts("lo")).alias("lo"))


def _cuts(column: str) -> Column:
    """All prefixes of a string, from the empty one to itself."""
    return F.transform(F.sequence(F.lit(0), F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Each page's ``host``, ``path``, the longest fitting ``rule`` (host and path; null if none fits) and ``verdict``.

    ``rules``: host, path, verdict. Of equally long fitting rules, that with the longer host wins; a rule given twice
    counts once and blocks if either does. Pages that no rule fits get ``default``. Null urls and urls without ``://`` have
    an empty host and path. Repeated pages stay repeated, null keys stay null, other columns are ignored; no pages or no
    rules give no rows or no rule.
    """
    listed = rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max(F.struct((F.col("verdict") == "block").alias("block"), "verdict"))["verdict"].alias("verdict")).filter(F.col("host").isNotNull())
    listed = listed.withColumn("lo", reversed_host(F.col("host")))
    hosts = cut(listed.select("lo").distinct().select(F.xxhash64("lo").alias("id"), F.lit(0).cast("long").alias("grp"), "lo"))
    paths = cut(listed.select(F.xxhash64("lo", "path").alias("id"), F.xxhash64("lo").alias("grp"), F.col("path").alias("lo"), "host", "verdict"))
    parsed = fresh(pages, key, url).select(F.col(key).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    on_hosts = sweep(parsed.select(F.lit(0).cast("long").alias("grp"), reversed_host(F.col("host")).alias("key")).distinct(), hosts)
    # The pages under some rule's host only: the others are settled.
    under = parsed.withColumn("key", reversed_host(F.col("host"))).join(on_hosts.filter(F.size("open") > 0).select("key", "open"), "key").select("host", "path", F.explode("open").alias("grp"))
    on_paths = sweep(under.select("grp", F.col("path").alias("key")).distinct(), paths.select("id", "grp", "lo"))
    rank = F.struct(F.length(F.concat("r.host", "r.lo")).alias("n"), F.length("r.host").alias("h"), F.concat("r.host", "r.lo").alias("rule"), F.col("r.verdict").alias("verdict"))
    fits = on_paths.select("grp", "key", F.explode("open").alias("id")).join(paths.drop("grp").alias("r"), "id")
    best_path = fits.groupBy("grp", F.col("key").alias("path")).agg(F.max(rank).alias("best"))
    best = under.distinct().join(best_path, ["grp", "path"]).groupBy("host", "path").agg(F.max("best").alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        F.col("page").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rules table from (verdict, host, path) triples; large ones come from a file."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")


def reference_verdict(rules: list[tuple[str, str, str]], host: str, path: str) -> tuple[str | None, str]:
    """For tests: the same by trying every rule."""
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return reduce(max, fits)[2:] if fits else (None, "allow")
