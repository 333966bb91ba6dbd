"""Joins and reads by position, key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import CHUNK


def aligned(frames: list[DataFrame], idx: str = "idx") -> DataFrame:
    """Series side by side; the shortest decides the length."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, idx)
    return out


def position(i: int, length: int) -> int:
    """A position from the end, as -1 is the last, to one from the start; held within 0 and the length."""
    return min(max(0, length + i), length) if i < 0 else min(i, length)


def span(df: DataFrame, start: int | None, end: int | None, idx: str = "idx") -> DataFrame:
    """Rows from ``start`` up to, without, ``end``; negative ones count from the end. Pushed down to the scan."""
    length = 0
    if (start or 0) < 0 or (end or 0) < 0:
        length = (df.agg(F.max(idx)).first()[0] or -1) + 1
    lo = position(start, length) if start is not None and start < 0 else start
    hi = position(end, length) if end is not None and end < 0 else end
    if lo is not None:
        df = df.filter(F.col(idx) >= lo)
    return df if hi is None else df.filter(F.col(idx) < max(hi, lo or 0))


def gather(df: DataFrame, wanted: DataFrame, idx: str = "idx") -> DataFrame:
    """The rows at the positions of ``wanted``, once for each time a position is wanted."""
    return wanted.select(idx).join(df, idx)


def spent_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with the output that each spends; coinbase inputs (null ``txout_idx``) spend none."""
    return inputs.join(outputs, "txout_idx", "left")


def spenders(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs with the input that spends each (``txin_idx``, null while unspent)."""
    return outputs.join(inputs.filter("txout_idx is not null").select("txout_idx", "txin_idx"), "txout_idx", "left")


def unspent(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    return outputs.join(inputs.filter("txout_idx is not null").select("txout_idx"), "txout_idx", "left_anti")


def as_of(points: DataFrame, rows: DataFrame, at: str, take: Column, out: str, forward: bool = False, width: int = CHUNK) -> DataFrame:
    """``points`` with the value of the last row of ``rows`` at or before each ``at`` (``forward``: of the first at or after).

    Both are dealt into chunks of ``width``; each chunk's edge value is carried over the chunks that follow, a row a chunk.
    """
    sign = -1 if forward else 1
    key = (F.col(at) * sign).alias("_k")
    events = rows.groupBy(key).agg((F.min(take) if forward else F.max(take)).alias("_v"))
    chunk = F.floor(F.col("_k") / width).alias("_chunk")
    known = events.select("_k", "_v", chunk)
    edges = known.groupBy("_chunk").agg(F.max_by("_v", "_k").alias("_edge"))
    marked = points.withColumn("_k", F.col(at) * sign).withColumn("_chunk", F.floor(F.col("_k") / width))
    chunks = marked.select("_chunk").distinct().join(edges, "_chunk", "full")
    carried = chunks.withColumn("_carry", F.last("_edge", ignorenulls=True).over(W.partitionBy().orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))).select("_chunk", "_carry")
    both = known.withColumn("_p", F.lit(None).cast(marked.select(F.struct(*points.columns)).schema[0].dataType)).unionByName(marked.select("_k", F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), "_chunk", F.struct(*points.columns).alias("_p")))
    order = W.partitionBy("_chunk").orderBy("_k", F.col("_p").isNotNull())
    seen = both.withColumn("_here", F.last("_v", ignorenulls=True).over(order)).filter("_p is not null").join(carried, "_chunk")
    return seen.select("_p.*", F.coalesce("_here", "_carry").alias(out))


def first_seen_ids(df: DataFrame, key: str, idx: str, out: str = "id") -> DataFrame:
    """Dense ids for keys in order of their first row; the keys of a batch of new rows go on from there."""
    from .ordered import running

    firsts = df.groupBy(key).agg(F.min(idx).alias("_first"))
    ids = running(firsts, {"_n": ("count", F.lit(1))}, None, "_first").select(key, (F.col("_n") - 1).alias(out))
    return df.join(ids, key)


def first_match(rows: DataFrame, text: str, names: DataFrame, exact: str | None = None, default: str = "unknown") -> DataFrame:
    """Rows with the ``name`` of the first of ``names`` (priority, tag, name, address) that fits: by address first, then by a tag
    that the text holds, else ``default``. ``names`` is a list of some hundreds."""
    by_address = names.filter("address is not null").groupBy(F.col("address").alias("_a")).agg(F.min_by("name", "priority").alias("_by_address"))
    tags = F.broadcast(names.filter("tag is not null").agg(F.array_sort(F.collect_list(F.struct("priority", "tag", "name"))).alias("_tags")))
    tagged = rows.crossJoin(tags).withColumn("_by_tag", F.get(F.filter("_tags", lambda t: F.contains(F.col(text), t["tag"])), F.lit(0))["name"]).drop("_tags")
    if exact is None:
        return tagged.withColumn("name", F.coalesce("_by_tag", F.lit(default))).drop("_by_tag")
    joined = tagged.join(F.broadcast(by_address), F.col(exact) == F.col("_a"), "left")
    return joined.withColumn("name", F.coalesce("_by_address", "_by_tag", F.lit(default))).drop("_a", "_by_address", "_by_tag")


def newest(rows: DataFrame, keys: list[str], seqno: str, dead: str | None = None) -> DataFrame:
    """The newest version of each key; a deleted key (``dead`` holds) is gone."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), seqno).alias("_r")).select("_r.*")
    return top.filter(~F.col(dead)) if dead else top


def resolve_prevouts(inputs: DataFrame, pending: DataFrame, confirmed: DataFrame, on: list[str], value: str) -> DataFrame:
    """Inputs with the value of the output they spend: of a pending parent, else of a confirmed one."""
    a = pending.select(*on, F.col(value).alias("_pending"))
    b = confirmed.select(*on, F.col(value).alias("_confirmed"))
    return inputs.join(a, on, "left").join(b, on, "left").withColumn(value, F.coalesce("_pending", "_confirmed")).drop("_pending", "_confirmed")


def cohort_of(rows: DataFrame, at: str, dimension: DataFrame) -> DataFrame:
    """Rows with each cohort (cohort, lo, hi; hi excluded, null open) of a small dimension that holds ``at``."""
    inside = (F.col(at) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(at) < F.col("hi")))
    return rows.join(F.broadcast(dimension.select("cohort", "lo", "hi")), inside).drop("lo", "hi")
