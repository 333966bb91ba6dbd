"""Unconfirmed transactions: what changed between two snapshots, clusters and their order, blocks to come, and fees.

A snapshot is (txid, fee, vsize, parents array, spends array of "txid:vout").
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lineage import cut
from ..operators.relatives import clustered, one_by_one, together

MAX_BLOCK, BLOCKS, MOST_IN_CLUSTER = 1_000_000, 8, 64
RETENTION = 3600


def diff(before: DataFrame, after: DataFrame, buried: DataFrame) -> DataFrame:
    """(txid, change, by): fresh and revived additions, replaced (``by`` the first fresh addition that spends one of its outputs'
    inputs) and vanished removals. ``buried``: txids removed earlier."""
    added = after.join(before.select("txid"), "txid", "left_anti").join(buried.select("txid").distinct().withColumn("_known", F.lit(True)), "txid", "left")
    added = added.withColumn("change", F.when(F.col("_known"), "revived").otherwise("fresh"))
    removed = before.join(after.select("txid"), "txid", "left_anti")
    spends = added.filter("change = 'fresh'").select(F.col("txid").alias("_by"), F.explode("spends").alias("_out"))
    hits = removed.select("txid", F.posexplode("spends").alias("_at", "_out")).join(spends, "_out").groupBy("txid").agg(F.min_by("_by", F.struct("_at", "_by")).alias("by"))
    gone = removed.join(hits, "txid", "left").select("txid", F.when(F.col("by").isNull(), "vanished").otherwise("replaced").alias("change"), "by")
    return added.select("txid", "change", F.lit(None).cast("string").alias("by")).unionByName(gone)


def exhume(graveyard: DataFrame, now: int) -> DataFrame:
    """What the graveyard (txid, at, ...) still holds."""
    return graveyard.filter(F.col("at") > now - RETENTION)


def replacement_roots(replaced: DataFrame) -> DataFrame:
    """(txid, root): the last replacement of each replaced transaction, by pointer jumping over (txid, by) until none moves.

    A chain of n links takes about log2 n rounds; if pointers still move after that, some replace each other in a circle, which fails.
    """
    links = cut(replaced.select("txid", F.col("by").alias("root")))
    for _ in range(links.count().bit_length() + 1):
        far = links.select(F.col("txid").alias("root"), F.col("root").alias("_far"))
        jumped = cut(links.join(far, "root", "left").select("txid", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")))
        links = jumped.select("txid", "root")
        if jumped.filter("_moved").isEmpty():
            return links
    raise ValueError("transactions replace each other in a circle")


def clusters(snapshot: DataFrame) -> DataFrame:
    """(txid, cluster): the smallest txid linked through parents."""
    return clustered(snapshot.select("txid", "parents")).select("txid", "cluster")


def order_cluster(ids: list[str], fees: list[int], sizes: list[int], parents: list[list[str]]) -> list[tuple[str, int, float]]:
    """(txid, chunk, rate) of a cluster: again and again, of all transactions with their unplaced ancestors, the set of the highest
    fee rate (ties: the smaller txid). A later chunk never has a higher rate than an earlier one.

    Sets are bit masks; a placed set's fees and sizes are taken from each transaction that had it among its ancestors, which is
    quadratic in the cluster at most.
    """
    at = {t: i for i, t in enumerate(ids)}
    direct = [[at[p] for p in ps if p in at] for ps in parents]
    above: list[int] = [0] * len(ids)
    done = [False] * len(ids)
    for first in range(len(ids)):
        todo = [first]
        while todo:
            i = todo[-1]
            waits = [] if done[i] else [p for p in direct[i] if not done[p]]
            if waits:
                todo += waits
                continue
            if not done[i]:
                above[i], done[i] = 1 << i, True
                for p in direct[i]:
                    above[i] |= above[p]
            todo.pop()

    def members(mask: int) -> list[int]:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out

    fee = [sum(fees[j] for j in members(m)) for m in above]
    size = [sum(sizes[j] for j in members(m)) for m in above]
    left, out, chunk, least = set(range(len(ids))), [], 0, math.inf
    while left:
        best = min(left, key=lambda i: (-fee[i] / size[i], ids[i]))
        placed, least = above[best], min(least, fee[best] / size[best])
        out += [(ids[i], chunk, least) for i in sorted(members(placed), key=lambda i: (above[i].bit_count(), ids[i]))]
        left.difference_update(members(placed))
        for i in left:
            if gone := above[i] & placed:
                for j in members(gone):
                    fee[i] -= fees[j]
                    size[i] -= sizes[j]
                above[i] ^= gone
        chunk += 1
    return out


def linearize(snapshot: DataFrame) -> DataFrame:
    """(cluster, txid, chunk, chunk_rate, vsize). Transactions without relatives are a chunk each, without Python; the others come
    sorted by cluster, and a task orders one cluster after the other. A cluster is handled whole, whatever its size; nodes let it grow
    to MOST_IN_CLUSTER."""
    rows = clustered(snapshot.select("txid", "fee", "vsize", "parents"))
    kind = rows.schema["vsize"].dataType
    size = to_arrow_type(kind)
    alone = rows.filter("not linked").select(F.col("txid").alias("cluster"), "txid", F.lit(0).alias("chunk"), (F.col("fee") / F.col("vsize")).alias("chunk_rate"), "vsize")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in one_by_one(batches):
            out: list[tuple] = []
            for own in some:
                sizes = dict(zip(own["txid"], own["vsize"], strict=True))
                out += [(own["cluster"][0], *x, sizes[x[0]]) for x in order_cluster(own["txid"], own["fee"], own["vsize"], [ps or [] for ps in own["parents"]])]
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), size)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "txid", "chunk", "chunk_rate", "vsize"])

    named = together(rows.filter("linked").select("cluster", "txid", "fee", "vsize", "parents"))
    return named.mapInArrow(run, f"cluster string, txid string, chunk int, chunk_rate double, vsize {kind.simpleString()}").unionByName(alone)


def pack_blocks(lines: DataFrame, sizes: DataFrame, most: int = MAX_BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """(txid, block): chunks by falling rate (ties: cluster, chunk) by cumulated size; the last block takes the rest.

    A chunk starts in the block in which the size before it falls. Sizes (of ``sizes``, unless ``lines`` have them) are summed for
    steps of a hundredth of the rate's logarithm first. Steps that begin in the last block are in it whole; chunks are put in order,
    a step a window, in the steps before only.
    """
    lines = lines if "vsize" in lines.columns else lines.join(sizes.select("txid", "vsize"), "txid")
    step = F.when(F.col("chunk_rate") > 0, F.floor(F.ln("chunk_rate") * 100)).otherwise(-(1 << 40))
    lines = cut(lines.select("cluster", "txid", "chunk", "chunk_rate", "vsize", step.alias("_step")))
    steps = lines.groupBy("_step").agg(F.sum("vsize").alias("s"))
    before = cut(steps.withColumn("_ahead", F.coalesce(F.sum("s").over(W.partitionBy().orderBy(F.desc("_step")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s"))  # some thousand steps
    lines = lines.join(F.broadcast(before), "_step")
    last = F.col("_ahead") >= most * (blocks - 1)
    chunks = lines.filter(~last).groupBy("cluster", "chunk", "chunk_rate", "_step", "_ahead").agg(F.sum("vsize").alias("size"))
    inside = W.partitionBy("_step").orderBy(F.desc("chunk_rate"), "cluster", "chunk").rowsBetween(W.unboundedPreceding, -1)
    placed = chunks.withColumn("_start", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    block = F.least(F.floor(F.col("_start") / most), F.lit(blocks - 1)).cast("int")
    early = lines.filter(~last).join(placed.select("cluster", "chunk", block.alias("block")), ["cluster", "chunk"])
    return early.select("txid", "block", "chunk_rate").unionByName(lines.filter(last).select("txid", F.lit(blocks - 1).cast("int").alias("block"), "chunk_rate"))


#: Fixed values of fee advice: the unit that rates are rounded to, what urgency adds to the first tier (the second gets half), the
#: least of those two tiers, and the sizes up to which a projected block says nothing and from which it counts in full.
UNIT, URGENCY, LEAST_FASTEST, LEAST_HALF_HOUR, EMPTY_SIZE, FULL_SIZE = 0.001, 0.5, 1.0, 0.5, 500_000, 950_000


def _up(rate: float) -> float:
    """A rate rounded up to the unit; what is above a multiple by an error of floating point only stays."""
    return math.ceil(round(rate / UNIT, 6)) * UNIT


def recommend(blocks: list[tuple[float, int]], least: float = 1.0) -> dict[str, float]:
    """Fees by urgency from (median rate, size) of the projected blocks in order, and the least rate that is relayed.

    A block's rate is smoothed by the mean with that of the block before; a small last block counts in proportion to what it
    holds beyond EMPTY_SIZE. Each tier is at least the one that is less urgent, and economy at most twice the minimum.
    """
    floor = max(_up(least), UNIT)
    rates: list[float] = []
    for k in range(3):
        if k >= len(blocks):
            rates.append(floor)
            continue
        median, size = blocks[k]
        smooth = (median + rates[-1]) / 2 if rates else median
        if size <= EMPTY_SIZE or median < floor:
            rate = floor
        elif size <= FULL_SIZE and k + 1 == len(blocks):
            rate = round(smooth * (size - EMPTY_SIZE) / EMPTY_SIZE / UNIT) * UNIT
        else:
            rate = _up(smooth)
        rates.append(max(rate, floor))
    economy = min(max(rates[2], floor), 2 * floor)
    hour = max(rates[2], economy)
    half_hour = max(rates[1], hour)
    tiers = {
        "fastest": max(max(rates[0], half_hour) + URGENCY, LEAST_FASTEST), "half_hour": max(half_hour + URGENCY / 2, LEAST_HALF_HOUR), "hour": hour,
        "economy": economy, "minimum": floor,
    }
    return {k: round(v, 3) for k, v in tiers.items()}


#: Percentiles of a block's fee range: of the next block, and of those after it, whose extremes say little.
FEE_RANGE, LATER_RANGE = (0, 10, 25, 50, 75, 90, 100), (5, 10, 25, 50, 75, 90, 95)


def block_stats(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a projected block, from ``pack_blocks`` and (txid, fee, vsize): how many transactions, their fees and size, the median
    rate, and ``fee_range``: the rates at FEE_RANGE in block 0, at LATER_RANGE in the others.

    The rate at a percentile is the first, from the lowest, up to which the rounded share of the size lies.
    """
    per = placed.join(sizes.select("txid", "fee", "vsize"), "txid").groupBy("block", "chunk_rate").agg(F.count("*").alias("_n"), F.sum("fee").alias("_f"), F.sum("vsize").alias("_s"))
    w = W.partitionBy("block")
    run = per.withColumn("_upto", F.sum("_s").over(w.orderBy("chunk_rate"))).withColumn("_all", F.sum("_s").over(w))
    every = sorted({*FEE_RANGE, *LATER_RANGE})
    at = [F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") * F.lit(p / 100) + 0.5), F.col("chunk_rate"))).alias(f"_p{p}") for p in every]
    out = run.groupBy("block").agg(F.sum("_n").alias("n"), F.sum("_f").alias("fee"), F.max("_all").alias("size"), *at)
    fees = F.when(F.col("block") == 0, F.array(*(f"_p{p}" for p in FEE_RANGE))).otherwise(F.array(*(f"_p{p}" for p in LATER_RANGE)))
    return out.select("block", "n", "fee", "size", F.col("_p50").alias("median"), fees.alias("fee_range"))


def template_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(txid, state): retained, new, or removed between two block templates."""
    a, b = old.select("txid", F.lit(True).alias("_old")), new.select("txid", F.lit(True).alias("_new"))
    return a.join(b, "txid", "full").select("txid", F.when(F.col("_old") & F.col("_new"), "retained").when(F.col("_new"), "new").otherwise("removed").alias("state"))


def address_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(addr, txid, change): addresses that enter and leave the pool with a transaction; inputs are (addr, txid)."""
    enter = after.join(before, ["addr", "txid"], "left_anti").withColumn("change", F.lit("enter"))
    return enter.unionByName(before.join(after, ["addr", "txid"], "left_anti").withColumn("change", F.lit("leave")))
