"""Ledger state in closed form: every output is one row of its life, and every series a sum of its events.

A life: created_h, created_ts, spent_h, spent_ts (null while unspent), sats, price_in, price_out (cents), and whatever names
its cohorts. State by height is a running sum over per-height totals, so what is summed over time is heights, not outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scalars import floor_div
from .lookups import as_of
from .ordered import running

WIDE = "decimal(38,0)"
SATS = 100_000_000
HOUR, DAY = 3600, 86_400
#: Sats younger than this many hours count as short-term.
SHORT_TERM_HOURS = 3600
#: Lives of an address up to which its history is sorted in one task.
MANY = 1_000_000


def lives(outputs: DataFrame, inputs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lives of outputs (txout_idx, height, sats, and more) with their spending inputs (txout_idx, height) and blocks
    (height, ts, price)."""
    spends = inputs.filter("txout_idx is not null").select("txout_idx", F.col("height").alias("spent_h"))
    made = blocks.select(F.col("height").alias("created_h"), F.col("ts").alias("created_ts"), F.col("price").alias("price_in"))
    gone = blocks.select(F.col("height").alias("spent_h"), F.col("ts").alias("spent_ts"), F.col("price").alias("price_out"))
    return outputs.withColumnRenamed("height", "created_h").join(spends, "txout_idx", "left").join(made, "created_h").join(gone, "spent_h", "left")


def wide_product(*columns: Column) -> Column:
    """A product of non-negative integers in 128 bits."""
    out = columns[0].cast("decimal(19,0)")
    for c in columns[1:]:
        out = (out * c.cast("decimal(19,0)")).cast(WIDE)
    return out


def state_by_height(lives_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, height, supply, utxo_count, spent_count, realized_cap, capitalized_cap) at heights where something happened.

    realized_cap: sum of price_in x sats / 1e8 of what is unspent, cut off after summing; capitalized_cap likewise with the
    square of the price, as cents x cents.
    """
    by = by or []
    cap, cap2 = wide_product(F.col("price_in"), F.col("sats")), wide_product(F.col("price_in"), F.col("price_in"), F.col("sats"))
    one = F.lit(1).cast("long")
    base = [*by, F.col("sats"), cap.alias("cap"), cap2.alias("cap2")]
    born = lives_.select(F.col("created_h").alias("height"), F.lit(1).alias("sign"), *base)
    dead = lives_.filter("spent_h is not null").select(F.col("spent_h").alias("height"), F.lit(-1).alias("sign"), *base)
    sign = F.col("sign")
    deltas = born.unionByName(dead).groupBy(*by, "height").agg(
        F.sum(sign * F.col("sats")).alias("d_sats"), F.sum(sign * one).alias("d_n"), F.sum(F.when(sign < 0, one).otherwise(0)).alias("d_spent"),
        F.sum(F.when(sign > 0, F.col("cap")).otherwise(-F.col("cap"))).cast(WIDE).alias("d_cap"), F.sum(F.when(sign > 0, F.col("cap2")).otherwise(-F.col("cap2"))).cast(WIDE).alias("d_cap2"),
    )
    folds = {"supply": "d_sats", "utxo_count": "d_n", "spent_count": "d_spent", "_cap": "d_cap", "_cap2": "d_cap2"}
    run = running(deltas, {n: ("sum", F.col(c)) for n, c in folds.items()}, by, "height")
    cut_off = lambda c: floor_div(F.col(c), SATS).cast(WIDE)
    return run.select(*by, "height", "supply", "utxo_count", "spent_count", cut_off("_cap").alias("realized_cap"), cut_off("_cap2").alias("capitalized_cap"))


def realized(lives_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What each height's spends realised: profit, loss, transfer value, value destroyed (cents, cut off after summing), sats sent
    in profit (ties are profit) and in loss, and satdays destroyed."""
    spent = lives_.filter("spent_h is not null")
    now, then, sats = F.col("price_out"), F.col("price_in"), F.col("sats")
    cents = lambda c: floor_div(F.coalesce(F.sum(c), F.lit(0)).cast(WIDE), SATS).cast(WIDE)
    return spent.groupBy(*(by or []), F.col("spent_h").alias("height")).agg(
        cents(F.when(now > then, wide_product(now - then, sats))).alias("profit"), cents(F.when(now < then, wide_product(then - now, sats))).alias("loss"),
        cents(wide_product(now, sats)).alias("transfer_value"), cents(wide_product(then, sats)).alias("value_destroyed"),
        F.sum(F.when(now >= then, sats).otherwise(0)).alias("sent_in_profit"), F.sum(F.when(now < then, sats).otherwise(0)).alias("sent_in_loss"),
        (F.sum(wide_product(sats, F.col("spent_ts") - F.col("created_ts"))).cast("double") / DAY).alias("satdays_destroyed"),
    )


def peak_regret(lives_: DataFrame, prices: DataFrame) -> DataFrame:
    """Per height, (peak price while held - price at spending) x sats / 1e8, cut off after summing. ``prices``: idx, price."""
    from .windows import peaks

    spent = lives_.filter("spent_h is not null")
    held = spent.groupBy(F.col("created_h").alias("a"), F.col("spent_h").alias("b"), "price_out").agg(F.sum("sats").alias("sats"))
    regret = F.sum(wide_product(F.col("peak") - F.col("price_out"), F.col("sats"))).cast(WIDE)
    return peaks(prices, held, "price").groupBy(F.col("b").alias("height")).agg(floor_div(regret, SATS).cast(WIDE).alias("peak_regret"))


def age_supply(lives_: DataFrame, blocks: DataFrame, bands: list[tuple[str, int, int | None]]) -> DataFrame:
    """(cohort, height, supply) for bands of age (name, hours from, hours to): sats unspent at a height whose age is in the band.

    Lives are first summed by (created_h, spent_h), so the crossings of a band's edges are found for blocks, not outputs. An
    output enters a band at the first height whose time is its own plus the edge.
    """
    sums = lives_.groupBy("created_h", "created_ts", "spent_h").agg(F.sum("sats").alias("sats"))
    edges = F.explode(F.array(*(F.struct(F.lit(n).alias("cohort"), F.lit(lo * HOUR).cast("long").alias("lo"), F.lit(None if hi is None else hi * HOUR).cast("long").alias("hi")) for n, lo, hi in bands)))
    spread = sums.select("*", edges.alias("e")).select("created_h", "created_ts", "spent_h", "sats", "e.*")
    marks = sums.select("created_ts").distinct().select("created_ts", edges.alias("e"))
    starts = marks.select((F.col("created_ts") + F.col("e.lo")).alias("t")).unionByName(marks.filter("e.hi is not null").select((F.col("created_ts") + F.col("e.hi")).alias("t"))).distinct()
    reached = as_of(starts, blocks.select(F.col("ts").alias("t"), "height"), "t", F.col("height"), "at", forward=True)
    placed = spread.join(reached.select((F.col("t")).alias("_a"), F.col("at").alias("enter")), F.col("created_ts") + F.col("lo") == F.col("_a"), "left")
    placed = placed.join(reached.select((F.col("t")).alias("_b"), F.col("at").alias("cross")), F.col("created_ts") + F.col("hi") == F.col("_b"), "left")
    enter = F.greatest("enter", "created_h")
    leave = F.least("spent_h", "cross")
    lived = placed.filter(F.col("enter").isNotNull() & (leave.isNull() | (enter < leave)))
    events = lived.select("cohort", enter.alias("height"), "sats").unionByName(lived.filter(leave.isNotNull()).select("cohort", leave.alias("height"), (-F.col("sats")).alias("sats")))
    deltas = events.groupBy("cohort", "height").agg(F.sum("sats").alias("d"))
    return running(deltas, {"supply": ("sum", F.col("d"))}, ["cohort"], "height").select("cohort", "height", "supply")


def term(age_hours: Column) -> Column:
    return F.when(age_hours < SHORT_TERM_HOURS, "sth").otherwise("lth")


def parent_sums(parts: DataFrame, parents: DataFrame, values: list[str]) -> DataFrame:
    """Sums of cohorts into larger ones: ``parents`` maps cohort to parent, a cohort to as many as it is part of."""
    return parts.join(F.broadcast(parents), "cohort").groupBy("parent", "height").agg(*(F.sum(v).alias(v) for v in values))


# ------------------------------------------------------------------------------------------------------------ addresses


def address_state(lives_: DataFrame, addr: str) -> DataFrame:
    """Per address: balance, funded and spent outputs and sats, and whether it is funded, empty or reused."""
    spent = F.col("spent_h").isNotNull()
    out = lives_.groupBy(addr).agg(
        F.count("*").alias("funded_txos"), F.count_if(spent).alias("spent_txos"), F.sum("sats").alias("received"), F.sum(F.when(spent, F.col("sats")).otherwise(0)).alias("sent"),
        F.min("created_h").alias("first_h"),
    )
    return out.withColumns({"balance": F.col("received") - F.col("sent"), "is_empty": F.col("funded_txos") == F.col("spent_txos"), "reused": F.col("funded_txos") > 1})


def _events(lives_: DataFrame, addr: str) -> DataFrame:
    """(addr, height, received, sent) of lives that lie together by address, which makes no further shuffle."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = F.array(F.struct(F.col("created_h").alias("height"), one.alias("r"), none.alias("s")), F.struct(F.col("spent_h").alias("height"), none.alias("r"), one.alias("s")))
    each = lives_.select(addr, F.explode(both).alias("_e")).select(addr, "_e.*").filter("height is not null")
    return each.groupBy(addr, "height").agg(F.sum("r").alias("received"), F.sum("s").alias("sent"))


def address_events(lives_: DataFrame, addr: str, many: int = MANY) -> DataFrame:
    """(addr, height, received, sent, before, after, first_h): per address and height, with its unspent outputs before and after,
    and its first height so far.

    Lives are dealt by address once. Only addresses of more than ``many`` lives, of which there are few, are cut into chunks.
    """
    lives_ = lives_.select(addr, "created_h", "spent_h")
    large = cut(lives_.groupBy(addr).agg(F.count("*").alias("_n")).filter(F.col("_n") > many).select(addr))
    moved, funded = F.col("received") - F.col("sent"), F.when(F.col("received") > 0, F.col("height"))
    before = W.partitionBy(addr).orderBy("height").rowsBetween(W.unboundedPreceding, 0)
    if large.isEmpty():
        run = _events(lives_.repartition(addr), addr).withColumns({"after": F.sum(moved).over(before), "first_h": F.min(funded).over(before)})
    else:
        own = F.col(addr).eqNullSafe(F.col("_large"))
        named = F.broadcast(large.withColumnRenamed(addr, "_large"))  # a row for each ``many`` lives at most
        small = _events(lives_.join(named, own, "left_anti").repartition(addr), addr).withColumns({"after": F.sum(moved).over(before), "first_h": F.min(funded).over(before)})
        rest = running(cut(_events(lives_.join(named, own, "left_semi"), addr)).withColumn("_addr", F.struct(addr)), {"after": ("sum", moved), "first_h": ("min", funded)}, ["_addr"], "height").drop("_addr")
        run = small.unionByName(rest)
    return run.withColumn("before", F.col("after") - F.col("received") + F.col("sent"))


def address_activity(lives_: DataFrame, addr: str, many: int = MANY) -> DataFrame:
    """Per height, addresses that receive, send, do both, are active, come back with a balance after being empty, and are new."""
    events = address_events(lives_, addr, many)
    r, s = F.col("received") > 0, F.col("sent") > 0
    back = (F.col("before") == 0) & (F.col("first_h") < F.col("height")) & (F.col("after") > 0)
    holds = {"receiving": r, "sending": s, "bidirectional": r & s, "active": F.lit(True), "reactivated": back, "new": F.col("first_h") == F.col("height")}
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(holds.values())), F.lit(0))
    # Two numbers a row are shuffled, not partial counts that hardly any row of a task would share.
    by_height = events.select("height", bits.alias("_bits")).repartition("height")
    return by_height.groupBy("height").agg(*(F.count_if(F.col("_bits").bitwiseAND(1 << k) > 0).alias(n) for k, n in enumerate(holds)))


def address_counts(lives_: DataFrame, addr: str, many: int = MANY) -> DataFrame:
    """Running counts by height: addresses ever seen, funded, and empty."""
    events = address_events(lives_, addr, many)
    d_funded = (F.col("after") > 0).cast("int") - (F.col("before") > 0).cast("int")
    moved = events.select("height", d_funded.alias("_f"), F.coalesce(F.col("first_h") == F.col("height"), F.lit(False)).cast("int").alias("_t")).repartition("height")
    deltas = cut(moved.groupBy("height").agg(F.sum("_f").alias("d_funded"), F.sum("_t").alias("d_total")))  # read twice
    run = running(deltas, {"total": ("sum", F.col("d_total")), "funded": ("sum", F.col("d_funded"))}, None, "height")
    return run.select("height", "total", "funded", (F.col("total") - F.col("funded")).alias("empty"))


def reuse_events(lives_: DataFrame, addr: str, order: str) -> DataFrame:
    """Per height, outputs to an address that had one before."""
    nth = F.row_number().over(W.partitionBy(addr).orderBy(order))
    return lives_.withColumn("_n", nth).filter("_n > 1").groupBy(F.col("created_h").alias("height")).agg(F.count("*").alias("reuses"))


# ----------------------------------------------------------------------------------------------------------- cost basis


def inventory(lives_: DataFrame, height: int, by: list[str] | None = None) -> DataFrame:
    """(by, price, sats): what is unspent at a height, by the price it came in at."""
    alive = lives_.filter((F.col("created_h") <= height) & (F.col("spent_h").isNull() | (F.col("spent_h") > height)))
    return alive.groupBy(*(by or []), F.col("price_in").alias("price")).agg(F.sum("sats").alias("sats"))


def inventories(lives_: DataFrame, heights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, height, price, sats) at each of some snapshot heights (column ``height``): running sums of ± events per price, looked
    up at the snapshots, not a copy of the ledger per snapshot."""
    by = by or []
    born = lives_.select(*by, F.col("price_in").alias("price"), F.col("created_h").alias("h"), "sats")
    dead = lives_.filter("spent_h is not null").select(*by, F.col("price_in").alias("price"), F.col("spent_h").alias("h"), (-F.col("sats")).alias("sats"))
    snaps = F.broadcast(heights.agg(F.array_sort(F.collect_list("height")).alias("_snaps")))  # some thousands of days
    placed = born.unionByName(dead).crossJoin(snaps).withColumn("snap", F.array_min(F.filter("_snaps", lambda s: s >= F.col("h")))).filter("snap is not null")
    deltas = placed.groupBy(*by, "price", "snap").agg(F.sum("sats").alias("d"))
    spread = deltas.crossJoin(snaps).withColumn("height", F.explode(F.filter("_snaps", lambda s: s >= F.col("snap"))))
    return spread.groupBy(*by, "height", "price").agg(F.sum("d").alias("sats")).filter("sats > 0")


def basis_quantiles(inv: DataFrame, percents: list[int], by: list[str] | None = None, weight: str = "sats") -> DataFrame:
    """The first price whose cumulated weight exceeds max(total x p div 100 - 1, 0), for each p: ``p05`` and so on, with the
    lowest and the highest price. ``weight``: sats, or ``dollars`` for price x sats."""
    by = by or []
    w = F.col("sats").cast(WIDE) if weight == "sats" else wide_product(F.col("price"), F.col("sats"))
    order = W.partitionBy(*by).orderBy("price")
    run = inv.withColumn("_w", w).withColumn("_cum", F.sum("_w").over(order)).withColumn("_all", F.sum("_w").over(W.partitionBy(*by)))
    target = lambda p: F.greatest(F.floor(F.col("_all") * p / 100).cast(WIDE) - 1, F.lit(0).cast(WIDE))
    quantiles = [F.min(F.when(F.col("_cum") > target(p), F.col("price"))).alias(f"p{p:02d}") for p in percents]
    return run.groupBy(*by).agg(F.min("price").alias("lowest"), *quantiles, F.max("price").alias("highest"))


def density(inv: DataFrame, spot: Column, by: list[str] | None = None, width: int = 5) -> DataFrame:
    """The share of sats that came in within ``width`` percent of the spot price."""
    near = (F.col("price") * 100 >= spot * (100 - width)) & (F.col("price") * 100 <= spot * (100 + width))
    return inv.groupBy(*(by or [])).agg((F.sum(F.when(near, F.col("sats")).otherwise(0)) / F.sum("sats")).alias("density"))


def urpd(inv: DataFrame, spot: int, floor: Column, by: list[str] | None = None) -> DataFrame:
    """Per bucket of prices: sats, realised cap and unrealised profit or loss at ``spot`` (cents)."""
    value = wide_product(F.col("price"), F.col("sats"))
    grouped = inv.groupBy(*(by or []), floor.alias("bucket")).agg(F.sum("sats").alias("sats"), F.sum(value).cast(WIDE).alias("_v"))
    now = (F.lit(spot).cast("decimal(19,0)") * F.col("sats").cast("decimal(19,0)")).cast(WIDE)
    return grouped.select(*(by or []), "bucket", "sats", floor_div(F.col("_v"), SATS).cast("long").alias("realized_cap"), floor_div((now - F.col("_v")).cast(WIDE), SATS).cast("long").alias("unrealized"))


#: Percent of profit (above 0) and loss (below) at which profitability ranges part.
PROFIT_EDGES = (-90, -80, -70, -60, -50, -40, -30, -20, -10, 0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 500, 1000)


def profitability(inv: DataFrame, spot: int, by: list[str] | None = None) -> DataFrame:
    """Sats in each of 25 ranges of profit or loss at ``spot``; a range holds its lower edge."""
    gain = F.lit(spot) * 100 - F.col("price") * 100  # compared as integers: gain >= edge x price
    at = sum(((gain >= F.lit(e) * F.col("price")).cast("int") for e in PROFIT_EDGES), F.lit(0))
    return inv.groupBy(*(by or []), at.alias("range")).agg(F.sum("sats").alias("sats"))


def unrealized(inv: DataFrame, spot: Column, by: list[str] | None = None) -> DataFrame:
    """Supply and value in profit and loss at the spot price (ties are profit), and the unrealised profit and loss."""
    price, sats = F.col("price"), F.col("sats")
    up = spot >= price
    cents = lambda c: floor_div(F.coalesce(F.sum(c), F.lit(0)).cast(WIDE), SATS).cast(WIDE)
    return inv.groupBy(*(by or [])).agg(
        F.sum(F.when(up, sats).otherwise(0)).alias("supply_in_profit"), F.sum(F.when(~up, sats).otherwise(0)).alias("supply_in_loss"),
        cents(F.when(up, wide_product(price, sats))).alias("invested_in_profit"), cents(F.when(~up, wide_product(price, sats))).alias("invested_in_loss"),
        cents(F.when(up, wide_product(spot - price, sats))).alias("unrealized_profit"), cents(F.when(~up, wide_product(price - spot, sats))).alias("unrealized_loss"),
    )
