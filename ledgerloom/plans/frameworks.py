"""Series of whole-chain frameworks, as expressions over per-height inputs (idx order, doubles)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..operators import windows as Win
from ..operators.ordered import running


def cointime(rows: DataFrame) -> DataFrame:
    """From idx, created and destroyed (coinblocks), realized_cap, thermo_cap, market_cap, supply and price: liveliness,
    vaultedness, their ratio, the caps and prices of cointime, and AVIV."""
    r = running(rows, {"_c": ("sum", F.col("created")), "_d": ("sum", F.col("destroyed"))})
    r = r.withColumn("stored", F.col("_c") - F.col("_d")).withColumn("liveliness", S.ratio(F.col("_d"), F.col("_c"))).withColumn("vaultedness", 1 - F.col("liveliness"))
    live, vault = F.col("liveliness"), F.col("vaultedness")
    r = r.withColumns({
        "a2vr": S.ratio(live, vault), "investor_cap": F.greatest(F.col("realized_cap") - F.col("thermo_cap"), F.lit(0.0)), "vaulted_cap": S.ratio(F.col("realized_cap"), vault), "active_cap": F.col("realized_cap") * live,
        "cointime_price": S.ratio(F.col("price") * F.col("_d"), F.col("_c")), "vaulted_price": S.ratio(F.col("market_cap"), F.col("supply")) * vault,
    })
    return r.withColumn("aviv", S.ratio(F.col("market_cap") * live, F.col("investor_cap"))).drop("_c", "_d")


def reserve_risk(rows: DataFrame, seconds: int = 365 * 86_400) -> DataFrame:
    """From idx, ts, price and vocdd: hodl_bank sums price less the median of vocdd over a year, reserve_risk is price over it."""
    r = Win.rolling_time(rows, seconds, "vocdd", ["median"])
    r = running(r, {"hodl_bank": ("sum", F.col("price") - F.col("median"))})
    return r.withColumn("reserve_risk", S.ratio(F.col("price"), F.col("hodl_bank"))).drop("median")


def indicators(rows: DataFrame, seconds: int = 365 * 86_400) -> DataFrame:
    """From subsidy_usd, market_cap, transfer_volume, thermo_cap, cdd, supply, share_in_profit and volatility: Puell, NVT, thermo
    multiple, supply-adjusted CDD, and seller exhaustion."""
    r = Win.rolling_time(rows, seconds, "subsidy_usd", ["average"])
    return r.withColumns({
        "puell": S.ratio(F.col("subsidy_usd"), F.col("average")), "nvt": S.ratio(F.col("market_cap"), F.col("transfer_volume")), "thermo_multiple": S.ratio(F.col("market_cap"), F.col("thermo_cap")),
        "adjusted_cdd": S.ratio(F.col("cdd"), F.col("supply")), "seller_exhaustion": F.col("share_in_profit") * F.col("volatility"),
    }).drop("average")


def rhodl(band_1d_1w: Column, band_1y_18m: Column, band_18m_2y: Column) -> Column:
    return S.ratio(band_1d_1w, band_1y_18m + band_18m_2y)


def realized_metrics(rows: DataFrame, seconds: int) -> DataFrame:
    """From idx, ts, transfer_value, value_destroyed, profit, loss, realized_cap, supply (sats), price (cents), satdays_destroyed and
    volume (sats): SOPR, profit-to-loss ratio, sell-side risk, realised price, MVRV, NUPL and dormancy over a time window."""
    names = ("transfer_value", "value_destroyed", "profit", "loss", "satdays_destroyed", "volume")
    r = rows
    for n in names:
        r = Win.rolling_time(r, seconds, n, ["sum"]).withColumnRenamed("sum", f"_{n}")
    cap = F.col("price").cast("double") * F.col("supply") / S.SATS
    return r.withColumns({
        "sopr": S.ratio(F.col("_transfer_value"), F.col("_value_destroyed")), "profit_to_loss": S.ratio(F.col("_profit"), F.col("_loss")), "sell_side_risk": S.ratio(F.col("_profit") + F.col("_loss"), F.col("realized_cap")),
        "net_realized": F.col("profit") - F.col("loss"), "realized_price": S.ratio(F.col("realized_cap").cast("double") * S.SATS, F.col("supply")), "mvrv": S.ratio(cap, F.col("realized_cap")),
        "nupl": S.ratio(cap - F.col("realized_cap").cast("double"), cap), "dormancy": S.ratio(F.col("_satdays_destroyed"), F.col("_volume")),
    }).drop(*(f"_{n}" for n in names))


def supply_flow(rows: DataFrame, seconds: int = 365 * 86_400) -> DataFrame:
    """From idx, ts, supply (sats) and volume: inflation over the window (NaN from 50 bitcoin or less), velocity, stock to flow."""
    r = Win.rolling_change(rows, seconds, "supply")
    r = r.withColumn("inflation", F.when(F.col("lookback") <= 50 * S.SATS, F.lit(math.nan)).otherwise(S.divide(F.col("supply"), F.col("lookback")) - 1)).withColumn("stock_to_flow", S.ratio(F.col("supply"), F.col("change")))
    r = r.drop("lookback", "change", "rate", "ratio_change")
    return Win.rolling_time(r, seconds, "volume", ["sum"]).withColumn("velocity", S.ratio(F.col("sum"), F.col("supply"))).drop("sum")


def decay_fit(bands: DataFrame, by: list[str]) -> DataFrame:
    """The weighted log-linear decay of hazards by age: from age, hazard and weight per band, ln(hazard) = intercept + slope x age by
    weighted least squares over bands with a hazard above 0. Sums only, so it runs as one grouping."""
    y, x, w = F.ln("hazard"), F.col("age"), F.col("weight")
    f = bands.filter("hazard > 0 and weight > 0").groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"))
    slope = S.ratio(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    return f.withColumn("slope", slope).withColumn("intercept", S.ratio(F.col("wy") - F.col("slope") * F.col("wx"), F.col("w"))).select(*by, "slope", "intercept")


def mobility(exposure: Column) -> Column:
    return 1 - F.exp(-exposure)


def floor_price(inv: DataFrame, threshold: Column, by: list[str]) -> DataFrame:
    """(by, floor): the first price, from the lowest, above which at most ``threshold`` of all sats came in."""
    order = W.partitionBy(*by).orderBy("price")
    run = inv.withColumn("_cum", F.sum("sats").over(order)).withColumn("_all", F.sum("sats").over(W.partitionBy(*by)))
    left = (F.col("_all") - F.col("_cum")) / F.col("_all")
    return run.groupBy(*by).agg(F.min(F.when(left <= threshold, F.col("price"))).alias("floor"))


def expanding_quantile(daily: DataFrame, value: str, p: float, out: str, order: str, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """The interpolated quantile of all days before each day; null before ``least`` of them. Null and NaN values don't count.

    Rows are days, so a series is short; it is one pass over a list kept in order, and series run side by side.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        return own.assign(**{out: own[value].astype(float).expanding(max(least, 1)).quantile(p).shift(1)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in daily.schema) + f", `{out}` double"
    found = daily.groupBy(*(by or [])).applyInPandas(run, schema)
    return found.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


#: Fixed shares of all coins above a floor of which levels are told.
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def levels_above(inv: DataFrame, floors: DataFrame, by: list[str], shares: tuple[float, ...] = LEVELS) -> DataFrame:
    """(by, floor, level_10, ...): of the coins (by, price, sats) that came in at a floor (by, floor) or above, the first prices up to
    which at least a share of them did. A null floor, or no coins above, gives null levels."""
    kept = floors.join(inv, by, "left").filter((F.col("price") >= F.col("floor")) & (F.col("sats") > 0))
    w = W.partitionBy(*by)
    run = kept.groupBy(*by, "price").agg(F.sum("sats").alias("sats")).withColumn("_cum", F.sum("sats").over(w.orderBy("price"))).withColumn("_all", F.sum("sats").over(w))
    cols = [F.min(F.when(F.col("_cum") >= F.col("_all") * F.lit(p), F.col("price"))).alias(f"level_{round(100 * p)}") for p in shares]
    return floors.join(run.groupBy(*by).agg(*cols), by, "left")


#: Fixed values of rarity bands: blocks in which a weight doubles, the height from which it grows, the width of a bin and its top.
HALF_LIFE, GROWS_FROM, BAND_WIDTH, BAND_TOP = 210_000, 210_000, 0.001, 43.0
#: Quantiles of the five lower and five upper bands.
BANDS = {"p0_5": 0.005, "p1": 0.01, "p2": 0.02, "p5": 0.05, "p10": 0.10, "p90": 0.90, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p99_5": 0.995}


def decayed_bands(
    rows: DataFrame, value: str, quantiles: dict[str, float], by: list[str], half_life: int = HALF_LIFE, width: float = BAND_WIDTH, top: float = BAND_TOP, since: int = GROWS_FROM,
    idx: str = "idx", chunk: int = 50_000,
) -> DataFrame:
    """Quantiles of a ratio's past, each row included, with weights that double every ``half_life`` positions from ``since`` on: the
    lower bounds of bins of ``width``, up to ``top``. Null and NaN values don't count; without any before, quantiles are 0.

    Histograms add up: each chunk of positions sums its own, a fold over the chunks of each bin gives what a chunk begins with, and
    the rows of a chunk are folded onto that, all chunks side by side. A chunk's task holds its rows and one number a bin. Weights
    are against those at the chunk's start, so they stay small however long a series is.
    """
    n, base, chunk = int(top / width) + 1, list(dict.fromkeys(by)), min(chunk, 500 * half_life)
    age = lambda at: F.greatest(at - since, F.lit(0)) / F.lit(half_life)
    starts = lambda c: age(c * chunk)
    v = F.col(value).cast("double")
    bucket = F.least(F.greatest(F.floor(v / width + 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    kept = rows.withColumn("_chunk", F.floor(F.col(idx) / chunk)).withColumn("_b", F.when(v.isNotNull() & ~F.isnan(v), bucket))
    kept = cut(kept.withColumn("_w", F.pow(F.lit(2.0), age(F.col(idx)) - starts(F.col("_chunk")))))
    own = kept.filter("_b is not null").groupBy(*base, "_b", "_chunk").agg(F.sum("_w").alias("_w"))
    last = kept.groupBy(*base).agg(F.max("_chunk").alias("_last"))
    bins = own.groupBy(*base, "_b").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_w"))).alias("_own"))  # a chunk an entry

    def add(acc: Column, x: Column) -> Column:
        total = acc["sum"] * F.pow(F.lit(2.0), starts(acc["chunk"]) - starts(x["_chunk"])) + x["_w"]
        return F.struct(x["_chunk"].alias("chunk"), total.alias("sum"), F.concat(acc["sums"], F.array(F.struct(x["_chunk"].alias("chunk"), total.alias("sum")))).alias("sums"))

    none = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<chunk:bigint,sum:double>>").alias("sums"))
    sums = bins.withColumn("_sums", F.aggregate("_own", none, add, lambda acc: acc["sums"]))
    sums = sums.select(*base, "_b", "_sums", F.posexplode("_sums").alias("_nth", "_s")).join(last, base)
    until = F.least(F.coalesce(F.get("_sums", F.col("_nth") + 1)["chunk"], "_last"), F.col("_last"))
    held = sums.filter(F.col("_s.chunk") + 1 <= until).select(*base, "_b", "_s", F.explode(F.sequence(F.col("_s.chunk") + 1, until)).alias("_chunk"))
    # Columns of its own: what a checkpoint returns shares the ids of what went in, and ``kept`` has them, too.
    held = cut(held).select(*(F.col(c).alias(c) for c in base), F.col("_chunk").alias("_chunk"), F.col("_b").alias("_bin"), F.col("_s.sum").alias("_sum"), (starts(F.col("_s.chunk")) - starts(F.col("_chunk"))).alias("_power"))
    side, names, shares = int(n**0.5) + 1, list(quantiles), np.array(list(quantiles.values()))
    columns = rows.columns

    def fold(mine: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:  # a chunk without rows of its own
            return pd.DataFrame({c: pd.Series(dtype=object) for c in columns} | {q: pd.Series(dtype=float) for q in names})
        mine = mine.sort_values(idx)
        mass, scale = np.zeros(side * side), 0.0
        if not before.empty:  # against the newest of them, until a row of this chunk's own counts
            powers = before["_power"].to_numpy()
            scale = float(powers.max())
            mass[before["_bin"].to_numpy(np.int64)] = before["_sum"].to_numpy() * 2.0 ** (powers - scale)
        mass = mass.reshape(side, side)
        groups = mass.sum(1)
        out = np.zeros((len(mine), len(names)))
        for i, (b, w) in enumerate(zip(mine["_b"].to_numpy(float), mine["_w"].to_numpy(), strict=True)):
            if b == b:
                if scale:
                    mass *= 2.0**scale
                    groups *= 2.0**scale
                    scale = 0.0
                mass[int(b) // side, int(b) % side] += w
                groups[int(b) // side] += w
            upto = groups.cumsum()
            if upto[-1] > 0:
                want = np.nextafter(shares * upto[-1], 0)
                g = np.minimum(np.searchsorted(upto, want, "right"), side - 1)
                inner = (upto[g] - groups[g])[:, None] + mass[g].cumsum(1)
                out[i] = (g * side + np.minimum((inner <= want[:, None]).sum(1), side - 1)) * width
        return mine.drop(columns=["_chunk", "_b", "_w"]).assign(**dict(zip(names, out.T, strict=True)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", `{q}` double" for q in names)
    keys = [*base, "_chunk"]
    return kept.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(fold, schema)


def inner_percentile(lower: Column, upper: Column, percentile: int) -> Column:
    """A price between those of the 5th and 95th percentiles, even in its logarithm; in itself where one of them isn't positive."""
    at = (percentile - 5) / 90
    low, high = lower.cast("double"), upper.cast("double")
    both = F.when((low > 0) & (high > 0), F.exp(F.ln(low) + at * (F.ln(high) - F.ln(low)))).otherwise(low + at * (high - low))
    return F.floor(both + 0.5).cast("long")


def rarity_score(price: Column, lower: list[Column], upper: list[Column]) -> Column:
    """How many upper bands the price is above, less how many lower ones it's below."""
    count = lambda cs: sum((F.coalesce(c, F.lit(False)).cast("int") for c in cs), F.lit(0))
    return count([price > b for b in upper]) - count([price < b for b in lower])
