"""Recurrences: exponential and Wilder smoothing, and state machines.

A smoothing is linear in its state, x[i] = a[i] x[i-1] + b[i], so a chunk of a series is one pair (a, b): chunks are folded
side by side in Arrow batches, their pairs are chained (a row a chunk), and each chunk starts from what came before. Chained
pairs differ from a fold row by row in the last bits, so chunks are folded from the doubles around such a start, too, and the
true one is picked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .ordered import CHUNK, running

#: Doubles on each side of a chunk's presumed start from which it is folded.
REACH = 32


def _around(x: float) -> np.ndarray:
    below = [math.nextafter(x, -math.inf, steps=k) for k in range(REACH, 0, -1)]
    return np.array([*below, x, *(math.nextafter(x, math.inf, steps=k) for k in range(1, REACH + 1))])


def _ends(starts: np.ndarray, a: list[float], b: list[float]) -> np.ndarray:
    """What the fold makes of each of ``starts``, which are in order: a single value as soon as the outer two have met, since
    every step keeps or turns their order."""
    x, i = starts, 0
    with np.errstate(all="ignore"):
        while i < len(a) and len(x) > 1:
            for s, t in zip(a[i : i + 256], b[i : i + 256], strict=True):
                x = s * x + t
            i += 256
            x = x[:1] if x[0] == x[-1] else x
    if len(x) > 1:
        return x
    end = float(x[0])
    for s, t in zip(a[i:], b[i:], strict=True):
        end = s * end + t
    return np.array([end])


def linear(df: DataFrame, a: Column, b: Column, out: str, by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``out`` of x[i] = a x[i-1] + b, from 0 before the first row, for each series: to the last bit as folded row by row.

    Each round folds chunks from the doubles around their presumed starts and follows the true start as far as it is among them;
    starts beyond are presumed anew from what the round found. A round settles one more chunk at least; two settle all, as a rule.
    """
    by = by or []
    keys = [*by, "_chunk"]
    work = df.withColumns({"_chunk": F.floor(F.col(idx) / chunk), "_a": a.cast("double"), "_b": b.cast("double")})
    work = cut(work)  # read several times, and recurrences are often chained
    steps = work.select(*keys, idx, "_a", "_b")

    def pair(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(idx)
        x, p = 0.0, 1.0
        for s, t in zip(own["_a"].tolist(), own["_b"].tolist(), strict=True):
            x, p = s * x + t, p * s
        return pd.DataFrame([[*own[keys].iloc[0], p, x]], columns=[*keys, "_p", "_x"])

    kinds = ", ".join(f"`{k}` {work.schema[k].dataType.simpleString()}" for k in keys)
    pairs = steps.groupBy(*keys).applyInPandas(pair, f"{kinds}, _p double, _x double")

    def chain(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_chunk")
        starts, x = [], 0.0
        for p, y in zip(own["_p"].tolist(), own["_x"].tolist(), strict=True):
            starts.append(x)
            x = p * x + y
        return own[[*keys, "_p"]].assign(_from=starts, _sure=[k == 0 for k in range(len(own))])

    def spread(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(idx)
        first = own.iloc[0]
        ends = _ends(np.array([first["_from"]]) if first["_sure"] else _around(first["_from"]), own["_a"].tolist(), own["_b"].tolist())
        return own[[*keys, "_p", "_from", "_sure"]].head(1).assign(_ends=[ends])

    def follow(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_chunk")
        starts, sures, x, sure = [], [], 0.0, True
        for p, start, one, ends in zip(own["_p"].tolist(), own["_from"].tolist(), own["_sure"].tolist(), own["_ends"], strict=True):
            starts.append(x)
            sures.append(sure)
            around = np.array([start]) if one else _around(start)
            found = np.flatnonzero((around == x) | (np.isnan(around) & math.isnan(x))) if sure else []
            if len(found):
                x = float(ends[found[0] if len(ends) > 1 else 0])
            else:
                x, sure = float(ends[len(ends) // 2]) + p * (x - start), False
        return own[[*keys, "_p"]].assign(_from=starts, _sure=sures)

    placed = f"{kinds}, _p double, _from double, _sure boolean"
    starts = cut(pairs.groupBy(*by).applyInPandas(chain, placed))  # a row a chunk
    while not starts.filter("not _sure").isEmpty():
        ends = steps.join(starts, keys).groupBy(*keys).applyInPandas(spread, f"{placed}, _ends array<double>")
        starts = cut(ends.groupBy(*by).applyInPandas(follow, placed))
    joined, names = work.join(starts.select(*keys, "_from"), keys), df.columns

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(idx)
        x, xs = float(own["_from"].iloc[0]), np.empty(len(own))
        for i, (s, t) in enumerate(zip(own["_a"].tolist(), own["_b"].tolist(), strict=True)):
            xs[i] = x = s * x + t
        return own[names].assign(**{out: xs})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return joined.groupBy(*keys).applyInPandas(fold, f"{schema}, `{out}` double")


def ema_rows(df: DataFrame, n: int, value: str, out: str, by: list[str] | None = None, idx: str = "idx", wilder: bool = False, chunk: int = CHUNK) -> DataFrame:
    """EMA with k = 2 / (n + 1), or, ``wilder``, k = 1 / n: the first ``n`` values are the running mean. The index starts at 0."""
    k = F.lit(1 / n if wilder else 2 / (n + 1))
    i = F.col(idx)
    early = i < n
    a = F.when(early, i / (i + 1)).otherwise(1 - k)
    b = F.when(early, F.col(value) / (i + 1)).otherwise(F.col(value) * k)
    return linear(df, a, b, out, by, idx, chunk)


def ema_time(df: DataFrame, start: str, value: str, out: str, by: list[str] | None = None, idx: str = "idx", wilder: bool = False, chunk: int = CHUNK) -> DataFrame:
    """EMA whose k follows the rows of each row's window, from ``start``: 2 / (span + 1), or 1 / span; from 0 before the first."""
    span = F.col(idx) - F.col(start) + 1
    k = 1 / span if wilder else F.lit(2.0) / (span + 1)
    return linear(df, 1 - k, F.col(value) * k, out, by, idx, chunk)


def latch(df: DataFrame, enter: Column, leave: Column, out: str, by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """A signal that turns on where ``enter`` holds and off where ``leave`` does (which wins where both do); off at first."""
    turn = F.when(leave, F.lit(False)).when(enter, F.lit(True))
    return running(df, {"_turn": ("last", turn)}, by, idx, chunk).withColumn(out, F.coalesce("_turn", F.lit(False))).drop("_turn")


def bins_ema(counts: DataFrame, alpha: float, n: int, idx: str = "idx") -> DataFrame:
    """(idx, bin, ema): histograms (idx, bin, n) weighed by alpha (1 - alpha)^age over each block and the ``n`` - 1 before it."""
    ages = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    aged = counts.withColumn("_age", ages)
    top = counts.agg(F.max(idx).alias("_top"))
    spread = aged.crossJoin(F.broadcast(top)).filter(F.col(idx) + F.col("_age") <= F.col("_top"))  # one row
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), "_age")
    return spread.groupBy((F.col(idx) + F.col("_age")).alias(idx), "bin").agg(F.sum(weight * F.col("n")).alias("ema"))
