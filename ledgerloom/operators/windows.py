"""Rolling, cumulative and lookback operators.

A time window of a row ends at the row and starts at the first row that is less than ``seconds`` old. Rows of one second
come in order of their index, and a row's window doesn't hold later rows of its own second; a plain RANGE frame would.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scalars as S
from ..functions.lineage import cut
from .ordered import CHUNK, dealt_in_time, in_rows, running

#: Seconds of a stretch of time: windows longer than two take the whole stretches between their ends as a row each.
STRETCH = 21_600
#: Rows of a window up to which its quantiles come from a list kept in order.
SHORT = 16_384
QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def monotonic(df: DataFrame, ts: str = "ts", out: str = "mono", by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """The largest time up to each row."""
    return running(df, {out: ("max", F.col(ts))}, by, idx, chunk)


def window_start(df: DataFrame, seconds: int, out: str = "start", by: list[str] | None = None, idx: str = "idx", ts: str = "ts") -> DataFrame:
    """The index of the first row of each row's time window."""
    return rolling_time(df, seconds, idx, ["first"], by, idx, ts).withColumnRenamed("first", out)


def rolling_time(df: DataFrame, seconds: int, value: str, what: list[str], by: list[str] | None = None, idx: str = "idx", ts: str = "ts") -> DataFrame:
    """Columns named after ``what`` over each row's time window: sum, count, average, sd (of the population), min, max, first
    (the value at the window's start), median, and distribution (p10 to p90 by linear interpolation, low, high).

    Nulls count as rows without a value. NaN and infinite values make a window's sum, average and sd NaN; NaN is no value to min,
    max, median and distribution. A chunk of time and what windows reach back to is one pass: sums and deviations are put together
    from ranges of powers of two rows, so what has left a window leaves no error behind; extremes come from such ranges, too, and
    quantiles from counts of ranks that follow the window, in time that hardly depends on its length. Long windows without
    quantiles are those of ``rolling_times``.
    """
    if seconds > 2 * STRETCH and not {"median", "distribution"} & {*what}:
        return rolling_times(df, [(seconds, value, {w: w for w in what})], by, idx, ts)
    exact = df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    kind = df.schema[value].dataType
    kinds = {"sum": T.LongType() if exact else T.DoubleType(), "count": T.LongType(), "min": kind, "max": kind, "first": kind, "low": kind, "high": kind}
    names = [n for w in what for n in ((*QUANTILES, "low", "high") if w == "distribution" else (w,))]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, kinds.get(n, T.DoubleType())) for n in names)])
    fields, columns = {n: to_arrow_type(kinds.get(n, T.DoubleType())) for n in names}, df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(ts, "ascending"), (idx, "ascending")])
        at, own = table.column(ts).to_numpy(), np.flatnonzero(pc.equal(table.column("_own"), table.column("_chunk")).to_numpy(zero_copy_only=False))
        start, end = np.searchsorted(at, at[own] - (seconds - 1)), own + 1
        mine = table.select(columns).take(pa.array(own))
        for n, x in zip(names, _over_windows(table.column(value), start, end, names, exact), strict=True):
            mine = mine.append_column(n, x.cast(fields[n], safe=False))
        return mine

    return dealt_in_time(df, seconds, ts).groupBy(*(by or []), "_chunk").applyInArrow(run, schema)


def rolling_times(df: DataFrame, asks: list[tuple[int, str, dict[str, str]]], by: list[str] | None = None, idx: str = "idx", ts: str = "ts", stretch: int = STRETCH, source: bool = False) -> DataFrame:
    """Columns over several time windows in one pass: ``asks`` are (seconds, value, {what: name}), with what ``rolling_time`` has
    but median and distribution.

    Time is cut into stretches, of which each window is a whole number or holds two at least. A row's window is the end of the one it starts in, whole ones, and the beginning of the row's own;
    the whole ones are a row each, put together for all rows of a stretch at once. So a task holds a stretch and one as long for each
    length of window, however long these are. ``source``: the frame comes from files and may be read twice.
    """
    by, lengths = by or [], sorted({s for s, _, _ in asks})
    whole = math.gcd(*lengths)
    parts = next(k for k in range(-(-whole // stretch), whole + 1) if whole % k == 0)
    width = whole // parts if whole // parts * 4 > stretch else min(stretch, lengths[0] // 2)
    if not width:
        raise ValueError("a window of a second has no stretches")
    back = {s: -(-(s - 1) // width) for s in lengths}  # stretches from a row's own back to the first that its window can start in
    odd = {s: int(s % width > 0) for s in lengths}  # or in the one after
    df = df if source else cut(df)
    fields = {f.name: f.dataType for f in df.schema}
    values = sorted({v for _, v, _ in asks})
    exact = {v: fields[v].typeName() in ("byte", "short", "integer", "long") for v in values}
    own = F.floor(F.col(ts) / width)

    # A row a stretch.
    sums = []
    for k, v in enumerate(values):
        x = F.col(v).cast("long" if exact[v] else "double")
        fine = x if exact[v] else F.when(F.abs(x) < float("inf"), x)
        some = x if exact[v] else F.when(~F.isnan(x), x)
        plain = F.coalesce(fine, F.lit(0).cast("long" if exact[v] else "double"))
        sums += [
            F.count_if(x.isNotNull() & fine.isNull()).alias(f"_bad{k}"), F.count(some).alias(f"_some{k}"), F.sum(plain).alias(f"_sum{k}"), F.avg(plain.cast("double")).alias(f"_mean{k}"),
            (F.var_pop(plain.cast("double")) * F.count("*")).alias(f"_m{k}"), F.min(some).alias(f"_min{k}"), F.max(some).alias(f"_max{k}"), F.min_by(F.struct(F.col(v)), F.struct(ts, idx)).alias(f"_first{k}"),
        ]
    keys = [*by, "_chunk"]
    stretches = df.groupBy(*by, own.alias("_chunk")).agg(F.count("*").alias("_n"), *sums)
    stretches = stretches.withColumns({f"_first{k}": F.col(f"_first{k}")[v] for k, v in enumerate(values)})
    plan = [(s, v, values.index(v), what) for s, v, what in asks]
    between = [T.StructField(k, stretches.schema[k].dataType) for k in keys]
    for i, (_, v, k, _) in enumerate(plan):
        number = T.LongType() if exact[v] else T.DoubleType()
        between += [T.StructField(f"_{n}{i}", t) for n, t in (("n", T.LongType()), ("bad", T.LongType()), ("some", T.LongType()), ("sum", number), ("mean", T.DoubleType()), ("m", T.DoubleType()), ("min", number), ("max", number), ("first", fields[v]))]
    middle_schema = T.StructType(between)

    def middles(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        at = table.column("_chunk").to_numpy()
        out = table.select(keys)
        end = np.arange(len(at))
        for i, (s, v, k, _) in enumerate(plan):
            start = np.minimum(np.searchsorted(at, at - back[s] + 1 + odd[s]), end)
            numbers = {n: table.column(f"_{n}{k}" if n != "n" else "_n").combine_chunks() for n in ("n", "bad", "some", "sum", "mean", "m", "min", "max", "first")}
            total = lambda n: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(numbers[n].to_numpy(zero_copy_only=False))]))  # noqa: B023, E731
            many = numbers["n"].to_numpy(zero_copy_only=False)
            got = {n: pa.array(total(n)) for n in ("n", "bad", "some")}
            _, mean, m = _gathered([many.astype(float), numbers["mean"].to_numpy(zero_copy_only=False), numbers["m"].to_numpy(zero_copy_only=False)], start, end, _merged)
            got |= {"mean": pa.array(mean), "m": pa.array(m)}
            got["sum"] = pa.array(total("sum") if exact[v] else _gathered([numbers["sum"].to_numpy(zero_copy_only=False)], start, end, lambda a, b: [a[0] + b[0]])[0])
            held = start < end
            for n, pick in (("min", np.minimum), ("max", np.maximum)):
                worst = _worst(n, exact[v])
                x = numbers[n].fill_null(worst).to_numpy(zero_copy_only=False)
                best = np.full(len(at), worst, x.dtype)
                best[held] = _range(x, start[held], end[held], pick)
                got[n] = pa.array(best)
            got["first"] = numbers["first"].take(pa.array(start, mask=~held))
            for n in ("n", "bad", "some", "sum", "mean", "m", "min", "max", "first"):
                out = out.append_column(f"_{n}{i}", got[n].cast(to_arrow_type(middle_schema[f"_{n}{i}"].dataType)))
        return out

    between = stretches.groupBy(*by).applyInArrow(middles, middle_schema)
    deal = [(F.lit(0), F.lit(0))]
    for r, s in enumerate(lengths):
        deal += [(F.lit(back[s] - later), F.lit(r + 1)) for later in range(odd[s] + 1)]
    dealt = df.withColumn("_to", F.explode(F.array(*(F.struct((own + d).alias("chunk"), r.alias("role")) for d, r in deal))))
    needed = {*by, idx, ts, *values}
    dealt = dealt.select(*(F.col(c) if c in needed else F.when(F.col("_to.role") == 0, F.col(c)).alias(c) for c in df.columns), F.col("_to.chunk").alias("_chunk"), F.col("_to.role").alias("_role"))
    names = {name: w for _, _, what in asks for w, name in what.items()}
    kind_of = {}
    for _, v, what in asks:
        number = T.LongType() if exact[v] else T.DoubleType()
        kind_of |= {name: {"sum": number, "count": T.LongType(), "min": fields[v], "max": fields[v], "first": fields[v]}.get(w, T.DoubleType()) for w, name in what.items()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, kind_of[n]) for n in names)])
    arrow = {n: to_arrow_type(kind_of[n]) for n in names}
    columns = df.columns

    def run(rows: pa.Table, middle: pa.Table) -> pa.Table:
        role = rows.column("_role")
        mine = rows.filter(pc.equal(role, 0)).select(columns).sort_by([(ts, "ascending"), (idx, "ascending")])
        if not mine.num_rows:
            return pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in schema.fields})
        at, out = mine.column(ts).to_numpy(), mine
        earlier: dict[int, pa.Table] = {}
        for i, (s, v, _, what) in enumerate(plan):
            if s not in earlier:
                earlier[s] = rows.filter(pc.equal(role, lengths.index(s) + 1)).select(list(dict.fromkeys([idx, ts, *values]))).sort_by([(ts, "ascending"), (idx, "ascending")])
            before = earlier[s]
            start = np.searchsorted(before.column(ts).to_numpy(), at - (s - 1))
            held = {n: middle.column(f"_{n}{i}")[0] for n in ("n", "bad", "some", "sum", "mean", "m", "min", "max", "first")}
            found = _over_stretches(before.column(v), start, held, mine.column(v), [*what], exact[v])
            for w, name in what.items():
                out = out.append_column(name, found[w].cast(arrow[name], safe=False))
        return out

    return dealt.groupBy(*keys).cogroup(between.groupBy(*keys)).applyInArrow(run, schema)


def _worst(what: str, exact: bool) -> float | int:
    most, least = (np.iinfo(np.int64).max, np.iinfo(np.int64).min) if exact else (np.inf, -np.inf)
    return int(most if what == "min" else least) if exact else float(most if what == "min" else least)


def _over_stretches(before: pa.ChunkedArray, start: np.ndarray, middle: dict[str, pa.Scalar], own: pa.ChunkedArray, names: list[str], exact: bool) -> dict[str, object]:
    """A result for each of ``names`` over the rows of ``before`` from ``start``, what ``middle`` sums up, and ``own`` up to each row."""
    upto, all_before = np.arange(1, len(own) + 1), np.full(len(own), len(before))

    def plain(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        null = column.is_null().to_numpy()
        v = column.cast(pa.int64() if exact else pa.float64()).fill_null(0).to_numpy()
        return v, null if exact else null | np.isnan(v), np.zeros(len(v), bool) if exact else ~np.isfinite(v)

    (v1, null1, odd1), (v2, null2, odd2) = plain(before), plain(own)

    def total(x: np.ndarray, y: np.ndarray, n: str) -> np.ndarray:
        ends = np.concatenate([np.cumsum(x[::-1])[::-1], np.zeros(1, x.dtype)])
        return ends[start] + middle[n].as_py() + np.cumsum(y)

    n = len(before) - start + middle["n"].as_py() + upto
    bad = total(odd1.astype(np.int64), odd2.astype(np.int64), "bad") > 0
    p1, p2 = np.where(odd1, 0, v1), np.where(odd2, 0, v2)
    nothing, out = np.zeros(len(own), np.int64), {"count": pa.array(n.astype(np.int64))}
    if {"sum", "average"} & {*names}:
        if exact:
            sums = total(p1, p2, "sum")
        else:
            add = lambda a, b: [a[0] + b[0]]
            sums = _gathered([p1], start, all_before, add)[0] + middle["sum"].as_py() + _gathered([p2], nothing, upto, add)[0]
        sums = np.where(bad, np.nan, sums) if bad.any() else sums
        out |= {"sum": pa.array(sums), "average": pa.array(sums / n)}
    if "sd" in names:
        early = _gathered([np.ones(len(p1)), p1.astype(float), np.zeros(len(p1))], start, all_before, _merged)
        late = _gathered([np.ones(len(p2)), p2.astype(float), np.zeros(len(p2))], nothing, upto, _merged)
        many, _, spread = _merged(_merged(early, [np.full(len(own), float(middle[c].as_py())) for c in ("n", "mean", "m")]), late)
        out["sd"] = pa.array(np.where(bad, np.nan, np.sqrt(np.maximum(spread, 0.0) / many)))
    if {"min", "max"} & {*names}:
        some = total((~null1).astype(np.int64), (~null2).astype(np.int64), "some") > 0
        for name, pick in (("min", np.minimum), ("max", np.maximum)):
            worst = _worst(name, exact)
            ends = np.append(pick.accumulate(np.where(null1, worst, v1)[::-1])[::-1], worst).astype(v1.dtype)
            out[name] = pa.array(pick(pick(ends[start], middle[name].as_py()), pick.accumulate(np.where(null2, worst, v2))), mask=~some)
    if "first" in names:
        inside, has = start < len(before), middle["n"].as_py() > 0
        every = pa.concat_arrays([before.combine_chunks(), pa.array([middle["first"].as_py()], before.type), own.slice(0, 1).combine_chunks()])
        out["first"] = every.take(pa.array(np.where(inside, start, len(before) + (0 if has else 1))))
    return out


def _over_windows(column: pa.ChunkedArray, start: np.ndarray, end: np.ndarray, names: list[str], exact: bool) -> list:
    """A result for each of ``names`` over the rows ``start`` up to, without, ``end``."""
    null = column.is_null().to_numpy()
    v = column.cast(pa.int64() if exact else pa.float64()).fill_null(0).to_numpy()
    n = end - start

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
        return sums[end] - sums[start]

    odd = np.zeros(len(v), bool) if exact else ~np.isfinite(v)
    plain = np.where(odd, 0, v)
    bad = total(odd.astype(np.int64)) > 0
    out: dict[str, object] = {}
    if {"sum", "average", "sd"} & {*names}:
        sums = total(plain) if exact else _gathered([plain], start, end, lambda a, b: [a[0] + b[0]])[0]
        sums = np.where(bad, np.nan, sums) if bad.any() else sums
        out |= {"sum": pa.array(sums), "average": pa.array(sums / n)}
        if "sd" in names:
            ones = np.ones(len(v))
            many, _, spread = _gathered([ones, plain.astype(float), np.zeros(len(v))], start, end, _merged)
            out["sd"] = pa.array(np.where(bad, np.nan, np.sqrt(np.maximum(spread, 0.0) / many)))
    out["count"] = pa.array(n.astype(np.int64))
    if "first" in names:
        out["first"] = column.take(pa.array(start))
    null = null if exact else null | np.isnan(v)
    some = total((~null).astype(np.int64)) > 0
    for name, pick, worst in (("min", np.minimum, np.iinfo(np.int64).max if exact else np.inf), ("max", np.maximum, np.iinfo(np.int64).min if exact else -np.inf)):
        also = "low" if name == "min" else "high"
        if {name, also} & {*names}:
            out[name] = out[also] = pa.array(_range(np.where(null, worst, v), start, end, pick), mask=~some)
    if {"median", *QUANTILES} & {*names}:
        asked = [q for q in ("median", *QUANTILES) if q in names]
        found = _quantiles(v, null, start, end, [0.5 if q == "median" else QUANTILES[q] for q in asked])
        out |= {q: pa.array(found[:, k]) for k, q in enumerate(asked)}
    return [out[n] for n in names]


def _range(v: np.ndarray, start: np.ndarray, end: np.ndarray, pick) -> np.ndarray:
    """The extreme of rows ``start`` up to ``end``: of the two ranges of a power of two rows that cover them."""
    out, level, size = np.empty(len(start), v.dtype), v, 1
    power = np.floor(np.log2(end - start)).astype(int)
    for k in range(int(power.max(initial=-1)) + 1):
        here = power == k
        out[here] = pick(level[start[here]], level[end[here] - size])
        level, size = pick(level[:-size], level[size:]), size * 2
    return out


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """(count, mean, sum of squares around it) of two sets together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    apart = b[1] - a[1]
    return [n, np.where(a[0] > 0, a[1] + apart * share, b[1]), a[2] + b[2] + np.where((a[0] > 0) & (b[0] > 0), apart * apart * a[0] * share, 0.0)]


def _gathered(level: list[np.ndarray], start: np.ndarray, end: np.ndarray, join) -> list[np.ndarray]:
    """``join`` of the rows ``start`` up to ``end``: of the few aligned ranges of a power of two rows that make them up."""
    out = [np.zeros(len(start)) for _ in level]
    a, b = start.copy(), end.copy()
    while (a < b).any():
        for at, here in ((a, (a < b) & (a % 2 == 1)), (b - 1, (a < b) & (b % 2 == 1))):
            if here.any():
                joined = join([x[here] for x in out], [x[at[here]] for x in level])
                for x, y in zip(out, joined, strict=True):
                    x[here] = y
            if at is a:
                a = a + here
            else:
                b = b - here
        a, b = a // 2, b // 2
        even = [np.append(x, 0.0) if len(x) % 2 else x for x in level]
        level = join([x[::2] for x in even], [x[1::2] for x in even])
    return out


def _quantiles(v: np.ndarray, null: np.ndarray, start: np.ndarray, end: np.ndarray, shares: list[float]) -> np.ndarray:
    """Interpolated quantiles (windows x shares) of windows whose ends never go back; 0 of nothing.

    Short windows are a list kept in order, which is quickest there; longer ones are counts of ranks, in groups of as many as there
    are groups.
    """
    out, p = np.zeros((len(start), len(shares))), np.array(shares)
    if int((end - start).max(initial=0)) <= SHORT:
        values, gone, own = v.tolist(), null.tolist(), []
        low = high = int(start[0]) if len(start) else 0
        for row, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            for i in range(high, b):
                if not gone[i]:
                    bisect.insort(own, values[i])
            for i in range(low, a):
                if not gone[i]:
                    del own[bisect.bisect_left(own, values[i])]
            low, high = a, b
            if own:
                for k, share in enumerate(shares):
                    place = (len(own) - 1) * share
                    i = int(place)
                    out[row, k] = own[i] + (own[min(i + 1, len(own) - 1)] - own[i]) * (place - i)
        return out
    known = np.unique(v[~null])
    side = math.isqrt(max(len(known) - 1, 0)) + 1
    rank, gone = np.searchsorted(known, v).tolist(), null.tolist()
    counts, groups, kept = np.zeros((side, side), np.int64), np.zeros(side, np.int64), 0
    low = high = int(start[0]) if len(start) else 0
    for row, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        for first, last, step in ((high, b, 1), (low, a, -1)):
            for i in range(first, last):
                if not gone[i]:
                    g, r = divmod(rank[i], side)
                    counts[g, r] += step
                    groups[g] += step
                    kept += step
        low, high = a, b
        if kept:
            place = (kept - 1) * p
            i = place.astype(np.int64)
            wanted = np.concatenate([i, np.minimum(i + 1, kept - 1)])
            upto = groups.cumsum()
            g = np.searchsorted(upto, wanted, "right")
            r = ((upto[g] - groups[g])[:, None] + counts[g].cumsum(1) <= wanted[:, None]).sum(1)
            x, y = np.split(known[g * side + r], 2)
            out[row] = x + (y - x) * (place - i)
    return out


def rolling_ratio(df: DataFrame, seconds: int, numerator: str, denominator: str, out: str, by: list[str] | None = None, idx: str = "idx", ts: str = "ts") -> DataFrame:
    """The window's sum of one column over the row's value of another; 0 where that is 0."""
    return rolling_time(df, seconds, numerator, ["sum"], by, idx, ts).withColumn(out, S.ratio(F.col("sum"), F.col(denominator))).drop("sum")


def rolling_change(df: DataFrame, seconds: int, value: str, by: list[str] | None = None, idx: str = "idx", ts: str = "ts") -> DataFrame:
    """``lookback`` (the value at the window's start), ``change`` from it, ``rate`` (0 where it is 0) and ``ratio_change``
    (NaN where it is 0 or NaN)."""
    df = rolling_time(df, seconds, value, ["first"], by, idx, ts).withColumnRenamed("first", "lookback")
    change, before = F.col(value) - F.col("lookback"), F.col("lookback").cast("double")
    bad = (before == 0) | F.isnan(before)
    return df.withColumns({"change": change, "rate": S.ratio(change, F.col("lookback")), "ratio_change": F.when(bad, F.lit(math.nan)).otherwise(F.try_divide(change.cast("double"), before))})


def rolling_rows(df: DataFrame, n: int, value: str, what: list[str], by: list[str] | None = None, idx: str = "idx", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Over each row and the ``n`` - 1 before it (fewer at the start): sum, max, min, sma (NaN before index ``least``), median."""
    v = F.col(value)

    def columns(w) -> dict[str, Column]:
        frame = w.rowsBetween(-(n - 1), 0)
        every = {"sum": F.sum(v).over(frame), "max": F.max(v).over(frame), "min": F.min(v).over(frame), "sma": F.avg(v).over(frame), "median": F.percentile(v, F.lit(0.5)).over(frame)}
        every["sma"] = F.when(F.col(idx) < least, F.lit(math.nan)).otherwise(every["sma"])
        return {k: every[k] for k in what}

    return in_rows(df, n - 1, columns, by, idx, chunk)


def rolling_count(df: DataFrame, n: int, holds: Column, out: str, by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    return in_rows(df, n - 1, lambda w: {out: F.count_if(holds).over(w.rowsBetween(-(n - 1), 0))}, by, idx, chunk)


def lookback_rows(df: DataFrame, n: int, value: str, by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Against the value ``n`` rows before: ``previous`` (NaN without one), ``change`` (0), ``ratio_change`` and
    ``percentage_change`` (NaN)."""
    frame = in_rows(df, n, lambda w: {"_lag": F.lag(value, n).over(w)}, by, idx, chunk)
    lag, v = F.col("_lag"), F.col(value)
    nan = F.lit(math.nan)
    rate = F.when(lag.isNull(), nan).otherwise(S.divide(v, lag) - 1)
    return frame.withColumns({"previous": F.coalesce(lag.cast("double"), nan), "change": F.when(lag.isNull(), F.lit(0)).otherwise(v - lag), "ratio_change": rate, "percentage_change": rate * 100}).drop("_lag")


def cumulative(df: DataFrame, value: Column, out: str, by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    return running(df, {out: ("sum", value)}, by, idx, chunk)


def cumulative_count(df: DataFrame, holds: Column, out: str, since: int = 0, by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """How often it held up to each row, counted from index ``since``."""
    return running(df, {out: ("sum", F.when((F.col(idx) >= since) & holds, 1).otherwise(0))}, by, idx, chunk)


def extremes(df: DataFrame, value: str, since: int | None = None, skip_zero: bool = False, by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``ath``, ``atl`` up to each row, and ``drawdown`` from the former (0 where it is 0).

    ``skip_zero``: zeros don't count for the low. ``since``: rows before that index are 0 and don't count; the low then starts
    from 0 and so stays 0.
    """
    v = F.col(value)
    counts = F.when(F.col(idx) >= since, v) if since is not None else v
    low = F.when(v != 0, counts) if skip_zero else counts
    out = running(df, {"ath": ("max", counts), "atl": ("min", low)}, by, idx, chunk)
    zero = F.lit(0).cast(df.schema[value].dataType)
    out = out.withColumns({"ath": F.coalesce("ath", zero), "atl": F.coalesce("atl", zero) if since is None else F.least(F.coalesce("atl", zero), zero)})
    return out.withColumn("drawdown", S.ratio(F.col(value) - F.col("ath"), F.col("ath")))


def expanding_sd(df: DataFrame, value: str, out: str = "sd", by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """The population's deviation over all rows up to each row."""
    v = F.col(value).cast("double")
    df = running(df, {"_n": ("count", v), "_s": ("sum", v), "_q": ("sum", v * v)}, by, idx, chunk)
    mean = F.col("_s") / F.col("_n")
    return df.withColumn(out, F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))).drop("_n", "_s", "_q")


def since_peak(df: DataFrame, value: str, ts: str = "ts", by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``days_since`` the last all-time high, and ``most_days`` that ever lay between a row and the high before it."""
    df = cut(running(df, {"_ath": ("max", F.col(value))}, by, idx, chunk))
    df = running(df, {"_at": ("last", F.when(F.col(value) == F.col("_ath"), F.col(ts)))}, by, idx, chunk)
    df = cut(df.withColumn("days_since", (F.col(ts) - F.col("_at")) / 86_400))
    return running(df, {"most_days": ("max", F.col("days_since"))}, by, idx, chunk).drop("_ath", "_at")


def peaks(df: DataFrame, ranges: DataFrame, value: str, idx: str = "idx", block: int = 512) -> DataFrame:
    """The distinct rows of ``ranges`` (a, b, and more) with ``peak``, the largest value at positions a to b; a range without any
    has no row.

    ``block`` positions are one row with an array of their values, so many blocks are a block of the next level, which holds their
    maxima, and so on up to a single one. A range is its parts in its first and its last block and, a level higher, the whole
    blocks between: two rows a level however long it is.
    """
    ends = df.agg(F.min(idx), F.max(idx)).first()
    first, last = (0, 0) if ends[0] is None else ends  # positions are counted from the first
    carried, kind = ranges.columns, df.schema[value].dataType
    none = F.array().cast("array<struct<level:int,block:bigint,lo:bigint,hi:bigint>>")

    def down(c: Column) -> Column:
        return F.floor(c / block).cast("long")

    def part(level: Column, at: Column, lo: Column, hi: Column) -> Column:
        return F.struct(level.alias("level"), at.alias("block"), (lo - at * block).alias("lo"), (hi - at * block).alias("hi"))

    def rise(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        at, upto = down(lo), down(hi)
        here = F.when(lo > hi, none).when(at == upto, F.array(part(level, at, lo, hi))).otherwise(F.array(part(level, at, lo, at * block + block - 1), part(level, upto, upto * block, hi)))
        return F.struct((at + 1).alias("lo"), (upto - 1).alias("hi"), F.concat(acc["parts"], here).alias("parts"))

    levels, level = None, 0
    left = ranges.withColumns({"_lo": F.greatest(F.col("a"), F.lit(first)), "_hi": F.least(F.col("b"), F.lit(last))}).filter("_lo <= _hi")
    while True:
        cells = df.groupBy(F.floor((F.col(idx) - first) / block**level).cast("long").alias("_at")).agg(F.max(value).alias("_m"))
        named = cells.groupBy(down(F.col("_at")).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("_at", F.lit(block)), "_m"))).alias("_of"))
        blocks = named.select(F.lit(level).alias("level"), "block", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long")), lambda i: F.try_element_at(F.col("_of"), i)).cast(T.ArrayType(kind)).alias("_values"))
        levels = blocks if levels is None else levels.unionByName(blocks)
        if last - first < block ** (level + 1):
            break
        level += 1
    begin = F.struct((F.col("_lo") - first).cast("long").alias("lo"), (F.col("_hi") - first).cast("long").alias("hi"), none.alias("parts"))
    cover = F.aggregate(F.array(*(F.lit(k) for k in range(level + 1))), begin, rise, lambda acc: acc["parts"])
    asked = left.select(*carried, F.explode(cover).alias("_p")).select(*carried, "_p.*")
    found = asked.join(levels, ["level", "block"]).select(*carried, F.array_max(F.slice("_values", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("_m"))
    return found.groupBy(*carried).agg(F.max("_m").alias("peak")).filter("peak is not null")


def range_max(df: DataFrame, ranges: DataFrame, value: str, idx: str = "idx", block: int = 512) -> DataFrame:
    """``ranges`` (a, b) with ``peak``, the largest value at positions a to b."""
    return ranges.join(peaks(df, ranges.select("a", "b").distinct(), value, idx, block), ["a", "b"], "left")
