"""Operators against closed forms and plain loops, with chunks small enough to have many."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import calendar, scalars as S
from ledgerloom.operators import aggregates as A
from ledgerloom.operators import chain, lookups, recursive, resample
from ledgerloom.operators import ordered as O
from ledgerloom.operators import windows as Win
from ledgerloom.plans import market, network
from ledgerloom.plans.catalogue import Catalogue
from ledgerloom.queries import scaled
from ledgerloom.sources.tables import SeriesTable
from ledgerloom.streaming import incremental, mempool


def series(spark, values, ts=None):
    ts = ts or list(range(len(values)))
    return spark.createDataFrame(list(zip(range(len(values)), ts, values)), "idx long, ts long, v long")


def column(df, name):
    return [r[0] for r in df.orderBy("idx").select(name).collect()]


def test_time_window_with_peers(spark):
    df = series(spark, [1, 2, 4, 8, 16], [100, 100, 150, 200, 200])
    assert column(Win.window_start(df, 100), "start") == [0, 0, 0, 2, 2]
    assert column(Win.rolling_time(df, 100, "v", ["sum"]), "sum") == [1, 3, 7, 12, 28]


@pytest.mark.parametrize("seconds", [1, 7, 50])
def test_time_windows_against_a_loop(spark, seconds):
    rng = random.Random(seconds)
    ts = [0]
    for _ in range(120):
        ts.append(ts[-1] + rng.choice([0, 0, 1, 3, 20]))
    v = [rng.randrange(100) for _ in ts]
    what = ["sum", "count", "average", "min", "max", "median", "first", "sd"]
    got = Win.rolling_time(series(spark, v, ts), seconds, "v", what).orderBy("idx").collect()
    for i, r in enumerate(got):
        own = [v[j] for j in range(i + 1) if ts[i] - ts[j] < seconds]
        mean = sum(own) / len(own)
        s = sorted(own)
        assert (r["sum"], r["count"], r["min"], r["max"], r["first"]) == (sum(own), len(own), s[0], s[-1], own[0])
        assert math.isclose(r["average"], mean) and math.isclose(r["median"], (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)
        assert math.isclose(r["sd"], math.sqrt(sum((x - mean) ** 2 for x in own) / len(own)), abs_tol=1e-6)


@pytest.mark.parametrize("kind", ["nan", "steps", "large", "long"])
def test_time_windows_of_doubles_against_exact_loops(spark, kind):
    rng = random.Random(3)
    n, seconds = (1200, 900) if kind == "long" else (250, 40)
    v = {"nan": [rng.choice([float("nan"), None, rng.random()]) for _ in range(n)], "steps": [1e17 if i % 60 == 7 else float(rng.randrange(9)) for i in range(n)], "large": [1e9 + rng.random() for _ in range(n)], "long": [float(rng.randrange(50)) for _ in range(n)]}[kind]
    ts = [i - i % 3 for i in range(n)]
    df = spark.createDataFrame(list(zip(range(n), ts, v)), "idx long, ts long, v double")
    for i, r in enumerate(Win.rolling_time(df, seconds, "v", ["sum", "count", "average", "sd", "min", "max", "distribution"]).orderBy("idx").collect()):
        window = [v[j] for j in range(i + 1) if ts[i] - ts[j] < seconds]
        if any(x is not None and x != x for x in window):
            assert all(math.isnan(r[c]) for c in ("sum", "average", "sd"))
        elif None not in window:
            total = math.fsum(window)
            mean = total / len(window)
            assert math.isclose(r["sum"], total, rel_tol=1e-12) and math.isclose(r["average"], mean, rel_tol=1e-12)
            assert math.isclose(r["sd"], math.sqrt(math.fsum((x - mean) ** 2 for x in window) / len(window)), rel_tol=1e-6, abs_tol=1e-7)
        s = sorted(x for x in window if x is not None and x == x)
        assert (r["count"], r["min"], r["max"]) == (len(window), s[0] if s else None, s[-1] if s else None)
        for q, p in Win.QUANTILES.items():
            place = (len(s) - 1) * p
            want = s[int(place)] + (s[min(int(place) + 1, len(s) - 1)] - s[int(place)]) * (place - int(place)) if s else 0
            assert math.isclose(r[q], want, rel_tol=1e-12, abs_tol=1e-12)


def test_quantiles_by_counts_are_those_of_the_list(monkeypatch):
    rng = random.Random(9)
    v = np.array([rng.choice([float("nan"), 1.0, 2.0, rng.random(), rng.random()]) for _ in range(700)])
    end = np.sort(np.array([rng.randrange(1, 701) for _ in range(400)]))
    start = np.maximum.accumulate(np.maximum(end - np.array([rng.randrange(1, 200) for _ in range(400)]), 0))
    by_list = Win._quantiles(v, np.isnan(v), start, end, [0.1, 0.5, 0.9])
    monkeypatch.setattr(Win, "SHORT", 0)
    assert np.array_equal(Win._quantiles(v, np.isnan(v), start, end, [0.1, 0.5, 0.9]), by_list)


def test_running_folds_over_chunks(spark):
    v = [5, 3, 9, 9, 1, 0, 12, 4, 4, 7]
    df = series(spark, v)
    out = O.running(df, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.col("v")), "l": ("last", F.when(F.col("v") % 2 == 0, F.col("v")))}, None, "idx", 3)
    assert column(out, "s") == [sum(v[: i + 1]) for i in range(10)]
    assert column(out, "m") == [max(v[: i + 1]) for i in range(10)]
    assert column(out, "n") == list(range(1, 11))
    assert column(out, "l") == [next((x for x in reversed(v[: i + 1]) if x % 2 == 0), None) for i in range(10)]


def test_row_windows_and_lookback_over_chunks(spark):
    v = [5, 3, 9, 9, 1, 0, 12, 4, 4, 7]
    out = Win.rolling_rows(series(spark, v), 4, "v", ["sum", "max", "min", "median", "sma"], least=2, chunk=3)
    assert column(out, "sum") == [sum(v[max(0, i - 3) : i + 1]) for i in range(10)]
    assert math.isnan(column(out, "sma")[1]) and column(out, "sma")[2] == 17 / 3
    back = Win.lookback_rows(series(spark, v), 4, "v", chunk=3)
    assert column(back, "change") == [0] * 4 + [v[i] - v[i - 4] for i in range(4, 10)]
    assert all(math.isnan(x) for x in column(back, "previous")[:4])


def test_extremes_and_since_peak(spark):
    v = [0, 5, 3, 9, 9, 1, 0, 12, 4, 4]
    e = Win.extremes(series(spark, v), "v", skip_zero=True, chunk=3)
    assert column(e, "ath") == [max(v[: i + 1]) for i in range(10)]
    assert column(e, "atl") == [0, 5, 3, 3, 3, 1, 1, 1, 1, 1]
    assert column(Win.extremes(series(spark, v), "v", since=4, chunk=3), "atl") == [0] * 10
    p = Win.since_peak(series(spark, v, [i * 86_400 for i in range(10)]), "v", chunk=3)
    assert column(p, "days_since") == [0, 0, 1, 0, 0, 1, 2, 0, 1, 2]
    assert column(p, "most_days") == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2]


def test_range_max(spark):
    rng = random.Random(1)
    v = [rng.randrange(1000) for _ in range(300)]
    pairs = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(60)) if a <= b]
    got = Win.range_max(series(spark, v), spark.createDataFrame(pairs, "a long, b long"), "v", block=5).collect()
    assert len(got) == len(pairs) and all(r.peak == max(v[r.a : r.b + 1]) for r in got)


def test_recurrences_over_chunks(spark):
    v = [float(x) for x in (5, 3, 9, 9, 1, 0, 12, 4, 4, 7, 30, 2)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "idx long, v double")
    for wilder, k in ((False, 2 / 5), (True, 1 / 4)):
        want, prev = [], 0.0
        for i, x in enumerate(v):
            prev = sum(v[: i + 1]) / (i + 1) if i < 4 else x * k + prev * (1 - k)
            want.append(prev)
        got = column(recursive.ema_rows(df, 4, "v", "e", wilder=wilder, chunk=3), "e")
        assert all(math.isclose(a, b) for a, b in zip(got, want))
    on = column(recursive.latch(df, F.col("v") > 8, F.col("v") < 1, "on", chunk=3), "on")
    assert on == [False, False, True, True, True, False, True, True, True, True, True, True]


@pytest.mark.parametrize("back", [3, 100_000])
def test_recurrence_is_the_fold_to_the_last_bit(spark, back):
    rng = random.Random(back)
    v = [rng.randrange(1, 30_000) for _ in range(4000)]
    df = spark.createDataFrame([(i, x, max(i - rng.randrange(back), -back)) for i, x in enumerate(v)], "idx long, v long, start long")
    want, x = [], 0.0
    for r in df.orderBy("idx").collect():
        k = 2.0 / (r.idx - r.start + 2)
        x = r.v * k + x * (1 - k)
        want.append(x)
    assert column(recursive.ema_time(df, "start", "v", "e", chunk=100), "e") == want


def test_market_indicators_against_loops(spark):
    day, rng = 86_400, random.Random(3)
    p = [100.0]
    for _ in range(59):
        p.append(max(1.0, p[-1] + rng.choice([-3, -1, 0, 2, 4])))
    df = spark.createDataFrame([(i, i * day, x) for i, x in enumerate(p)], "idx long, ts long, price double")
    ret = [0.0] * 60  # a day's window starts at the day itself
    two = [0.0] + [p[i] / p[i - 1] - 1 for i in range(1, 60)]

    def ema(xs, days, wilder=False):
        out, prev = [], 0.0
        for i, x in enumerate(xs):
            span = min(days, i + 1)
            k = 1 / span if wilder else 2 / (span + 1)
            prev = x * k + prev * (1 - k)
            out.append(prev)
        return out

    assert column(market.returns(df, day), "ret") == ret
    gain, loss = ema([max(r, 0) for r in two], 5, True), ema([max(-r, 0) for r in two], 5, True)
    want = [0.5 if g + x == 0 else g / (g + x) for g, x in zip(gain, loss)]
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(column(market.rsi(df, 5, 2 * day), "rsi"), want))
    line = [a - b for a, b in zip(ema(p, 3), ema(p, 6))]
    m = market.macd(df, 3, 6, 2)
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(column(m, "macd"), line))
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(column(m, "signal"), ema(line, 2)))


def test_calendar_buckets(spark):
    ts = [calendar.ORIGIN, calendar.ORIGIN + 86_399, 1_704_067_200, 1_709_251_199]
    df = spark.createDataFrame([(t,) for t in ts], "ts long")
    got = {g: [r[0] for r in df.select(calendar.bucket(F.col("ts"), g)).collect()] for g in calendar.GRAINS}
    assert got["day1"] == [0, 0, 5478, 5537] and got["month1"] == [0, 0, 180, 181] and got["year1"] == [0, 0, 15, 15]
    assert got["year10"] == [0, 0, 2, 2] and got["week1"][:2] == [0, 0] and got["day3"] == [0, 0, 1826, 1846]
    with pytest.raises(ValueError):
        calendar.bucket(F.col("ts"), "fortnight")


def test_scalars(spark):
    df = spark.createDataFrame([(10, 4, 0), (0, 0, 0), (3, 5, 0)], "a long, b long, z long")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    got = df.select(S.divide(a, z), S.ratio(a, z), S.checked_sub(a, b), S.saturating_add(a, F.lit(S.MAX_LONG)), S.ratio_difference(a, b)).collect()
    assert got[0][0] == math.inf and math.isnan(got[1][0]) and [r[1] for r in got] == [0, 0, 0] and [r[2] for r in got] == [6, 0, None]
    assert all(r[3] == S.MAX_LONG for r in got) and [r[4] for r in got] == [1.5, 0.0, pytest.approx(-0.4)]
    with pytest.raises(ValueError):
        S.cagr(a, 100)
    prices = spark.createDataFrame([(123_456_789,), (1,), (1_234_567,)], "c long")
    assert [r[0] for r in prices.select(S.significant(F.col("c"))).collect()] == [100_000_000, 1, 1_234_500]
    with pytest.raises(Exception, match="below 0"):
        df.select(S.unsigned_sub(a, b)).collect()


def test_aggregates_reject_nothing_and_weigh_positive_only(spark):
    with pytest.raises(ValueError):
        A.sum_of([])
    df = spark.createDataFrame([(1.0, 2.0, -1.0, 50.0), (0.0, 2.0, 0.0, 5.0)], "w1 double, v1 double, w2 double, v2 double")
    assert [r[0] for r in df.select(A.weighted_average_of([(F.col("w1"), F.col("v1")), (F.col("w2"), F.col("v2"))])).collect()] == [2.0, 0.0]


def test_resampling_keeps_gaps_and_ohlc_fills_them(spark):
    day = 86_400
    df = series(spark, [1, 5, 3, 7], [calendar.ORIGIN, calendar.ORIGIN + 10, calendar.ORIGIN + 3 * day, calendar.ORIGIN + 3 * day + 5])
    assert [tuple(r) for r in resample.last_of(df, "day1", ["v"]).orderBy("bucket").collect()] == [(0, 5), (1, None), (2, None), (3, 7)]
    assert [tuple(r)[1:] for r in resample.ohlc(df, "day1", "v").orderBy("bucket").collect()] == [(1, 5, 1, 5), (5, 5, 5, 5), (5, 5, 5, 5), (3, 7, 3, 7)]


def test_as_of_over_chunks(spark):
    rows = spark.createDataFrame([(5, 50), (17, 170), (40, 400)], "t long, x long")
    points = spark.createDataFrame([(t,) for t in (1, 5, 16, 17, 39, 100)], "t long")
    assert [r[1] for r in lookups.as_of(points, rows, "t", F.col("x"), "x", width=7).orderBy("t").collect()] == [None, 50, 50, 170, 170, 400]
    assert [r[1] for r in lookups.as_of(points, rows, "t", F.col("x"), "x", forward=True, width=7).orderBy("t").collect()] == [50, 50, 170, 170, 400, None]


def test_table_versions(spark, tmp_path):
    t = SeriesTable(spark, str(tmp_path / "series"))
    t.append(series(spark, [1, 2, 3]).select("idx", "v"), 1)
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(5, 1)], "idx long, v long"), 2)
    t.append(spark.createDataFrame([(3, 4), (4, 5)], "idx long, v long"), 2)
    assert column(t.read(), "v") == [1, 2, 3, 4, 5]
    t.truncate(2, 3)
    assert column(t.read(), "v") == [1, 2]
    t.rollback_before(3)
    assert t.stamps() == [1, 2] and column(t.read(), "v") == [1, 2, 3, 4, 5]
    assert SeriesTable(spark, str(tmp_path / "series"), version=2).read() is None


def test_incremental_equals_at_once(spark, tmp_path):
    v = list(range(40))
    compute = lambda df: Win.rolling_rows(df, 5, "v", ["sum"], chunk=7)
    t = SeriesTable(spark, str(tmp_path / "inc"))
    for stamp, n in enumerate((10, 25, 40), 1):
        incremental.continue_from(t, series(spark, v[:n]), compute, back=4, stamp=stamp)
    assert column(t.read(), "sum") == column(compute(series(spark, v)), "sum")


def test_stream_of_events(spark, tmp_path):
    src = spark.createDataFrame([(i, i % 3) for i in range(60)], "s long, k long").select(F.timestamp_seconds("s").alias("ts"), "k")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    incremental.drain(incremental.events_stream(spark, str(tmp_path / "in"), src.schema), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    assert sum(seen) == 60
    counts = incremental.windowed_counts(incremental.events_stream(spark, str(tmp_path / "in"), src.schema), "ts", "20 seconds", "1 second", ["k"])
    q = counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == 60


def test_catalogue(spark):
    df = series(spark, [1, 2, 3, 4], [calendar.ORIGIN + i * 86_400 for i in range(4)]).withColumnRenamed("v", "value")
    c = Catalogue()
    c.add("Realized-Price", lambda: df)
    c.add("price", lambda: df)
    with pytest.raises(ValueError):
        c.add("PRICE", lambda: df)
    assert c.search("realized")[0] == "realized_price" and c.page(0)["names"] == ["price", "realized_price"]
    assert [tuple(r) for r in c.select(["price"], "day1", start=-2).orderBy("idx").collect()] == [(2, 3), (3, 4)]
    assert [r.price for r in c.select(["price"], "height", start=1, limit=2).orderBy("idx").collect()] == [2, 3]
    with pytest.raises(KeyError, match="realized_price"):
        c.find("realised_price", "height")


def test_coinjoin_and_ratio_boundaries(spark):
    def sides(tx, n_in, n_out, value_out=9000, addr=None):
        rows = [(tx, "in", 10_000, addr or f"{tx}i{k}") for k in range(n_in)]
        return rows + [(tx, "out", value_out, f"{tx}o{k}") for k in range(n_out)]

    rows = sides(1, 25, 5) + sides(2, 5, 25) + sides(3, 5, 5) + sides(4, 5, 5, addr="same")
    txs = spark.createDataFrame([(i, False, False) for i in (1, 2, 3, 4)], "tx_idx long, is_coinbase boolean, has_token boolean")
    got = {r.tx_idx: (r.consolidation, r.batch_payout, r.coinjoin) for r in network.patterns(txs, spark.createDataFrame(rows, "tx_idx long, side string, sats long, addr string")).collect()}
    assert got == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True), 4: (False, False, False)}


def test_clusters_and_blocks(spark):
    rows = [("a", 100, 100, []), ("b", 900, 100, ["a"]), ("c", 50, 100, []), ("d", 10, 100, ["c"]), ("e", 700, 100, [])]
    s = spark.createDataFrame(rows, "txid string, fee long, vsize long, parents array<string>")
    lines = {r.txid: (r.cluster, r.chunk, r.chunk_rate) for r in mempool.linearize(s).collect()}
    assert lines == {"a": ("a", 0, 5.0), "b": ("a", 0, 5.0), "c": ("c", 0, 0.5), "d": ("c", 1, 0.1), "e": ("e", 0, 7.0)}
    placed = {r.txid: r.block for r in mempool.pack_blocks(mempool.linearize(s), s, most=250, blocks=2).collect()}
    assert placed == {"e": 0, "a": 0, "b": 0, "c": 1, "d": 1}


def plain_order(fee, size, parents):
    """(cluster, chunk, rate) by txid, set by set over the whole pool."""
    cluster = {t: t for t in fee}
    moved = True
    while moved:
        moved = False
        for t, ps in parents.items():
            for p in ps:
                low = min(cluster[t], cluster[p])
                moved |= cluster[t] != low or cluster[p] != low
                cluster[t] = cluster[p] = low
    out = {}
    for c in set(cluster.values()):
        left, chunk, least = {t for t in fee if cluster[t] == c}, 0, math.inf
        while left:

            def above(t):
                return {t}.union(*(above(p) for p in parents[t] if p in left))

            rate = {t: sum(fee[x] for x in above(t)) / sum(size[x] for x in above(t)) for t in left}
            best = min(left, key=lambda t: (-rate[t], t))
            least = min(least, rate[best])
            placed = above(best)
            out |= {t: (c, chunk, least) for t in placed}
            left, chunk = left - placed, chunk + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_random_parents_against_a_loop(spark, seed):
    rng = random.Random(seed)
    ids = [f"t{i:03d}" for i in range(150)]
    rng.shuffle(ids)
    parents = {t: sorted({rng.choice(ids[max(0, i - 9) : i]) for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3]))} if i % 13 else set()) for i, t in enumerate(ids)}
    fee, size = {t: rng.randrange(1, 40) for t in ids}, {t: rng.choice([1, 2, 5]) for t in ids}
    df = spark.createDataFrame([(t, fee[t], size[t], parents[t] + ["elsewhere"]) for t in ids], "txid string, fee long, vsize long, parents array<string>").repartition(5)
    lines = mempool.linearize(df)
    want = plain_order(fee, size, parents)
    assert {r.txid: (r.cluster, r.chunk, r.chunk_rate) for r in lines.collect()} == want
    chunks = sorted({(-rate, c, k) for c, k, rate in want.values()})
    start, at = 0, {}
    for rate, c, k in chunks:
        at[c, k] = min(start // 60, 3)
        start += sum(size[t] for t in ids if want[t][:2] == (c, k))
    assert {r.txid: r.block for r in mempool.pack_blocks(lines, df, most=60, blocks=4).collect()} == {t: at[want[t][:2]] for t in ids}


def test_a_long_chain_is_ordered_at_once():
    n = 1000
    out = mempool.order_cluster([f"{i:04d}" for i in range(n)], list(range(1, n + 1)), [1] * n, [[f"{i - 1:04d}"] if i else [] for i in range(n)])
    assert len(out) == n and {x[1] for x in out} == {0}


def test_fee_tiers(spark):
    r = mempool.recommend
    assert r([], 2.0) == {"fastest": 2.5, "half_hour": 2.25, "hour": 2.0, "economy": 2.0, "minimum": 2.0}
    assert r([], 0.0)["minimum"] == 0.001 and r([], 0.0)["fastest"] == 1.0
    assert r([(12.5, 400_000)])["hour"] == r([(12.5, 400_000)])["economy"] == 1.0
    full = r([(25.0, 1_000_000), (10.0, 1_000_000)])
    assert (full["fastest"], full["half_hour"], full["hour"]) == (25.5, 17.75, 1.0)
    assert r([(10.0, 725_000)])["fastest"] == 5.0  # a last block of which 225,000 of 500,000 count
    placed = spark.createDataFrame([("a", 0, 9.0), ("b", 0, 4.0), ("c", 0, 2.0), ("d", 1, 1.0)], "txid string, block int, chunk_rate double")
    sizes = spark.createDataFrame([("a", 90, 10), ("b", 40, 10), ("c", 30, 15), ("d", 7, 7)], "txid string, fee long, vsize int")
    stats = [tuple(x) for x in mempool.block_stats(placed, sizes).orderBy("block").collect()]
    assert stats == [(0, 3, 160, 35, 4.0, [2.0, 2.0, 2.0, 4.0, 9.0, 9.0, 9.0]), (1, 1, 7, 7, 1.0, [1.0] * 7)]


def test_replacement_roots_of_long_chains(spark):
    links = [(f"a{k}", f"a{k + 1}") for k in range(700)] + [("b0", "b1"), ("c0", "a699"), ("d0", None)]
    df = spark.createDataFrame(links, "txid string, by string").repartition(4)
    got = {r.txid: r.root for r in mempool.replacement_roots(df).collect()}
    assert got == {**{f"a{k}": "a700" for k in range(700)}, "b0": "b1", "c0": "a700", "d0": None}
    with pytest.raises(ValueError):
        mempool.replacement_roots(spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "x")], "txid string, by string"))
    assert mempool.replacement_roots(df.limit(0)).count() == 0


def test_whole_parts_of_decimals_and_percentages(spark):
    """.99999999 of a fraction isn't rounded up, and a percentage is rounded once."""
    df = spark.createDataFrame([("12399999999",), ("-1",), ("123456789012345678901234567899999999",)], "a string").select(F.col("a").cast("decimal(38,0)").alias("a"))
    assert [int(r[0]) for r in df.select(S.floor_div(F.col("a"), 10**8)).collect()] == [123, -1, 1234567890123456789012345678]
    p = spark.createDataFrame([(5138, 1280)], "a long, b long").select(S.percentage(F.col("a"), F.col("b")), S.percentage_difference(F.col("a"), F.col("b"))).first()
    assert [math.floor(x * 10_000 + 0.5) for x in p] == [4014063, 3014063]


def test_infinite_parts_are_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(scaled(F.col("x"), 10)).collect()] == [None, None, None, 15, None]


def test_realised_values_are_cut_off_after_summing(spark):
    kind = "created_h long, created_ts long, spent_h long, spent_ts long, sats long, price_in long, price_out long"
    rows = [(0, 0, 2, 43_200, 99_999_999, 1, 3), (1, 0, 2, 21_600, 3, 100_000_000, 4)]
    r = chain.realized(spark.createDataFrame(rows, kind)).first()
    assert int(r.value_destroyed) == 3 and int(r.transfer_value) == 3 and int(r.profit) == 1 and int(r.loss) == 2
    assert r.satdays_destroyed == (99_999_999 * 43_200 + 3 * 21_600) / 86_400


def test_peaks_of_ranges_over_many_levels(spark):
    """Positions with gaps and nulls, ranges beyond them, and what else a range carries; each is two rows a level at most."""
    rng = random.Random(3)
    v = {i: rng.choice([None, rng.randrange(10**6)]) for i in range(-50, 3000) if rng.random() < 0.8}
    df = spark.createDataFrame(list(v.items()), "idx long, v long").repartition(3)
    pairs = [(a, a + rng.choice([-1, 0, 1, 7, 300, 5000]), n) for n, a in enumerate(rng.choices(range(-80, 3010), k=150))]
    want = {p: max((v[i] for i in range(p[0], p[1] + 1) if v.get(i) is not None), default=None) for p in pairs}
    got = {(r.a, r.b, r.n): r.peak for r in Win.peaks(df, spark.createDataFrame(pairs, "a long, b long, n long"), "v", block=6).collect()}
    assert got == {p: m for p, m in want.items() if m is not None}
    assert Win.peaks(df.filter("idx < -50"), spark.createDataFrame(pairs, "a long, b long, n long"), "v").count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_long_time_windows_against_a_loop(spark, whole):
    rng = random.Random(whole)
    ts = [0]
    for _ in range(400):
        ts.append(ts[-1] + rng.choice([0, 0, 1, 3, 20, 90]))
    v = [rng.choice([None, rng.randrange(-50, 100)]) for _ in ts]
    x = [rng.choice([None, math.nan, math.inf, *(rng.random() for _ in range(40))]) for _ in ts]
    df = spark.createDataFrame([(i, t, a, b) for i, (t, a, b) in enumerate(zip(ts, v, x))], "idx long, ts long, v long, x double")
    what = ["sum", "count", "average", "sd", "min", "max", "first"]
    lengths = (40, 120, 2000) if whole else (43, 121, 2003)
    got = Win.rolling_times(df, [(s, c, {w: f"{w}_{c}_{s}" for w in what}) for s in lengths for c in ("v", "x")], stretch=20).orderBy("idx").collect()
    assert len(got) == len(ts)
    for s in lengths:
        for c in ("v", "x"):
            for i, r in enumerate(got):
                inside = [got[j][c] for j in range(i + 1) if ts[j] > ts[i] - s]
                plain = [0 if y is None else y for y in inside]
                some = [y for y in inside if y is not None and not math.isnan(y)]
                mean = sum(plain) / len(plain)
                expect = {"sum": sum(plain), "count": len(plain), "average": mean, "min": min(some, default=None), "max": max(some, default=None), "first": inside[0], "sd": (sum((y - mean) ** 2 for y in plain) / len(plain)) ** 0.5}
                if not all(math.isfinite(y) for y in plain):
                    expect |= dict.fromkeys(("sum", "average", "sd"), math.nan)
                for w, y in expect.items():
                    z = r[f"{w}_{c}_{s}"]
                    assert z == y or (y is not None and z is not None and (math.isclose(z, y, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(y) and math.isnan(z)))), (s, c, w, i, z, y)


def test_addresses_by_height_whatever_their_size(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "b", "b", "c", None]), h, rng.choice([None, h + rng.randrange(6)])) for h in (rng.randrange(60) for _ in range(150))]
    lives = spark.createDataFrame(rows, "addr string, created_h long, spent_h long")
    want, total, funded = {}, 0, 0
    held = {}
    for h in sorted({x for _, c, s in rows for x in (c, s) if x is not None}):
        w = dict.fromkeys(("receiving", "sending", "bidirectional", "active", "reactivated", "new"), 0)
        for a in {a for a, _, _ in rows}:
            r, s = sum(x == a and c == h for x, c, _ in rows), sum(x == a and d == h for x, _, d in rows)
            if not r and not s:
                continue
            before, after = held.get(a, 0), held.get(a, 0) + r - s
            w["receiving"] += r > 0
            w["sending"] += s > 0
            w["bidirectional"] += r > 0 and s > 0
            w["active"] += 1
            w["new"] += a not in held
            w["reactivated"] += a in held and before == 0 and after > 0
            total, funded = total + (a not in held), funded + (after > 0) - (before > 0)
            held[a] = after
        want[h] = (w, (total, funded, total - funded))
    for many in (10, chain.MANY):
        got = chain.address_activity(lives, "addr", many)
        assert {r.height: {k: r[k] for k in r.asDict() if k != "height"} for r in got.collect()} == {h: w for h, (w, _) in want.items()}
        got = chain.address_counts(lives, "addr", many)
        assert {r.height: (r.total, r.funded, r.empty) for r in got.collect()} == {h: c for h, (_, c) in want.items()}


def test_address_history_is_dealt_once(spark):
    lives = spark.range(1000).selectExpr("id % 7 as addr", "id as created_h", "if(id % 3 = 0, null, id + 5) as spent_h")
    plan = chain.address_activity(lives, "addr")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(addr") == 1 and plan.count("Exchange hashpartitioning") == 2
