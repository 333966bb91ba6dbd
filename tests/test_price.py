"""The price from outputs against a fold written out block by block."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import price as P


def plain(hists, origin, first, end, start, fast_from, slow, fast):
    """Bins by height; hists: height -> {bin: n}."""
    profile, b, out = [1 / len(P.ARMS)] * len(P.ARMS), start, {}
    for h in range(first, end):
        r = slow if h < fast_from else fast
        ema = {}
        for age in range(r.blocks):
            if h - age >= origin:
                for k, n in hists.get(h - age, {}).items():
                    ema[k] = ema.get(k, 0.0) + r.rate * (1 - r.rate) ** age * n
        val = lambda k: ema.get(k, 0.0)
        centre = math.floor(b + 0.5)
        span = range(max(centre - r.below, 0), min(centre + r.above + 1, P.BINS))
        peaks = [max(val(k + a) for k in span) for a in P.ARMS]

        def score(k):
            s = sum(val(k + a) / p for a, p in zip(P.ARMS, peaks, strict=True) if p > 0)
            arms = [val(k + a) for a in P.ARMS]
            if r.shape and sum(arms) > 0:
                s += r.shape * (1 - sum(abs(x / sum(arms) - q) for x, q in zip(arms, profile, strict=True)))
            return s

        scores = {k: score(k) for k in span}
        best = max(span, key=lambda k: (scores[k], -k))
        mid = scores[best]
        left, right = scores.get(best - 1, mid), scores.get(best + 1, mid)
        bend = left - 2 * mid + right
        b = best + (max(-0.5, min(0.5, 0.5 * (left - right) / bend)) if abs(bend) > 1e-10 else 0.0)
        if r.shape:
            arms = [val(math.floor(b + 0.5) + a) for a in P.ARMS]
            if sum(arms) > 0:
                profile = [(1 - P.SHAPE_RATE) * q + P.SHAPE_RATE * x / sum(arms) for q, x in zip(profile, arms, strict=True)]
        out[h] = b
    return out


def chain(rng, n, first=1000):
    """Histograms of payments of round amounts at a price that wanders, with noise; some blocks have none."""
    at, hists = 1500.0, {}
    for h in range(first, first + n):
        at += rng.uniform(-4, 4)
        if rng.random() < 0.1:
            continue
        own = {}
        for _ in range(rng.randint(1, 60)):
            k = round(at + rng.choice(P.ARMS) + rng.choice([0, 0, 1, -1])) if rng.random() < 0.7 else rng.randrange(0, P.BINS)
            own[k] = own.get(k, 0) + 1
        hists[h] = own
    return hists


def frame(spark, hists):
    rows = [(h, sorted(x), [x[k] for k in sorted(x)]) for h, x in hists.items()]
    return spark.createDataFrame(rows, "height long, bins array<int>, counts array<long>").repartition(5)


@pytest.mark.parametrize("fast_from", [1000, 1070, 5000])
def test_estimate_against_a_plain_fold(spark, fast_from):
    hists = chain(random.Random(fast_from), 230)
    want = plain(hists, 1000, 1000, 1230, 1503.4, fast_from, P.SLOW, P.FAST)
    out, state = P.estimate(frame(spark, hists), 1230, P.State(1000, 1503.4), fast_from=fast_from, chunk=37)
    got = {r.height: (r.bin, r.cents) for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[h][0], want[h], abs_tol=1e-6) for h in want)
    assert all(got[h][1] == math.floor(10 ** (10 - got[h][0] / 200) * 100 + 0.5) for h in want)
    assert state.height == 1230 and math.isclose(state.bin, want[1229], abs_tol=1e-6)


def test_a_run_goes_on_from_its_saved_state(spark):
    hists = chain(random.Random(7), 200)
    whole, end = P.estimate(frame(spark, hists), 1200, P.State(1000, 1500.0), fast_from=1110, chunk=50)
    saved, got = P.State(1000, 1500.0).to_json(), []
    for upto in (1060, 1061, 1130, 1200):
        state = P.State.from_json(saved)
        recent = {h: x for h, x in hists.items() if state.height - 40 < h < upto}
        part, state = P.estimate(frame(spark, recent), upto, state, origin=1000, fast_from=1110, chunk=50)
        got += [(r.height, round(r.bin, 9)) for r in part.collect()]
        saved = state.to_json()
    assert got and sorted(got) == sorted((r.height, round(r.bin, 9)) for r in whole.collect())
    assert P.State.from_json(saved).bin == pytest.approx(end.bin)


def test_payments_and_their_histograms(spark):
    big = [(5, 30 + i // 101, 54321 + i, "p2wpkh") for i in range(101)]
    rows = [(5, 1, 54321, "p2pkh"), (5, 1, 100_000, "p2pkh"), (5, 1, 100_099, "p2pkh"), (5, 1, 100_101, "p2pkh"), (5, 1, 400_000, "p2pkh"), (5, 1, 999, "p2pkh"), (5, 1, 77777, "p2tr"), (5, 2, 54321, "p2pkh"), (5, 2, 0, "op_return"), *big, (630_000, 50, 54321, "p2pkh")]
    df = spark.createDataFrame(rows, "height long, tx_idx long, sats long, output_type string")
    got = {r.height: dict(zip(r.bins, r.counts, strict=True)) for r in P.histograms(P.payments(df)).collect()}
    b = lambda s: round(math.log10(s) * 200)
    assert got == {5: {b(54321): 1, b(100_101): 1, b(400_000): 1}, 630_000: {b(54321): 1}}
    rounds = spark.createDataFrame([(s,) for s in (0, 1, 4, 1000, 1001, 1002, 9995, 9_990_000, 600_600, 601_000, 5 * 10**11)], "sats long")
    assert [r[0] for r in rounds.select(P.common_round(F.col("sats"))).collect()] == [False, True, False, True, True, False, True, True, True, False, True]


def test_nothing_to_do_and_blocks_without_payments(spark):
    none = spark.createDataFrame([], "height long, bins array<int>, counts array<long>")
    out, state = P.estimate(none, 10, P.State(10, 1500.0))
    assert out.count() == 0 and state.bin == 1500.0
    out, _ = P.estimate(none, 16, P.State(10, 1500.0), fast_from=13, chunk=2)
    assert [r.bin for r in out.orderBy("height").collect()] == [1488.0, 1476.0, 1464.0, 1452.0, 1440.0, 1428.0]  # of equal scores the first


def test_chunks_are_dealt_to_tasks_however_small_they_are(spark):
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).numCompleteTasks() for i in range(found.size())}

    rows = frame(spark, chain(random.Random(2), 230))
    before = stages()
    P.estimate(rows, 1230, P.State(1000, 1500.0), fast_from=1000, chunk=10)[0].collect()
    assert sum(n == 23 for stage, n in stages().items() if stage not in before) >= 2  # both passes; by bytes they were a task each
