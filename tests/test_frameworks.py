"""Rarity bands, expanding quantiles and levels against plain folds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import frameworks as K


def plain_bands(values, quantiles, half_life, width, top, since):
    n, mass, out = int(top / width) + 1, {}, []
    for i, v in enumerate(values):
        if v is not None and v == v:
            b = min(max(math.floor(v / width + 0.5), 0), n - 1)
            mass[b] = mass.get(b, 0) + 2 ** (max(i - since, 0) / half_life)
        total, row = sum(mass.values()), []
        for q in quantiles:
            cum, at = 0.0, 0
            for b in sorted(mass):
                cum += mass[b]
                if cum >= q * total - 1e-9 * total:
                    at = b
                    break
            row.append(at * width)
        out.append(row)
    return out


@pytest.mark.parametrize("chunk", [7, 50, 1000])
def test_decayed_bands_against_a_fold(spark, chunk):
    rng = random.Random(chunk)
    series = {s: [None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else rng.choice([-1.0, 99.0]) if rng.random() < 0.03 else round(rng.uniform(0.2, 5), 3) for _ in range(160)] for s in "ab"}
    series["a"][:20] = [None] * 20
    rows = [(s, i, v) for s, vs in series.items() for i, v in enumerate(vs) if not 60 <= i < 80 or s == "b"]  # a gap of more than a chunk
    series["a"][60:80] = [None] * 20
    df = spark.createDataFrame(rows, "s string, idx long, v double").repartition(3)
    got = K.decayed_bands(df, "v", K.BANDS, ["s"], half_life=37, width=0.01, top=43.0, since=25, chunk=chunk).collect()
    assert len(got) == len(rows)
    want = {s: plain_bands(vs, K.BANDS.values(), 37, 0.01, 43.0, 25) for s, vs in series.items()}
    for r in got:
        assert [r[q] for q in K.BANDS] == pytest.approx(want[r.s][r.idx]), (r.s, r.idx)


def test_decayed_bands_beyond_a_thousand_half_lives(spark):
    """Chunks hold more rows than an Arrow batch, weights would leave doubles, and one series ends in nulls."""
    n, half_life = 33_000, 30
    rng = random.Random(5)
    values = {s: [None if s == "b" and i >= 12_000 else round(rng.uniform(0.2, 5), 2) for i in range(n)] for s in "ab"}
    df = spark.createDataFrame([(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)], "s string, idx long, v double")
    got = {(r.s, r.idx): r for r in K.decayed_bands(df, "v", K.BANDS, ["s"], half_life=half_life, width=0.01, since=100, chunk=11_000).select("s", "idx", *K.BANDS).collect()}
    assert len(got) == 2 * n
    for s, i in (("a", 150), ("a", 20_000), ("a", n - 1), ("b", 11_999), ("b", n - 1)):
        until = min(i, 11_999) if s == "b" else i
        near = values[s][max(0, until - 2700) : until + 1]  # older ones weigh less than 2**-89
        want = plain_bands(near, K.BANDS.values(), half_life, 0.01, 43.0, max(100 - max(0, until - 2700), 0))[-1]
        assert [got[s, i][q] for q in K.BANDS] == pytest.approx(want), (s, i)


def test_scores_and_inner_percentiles(spark):
    rows = [(100, 90, 95, 110, 120), (130, 90, 95, 110, 120), (92, 90, 95, 110, 120), (80, 90, 95, 110, 120), (None, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "p long, l1 long, l2 long, u1 long, u2 long")
    score = K.rarity_score(F.col("p"), [F.col("l1"), F.col("l2")], [F.col("u1"), F.col("u2")])
    assert [r[0] for r in df.select(score).collect()] == [0, 2, -1, -2, 0]
    pairs = spark.createDataFrame([(100, 10_000), (0, 900)], "a long, b long")
    assert [tuple(r) for r in pairs.select(*(K.inner_percentile(F.col("a"), F.col("b"), p) for p in (5, 50, 95))).collect()] == [(100, 1000, 10_000), (0, 450, 900)]


def test_expanding_quantiles_are_of_the_days_before(spark):
    rng = random.Random(1)
    v = [None if rng.random() < 0.1 else float("nan") if rng.random() < 0.1 else rng.random() for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(v)), "day long, v double").repartition(3)
    for p, least in ((0.95, 1), (0.5, 10)):
        got = [r.q for r in K.expanding_quantile(df, "v", p, "q", "day", least=least).orderBy("day").collect()]
        for i, q in enumerate(got):
            own = [x for x in v[:i] if x is not None and x == x]
            assert q is None if len(own) < least else q == pytest.approx(np.quantile(own, p))


def test_floors_and_levels(spark):
    rng = random.Random(2)
    inv = [(d, rng.randrange(1, 40), rng.randrange(0, 9)) for d in range(6) for _ in range(30)] + [(6, 5, 0)]
    df = spark.createDataFrame(inv, "day long, price long, sats long")
    floors = spark.createDataFrame([(d, 12 if d < 5 else None if d == 5 else 3) for d in range(7)], "day long, floor long")
    for r in K.levels_above(df, floors, ["day"]).collect():
        own = sorted((p, s) for d, p, s in inv if d == r.day and r.floor is not None and p >= r.floor and s > 0)
        total = sum(s for _, s in own)
        for share in K.LEVELS:
            cum, want = 0, None
            for p, s in own:
                cum += s
                if want is None and cum >= total * share:
                    want = p
            assert r[f"level_{round(100 * share)}"] == want, (r.day, share)
