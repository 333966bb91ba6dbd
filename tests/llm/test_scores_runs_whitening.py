"""The compression classifier, periodic runs of words, and exact whitening."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import compression as C
from ledgerloom.llm import periodic_runs as R
from ledgerloom.llm import queries as Q
from ledgerloom.llm import whitening as W

# ---------------------------------------------------------------------------------------------------- compression classifier

SYLLABLES = ["the", "ing", "on", "er", "anne", "rest", "ou", "st", "bel", "tra"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def junk(rng, n):
    return " ".join(w.upper() + rng.choice(["***", "$$$"]) for w in prose(rng, n).split())


def test_scores_part_good_from_bad_texts_that_were_held_out(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 400)), 1) for i in range(300)] + [(i, junk(rng, rng.randint(5, 400)), 0) for i in range(300, 400)]
    rows += [(400, None, None), (401, "", None), (None, rows[0][1], None), (3, rows[3][1], None), (402, prose(rng, 60_000), None), (403, junk(rng, 60_000), None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("quality", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None] + [(None, 0), (7, None), (9, 0), (9, 1)], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.op11_quality_classifier(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    known = got.dropna(subset=["doc_id"]).astype({"doc_id": int})
    assert (known["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in known["doc_id"]]).all()
    held = known[known["held_out"] & (known["doc_id"] < 400)]
    assert len(held) > 50 and ((held["doc_id"] < 300) == (held["predicted"] == 1)).mean() >= 0.98
    assert known.set_index("doc_id")["predicted"][402] == 1 and known.set_index("doc_id")["predicted"][403] == 0
    null, empty = (known.loc[known["doc_id"] == d, "score"].iloc[0] for d in (400, 401))
    assert null == empty and 0.6 < null < 0.9
    assert not got.loc[got["doc_id"].isna(), "held_out"].any() and got.loc[got["doc_id"] == 3, "score"].nunique() == 1


def test_sizes_are_those_of_whole_texts_block_by_block(spark):
    rng = random.Random(5)
    good, bad = (C.dictionary([f(rng, 80).encode()[: C.BLOCK] for _ in range(300)]) for f in (prose, junk))
    rows = [(1, prose(rng, 2000)), (2, "é" * 700), (3, ""), (4, None), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.k: r for r in C.measure(df, good, bad).collect()}
    for k, t in rows:
        raw = (t or "").encode()
        for name, d in (("g", good), ("b", bad)):
            own = C.compressor(d)
            assert by[k][name] == sum(len(own.compress(raw[a : a + C.BLOCK])) for a in range(0, len(raw), C.BLOCK)) and by[k].n == len(raw)


def test_few_labels_of_one_kind_or_none(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, prose(rng, 50)) for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in C.classify(df, none).collect()} == {0.5}
    assert {r.score for r in C.classify(df, df.select("doc_id", F.lit(1).alias("quality"))).collect()} == {1.0}
    few = C.classify(df, df.filter("doc_id < 6").select("doc_id", (F.col("doc_id") % 2).alias("quality"))).collect()
    assert len(few) == 20 and all(0 <= r.score <= 1 for r in few)
    assert C.classify(df.limit(0), none).count() == 0


def test_logistic_curve_against_its_own_likelihood():
    x = np.array([(a, b) for a in np.linspace(-1, 1, 21) for b in np.linspace(0, 1, 5)])
    good = np.round(10_000 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] + 0.7))))
    assert C.fit_curve(x, good, 10_000 - good) == pytest.approx([3, -2, 0.7], abs=0.02)
    parted = C.fit_curve(np.array([[-0.5], [0.5]]), np.array([0.0, 50.0]), np.array([50.0, 0.0]))  # stays finite
    assert 5 < parted[0] < 20 and abs(parted[1]) < 0.1


def test_texts_that_repeat_themselves_are_told_by_their_size(spark):
    rng = random.Random(8)

    def repeats():
        return " ".join(" ".join([w] * rng.randint(20, 60)) for w in prose(rng, 8).split())

    rows = [(i, prose(rng, rng.randint(30, 400)), 1) for i in range(300)] + [(i, repeats(), 0) for i in range(300, 400)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in C.classify(df, labels).collect()}
    assert np.mean([(got[d] >= 0.3) == (q == 1) for d, _, q in rows if d % 3 == 0]) >= 0.98


# ------------------------------------------------------------------------------------------------------------ periodic runs


def brute_runs(x):
    n, seen = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def repetitive(rng):
    n, k = rng.randrange(0, 120), rng.choice([1, 2, 3, 10])
    x = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.6 and n:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    if rng.random() < 0.4 and n:
        a = rng.randrange(n)
        x = x[:a] + [x[a]] * rng.randrange(12) + x[a:]
    return x


@pytest.mark.parametrize("pairs", [R.PAIRS, 7])
def test_runs_against_trying_every_period(monkeypatch, pairs):
    monkeypatch.setattr(R, "PAIRS", pairs)
    rng = random.Random(pairs)
    docs = [repetitive(rng) for _ in range(1500 if pairs > 7 else 150)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = R.find_runs(np.array([w for d in docs for w in d], np.int32), bounds)
    assert got == [brute_runs(d) for d in docs] and sum(map(len, got)) > 100


def test_z_function_against_comparing():
    rng = random.Random(1)
    for _ in range(200):
        x = np.array([rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(60))], np.int32)
        assert R.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def test_long_texts_that_are_one_run():
    n = 400_000
    for x in (np.zeros(n, np.int32), np.arange(n, dtype=np.int32) % 3, np.arange(n, dtype=np.int32) % 1000):
        assert R.find_runs(x, np.array([0, n])) == [[(0, n, int(x.max()) + 1)]]


def test_query_on_planted_runs_against_plain_code(spark, tmp_path):
    rng = random.Random(2)
    texts_ = [" \t\n".join(rng.choice(["to", "be", "é", "A"]) for _ in range(rng.randrange(80))) for _ in range(250)]
    texts_ += ["x " * 6 + "y " * 9 + "u v " * 4, None, "", " \n", "a " * 5, "a b " * 9, "one two " * 2000]
    rows = [*enumerate(texts_), (None, "b " * 7), (5, texts_[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("s")).repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))

    def plain(d, t):
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]
        n, h = len(words), zlib.crc32(str(d).encode()) if d is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))

    got = [tuple(r) for r in Q.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d in range(len(texts_))) > 10 and any(r[1] > 1 for r in got)
    assert R.detect(df.limit(0)).count() == 0


# --------------------------------------------------------------------------------------------------------------- whitening


def exact(vectors):
    """(n, deviations, covariance as Fractions) by whole numbers."""
    xs = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    ys = [[n * c - t for c, t in zip(x, s, strict=True)] for x in xs]
    cov = [[Fraction(sum(y[i] * y[j] for y in ys), n**3) for j in range(len(s))] for i in range(len(s))]
    return n, [sum(c * c for c in y) for y in ys], cov, np.array([[c / n for c in y] for y in ys])


def test_whitening_against_whole_numbers(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    x = x.astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(950, [float(c) for c in x[7]])]
    more = [(900, None), (901, [float("nan")] * 12), (902, [1.0, None] * 6), (903, [float("inf")] * 12), (904, [3e38] * 12)]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("k", F.lit(0)).repartition(5)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    n, dev, cov, centred = exact([v for _, v in rows])
    values, vectors = np.linalg.eigh(np.array(cov, float))
    got = Q.op13_embedding_whitening(spark, str(tmp_path)).toPandas().sort_values(["vec_id", "component"], kind="stable")
    assert len(got) == n * 8 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    order = sorted(range(n), key=lambda i: rows[i][0])
    assert got["deviation"].tolist() == [dev[i] for i in order for _ in range(8)] and got["vec_id"].tolist() == [rows[i][0] for i in order for _ in range(8)]
    want = centred[order] @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    have = got["whitened"].to_numpy().reshape(n, 8)
    assert np.allclose(have * np.sign((have * want).sum(0)), want, atol=1e-9)
    assert np.allclose(got["explained"].to_numpy().reshape(n, 8), values[::-1][:8] / values.sum(), rtol=1e-9)


def test_scatter_is_exact_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 14) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    n, dev, cov, _ = exact([v for _, v in rows])
    s = W.fit(W.prepared(df, "vec_id", "embedding"))
    assert s.n == n and [[Fraction(x, n**3) for x in row] for row in s.scatter.tolist()] == cov
    got = {r.vec_id: int(r.deviation) for r in W.whiten(df).collect()}
    assert got == {i: d for (i, _), d in zip(rows, dev, strict=True)} and max(dev) > 2**64


def test_primes_and_remainders():
    assert W.primes(10**30)[:2] == [1048573, 1048571] and all(p < 2**20 for p in W.primes(10**30))
    moduli = W.primes(2 * 10**30)
    some = [0, 1, -1, 10**30, -(10**30), 123456789]
    assert W.reconstruct(np.array([[v % p for v in some] for p in moduli]), moduli) == some


def test_few_flat_short_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert W.whiten(spark.createDataFrame([], kind)).count() == 0 and W.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = W.whiten(spark.createDataFrame([(1, [0.5, 2.0])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    two = W.whiten(spark.createDataFrame([(2, [0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], kind)).collect()  # shorter vectors end in zeros
    assert len(two) == 6 and all(r.whitened is None for r in two if r.component == 2)
    assert sorted(abs(round(r.whitened, 6)) for r in two if r.component == 1) == [0.707107, 0.707107, 1.414214]
