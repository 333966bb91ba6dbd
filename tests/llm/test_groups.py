"""Nearest neighbours, near-duplicates, packing, and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import neighbours as N
from ledgerloom.llm import packing as K
from ledgerloom.llm import simhash as H
from ledgerloom.llm.queries import tokenizer_file

TOKENIZER = tokenizer_file("word_bpe_49k.json")

# ------------------------------------------------------------------------------------------------------ nearest neighbours


def test_recall_order_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(8, size=500)] + 0.6 * rng.normal(size=(500, 16))
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # copies
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).repartition(4)
    got = defaultdict(list)
    for r in N.nearest(df, df.filter("vec_id % 20 = 0").select("vec_id")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    have = dict((i, np.array(v, float)) for i, v in rows[:560]) | {903: np.eye(16)[0]}  # a shorter vector ends in zeros
    ids = np.array(sorted(have))
    all_ = np.stack([have[i] for i in ids])
    hits = total = 0
    for q in [i for i in ids.tolist() if i % 20 == 0]:
        s = all_ @ have[q]
        want = sorted((-s[k], i) for k, i in enumerate(ids.tolist()) if i != q)[:20]
        assert [g[0] for g in got[q]] == list(range(1, 21))
        assert all(abs(sc - have[v] @ have[q]) < 1e-12 and v != q for _, v, sc in got[q])
        assert [(-sc, v) for _, v, sc in got[q]] == sorted((-sc, v) for _, v, sc in got[q])
        hits += sum(sc >= -want[-1][0] - 1e-12 for _, _, sc in got[q])
        total += 20
    assert hits / total >= 0.95 and set(got) == {i for i in ids.tolist() if i % 20 == 0}


def recall(spark, x, extra=()):
    """Of the 20 largest products of every 20th vector with the others, the share that is found."""
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = N.nearest(df, df.filter("vec_id % 20 = 0").select("vec_id")).toPandas()
    have = x.astype(np.float32).astype(float)
    q = np.arange(0, len(x), 20)
    s = have[q] @ have.T
    s[np.arange(len(q)), q] = -np.inf
    least = np.partition(s, -20, axis=1)[:, -20]
    assert len(got) == 20 * len(q) and not got.duplicated(["query_id", "vec_id"]).any()
    assert np.allclose(got["score"], s[got["query_id"] // 20, got["vec_id"]])
    return float((got["score"].to_numpy() >= least[got["query_id"] // 20] - 1e-9).mean())


@pytest.mark.parametrize("sigma", [0.0, 0.1, 0.7, "outlier"])
def test_recall_whatever_the_lengths(spark, sigma):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if sigma == "outlier":
        x[77] *= 3000
    else:
        x *= np.exp(sigma * rng.normal(size=(2000, 1)))
    assert recall(spark, x) >= 0.95


@pytest.mark.parametrize("size", [1e20, 1e-25, 1e150, 1e-160])
def test_recall_whatever_the_scale(spark, size):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1500, 32)) * np.exp(0.3 * rng.normal(size=(1500, 1)))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x * size)], "vec_id long, embedding array<double>").repartition(4)
    got = N.nearest(df, df.filter("vec_id % 20 = 0").select("vec_id")).toPandas()
    q = np.arange(0, len(x), 20)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    least = np.partition(s, -20, axis=1)[:, -20]
    assert len(got) == 20 * len(q) and (s[got["query_id"] // 20, got["vec_id"]] >= least[got["query_id"] // 20] - 1e-9).mean() >= 0.95


def test_recall_of_fifty_thousand(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 24))[rng.integers(400, size=50_000)] + 0.7 * rng.normal(size=(50_000, 24))
    assert recall(spark, x * np.exp(0.3 * rng.normal(size=(50_000, 1)))) >= 0.9


def test_recall_of_directions_without_clusters(spark):
    assert recall(spark, np.random.default_rng(15).normal(size=(20_000, 128))) >= 0.98


def test_recall_where_parts_are_copied(spark, monkeypatch):
    """Parts that many ask are copied, and their messages dealt over the copies."""
    monkeypatch.setattr(N, "PART", 200)
    monkeypatch.setattr(N, "LOAD", 1000)
    rng = np.random.default_rng(16)
    assert recall(spark, rng.normal(size=(2000, 24)) * np.exp(0.7 * rng.normal(size=(2000, 1)))) >= 0.95


def test_messages_of_a_search_do_not_multiply(spark, monkeypatch):
    """Each exchange has a message at most for a part from each other, however many hops came before."""
    sent, exchange = [], N._exchange

    def counted(frames, run, parts, **kinds):
        out = N.cut(exchange(frames, run, parts, **kinds))
        sent.append((out.count(), parts))
        return out

    monkeypatch.setattr(N, "_exchange", counted)
    monkeypatch.setattr(N, "PART", 48)
    assert recall(spark, np.random.default_rng(14).normal(size=(600, 12))) >= 0.95
    assert min(parts for _, parts in sent) >= 12 and all(rows <= parts * (parts + 2) for rows, parts in sent)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 20 = 0").select("vec_id")
    assert [tuple(r) for r in N.nearest(df, q).orderBy("query_id", "rank").collect()] == [(0, 1, 2, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 2, 0.5)]
    assert N.nearest(df.limit(0), q.limit(0)).count() == 0


# --------------------------------------------------------------------------------------------------------- near-duplicates


def plain_fingerprint(text):
    ws = text.lower().encode().split() if text.isascii() else text.encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_are_sparks_hash(spark):
    t = "One two\tTHREE é\nfour"
    assert H.fingerprint(b"a b") == spark.range(1).select(F.xxhash64(F.lit("a b"))).first()[0] % 2**64
    assert H.fingerprint(t.encode()) == plain_fingerprint(t) and H.fingerprint(b" \n") == 0


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("tile,crowd", [(4096, 256), (8, 256), (4096, 0)])
def test_components_against_all_pairs(spark, monkeypatch, tile, crowd):
    monkeypatch.setattr(H, "GROUP", tile)
    monkeypatch.setattr(H, "CROWD", crowd)  # 0: bands as for a very large table
    monkeypatch.setattr(H, "HOT", 10)
    rng = random.Random(7)
    base = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(rng.randint(3, 120))) for _ in range(40)]
    texts = []
    for b in base:
        for _ in range(rng.choice([1, 1, 3, 8])):
            ws = b.split()
            if rng.random() < 0.6 and len(ws) > 40:
                ws[rng.randrange(len(ws))] = "changed"
            texts.append(" ".join(ws).upper() if rng.random() < 0.3 else " ".join(ws))
    texts += ["", None, " \n", "one", "ONE"] + [texts[0]] * 30
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).repartition(4)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in H.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t or "") for _, t in rows]
    comp = brute_components(fps)
    least = defaultdict(lambda: 10**9)
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(least[c], d)
    want = {(d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)}
    assert set(got) == want
    assert H.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 10**7, 10**10, 10**14])
def test_masks_lose_no_pair(n):
    rng = random.Random(n)
    ms = [m % 2**64 for m in H.masks(n)]
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in ms)


def test_bit_slices_of_many_groups():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 70, 5, 129, 3])
    a = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    for k in range(1, len(a), 2):
        a[k] = a[k - 1] ^ np.uint64((1 << int(rng.integers(64))) | (1 << int(rng.integers(64))))
    group = np.repeat(np.arange(5), sizes)
    i, j = H.within(a, a, 4, (sizes, sizes))
    want = {(x, y) for x in range(len(a)) for y in range(len(a)) if group[x] == group[y] and bin(int(a[x] ^ a[y])).count("1") <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want


# ------------------------------------------------------------------------------------------------------------------ packing


def test_pieces_are_the_tokenizers_and_sequences_hold_them(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(2)
    parts = ["thea", "Éco", "don't", "9", "...", "ςΣ", "İ", "日本", "<|endoftext|>", " ", " ", "\n", "ing,", "x."]
    texts = ["", None, "  ", "a", *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(120)), "word " * 300]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "null key", 0), (1, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    cap = 64
    got = K.pack(df, TOKENIZER, capacity=cap).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, a, len(ids[a : a + cap]), zlib.crc32(ids[a : a + cap].tobytes())) for k, a in enumerate(range(0, len(ids), cap))]
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[d])
        assert mine == sorted(want * sum(x[0] == d for x in rows)), t
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= cap
    assert len(seqs) <= -(-sum(r.length for r in got) // cap) + 1
    assert K.pack(df.limit(0), TOKENIZER).count() == 0


def test_many_regions_lose_little(spark):
    rng = random.Random(4)
    sizes = [rng.randint(20, 100) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "uid long, length int")
    got = K.assign(df, 100, region=300).join(df, "uid").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 100 for r in got) and sum(r.n for r in got) == sum(sizes)
    assert len(got) <= len(K.best_fit(sizes, 100)) * 1.01 + 1


@pytest.mark.parametrize("few", [0, 40])
def test_regions_stay_small_where_bins_cannot_be_filled(spark, monkeypatch, few):
    sizes = [55] * 2000 + [30] * few  # two of 55 don't fit in 100
    df = spark.createDataFrame(list(enumerate(sizes)), "uid long, length int").repartition(3)
    seen, solve = [], K.solve

    def watched(lengths, capacity):
        seen.append(lengths.groupBy("region").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0])
        return solve(lengths, capacity)

    monkeypatch.setattr(K, "solve", watched)
    got = K.assign(df, 100, region=200).join(df, "uid").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("o"), F.count("*").alias("c")).collect()
    assert max(seen) < 400
    assert len(got) == 2000 and sum(r.c for r in got) == len(sizes) and all(r.n <= 100 and r.o == 0 for r in got)


def test_crossover_and_mutation_keep_all_pieces():
    rng = random.Random(5)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    a, b = K.best_fit(sizes, 100), K.best_fit(sizes[::-1], 100)
    rng.shuffle(sizes)
    c = K.best_fit([], 100, [[n] for n in sizes])
    for x in (K.crossover(a, c, 100, rng), K.crossover(c, b, 100, rng), K.mutate(c, 100, rng), K.evolve(sizes, [c], 100, rng)):
        assert sorted(n for g in x for n in g) == sorted(sizes) and all(sum(g) <= 100 for g in x)


def test_bound_on_bins():
    assert [K.fewest(x, 100) for x in ([], [100], [51] * 7, [34] * 7, [60] * 4 + [45] * 3, [30] * 10)] == [0, 1, 7, 4, 6, 4]
    rng = random.Random(9)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        assert -(-sum(sizes) // 100) <= K.fewest(sizes, 100) <= len(K.best_fit(sizes, 100))


def test_the_genetic_algorithm_beats_best_fit(spark, monkeypatch):
    rng = random.Random(3)
    sizes = []
    for _ in range(60):  # three pieces fill a bin to the brim, which best fit hardly ever finds
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        sizes += [a, b, 1000 - a - b]
    seen, crossover = [], K.crossover
    monkeypatch.setattr(K, "crossover", lambda *x: seen.append(1) or crossover(*x))
    alone = K.evolve(sizes, [], 1000, random.Random(1))
    assert len(seen) >= K.FEWEST and len(alone) < len(K.best_fit(sizes, 1000))
    monkeypatch.undo()
    df = spark.createDataFrame(list(enumerate(sizes)), "uid long, length int").repartition(3)
    got = K.assign(df, 1000).join(df, "uid").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 1000 for r in got) and 60 <= len(got) <= len(K.best_fit(sizes, 1000)) - 4


def test_many_pieces_that_cannot_share_a_bin_stay_in_small_regions(spark):
    df = spark.range(100_000).select(F.col("id").alias("uid"), F.lit(1100).alias("length"))
    got = K.assign(df, 2048)
    assert got.count() == 100_000 and got.select("sequence_id").distinct().count() == 100_000 and got.filter("offset <> 0").isEmpty()


def test_query_packs_whole_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    from ledgerloom.llm.queries import op10_best_fit_packing

    tok, rng = Tokenizer.from_file(TOKENIZER), random.Random(8)
    texts = [" ".join(rng.choice(["one", "two,", "three"]) for _ in range(rng.choice([3, 50, 900]))) for _ in range(80)] + [None, "word " * 7000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_best_fit_packing(spark, str(tmp_path)).toPandas()
    for d, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == d].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 2048)) and mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in mine.start]
    whole = got.groupby("sequence_id").length.sum()
    # No two pieces over half a sequence share one, and the sequences hold all ids.
    assert whole.max() <= 2048 and len(whole) == max((2 * got.length > 2048).sum(), -(-got.length.sum() // 2048))


# ----------------------------------------------------------------------------------------------------------------- pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    clean = lambda: " ".join("".join(rng.choice(["the", "ing", "on", "er", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(120)) + "."
    docs = [(i, clean(), "en", "s", 0) for i in range(120)]
    docs += [(200, docs[4][1], "en", "s", 0), (201, "too short", "en", "s", 0), (202, None, None, None, None), (203, " ".join(["12345"] * 3 + [str(i) for i in range(90)]), "en", "s", 0), (204, clean() + " token=abcdef123456", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        frame = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r.doc_id for r in frame.select("doc_id").collect()})
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not seen[0] & {201, 202} and len(seen[0] & set(range(120))) >= 118
    assert 203 not in seen[1] and len(seen[1] & set(range(120))) >= 118
    assert 200 not in seen[2] and 4 in seen[2] and len(seen[2] & set(range(120))) == len(seen[1] & set(range(120)))
    masked = spark.read.parquet(str(tmp_path / "out3"))
    row = masked.filter("doc_id = 204").first()
    assert row is None or ("[SECRET]" in row.text and row.n_chars == len(row.text))
    assert seen[4] == seen[3] == seen[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_near_dedup_keeps_distinct_texts_of_one_or_no_id(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(8)]
    near = "x" + texts[1] + " more"
    assert bin(plain_fingerprint(near) ^ plain_fingerprint(texts[1])).count("1") <= 4
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, near), (8, texts[5]), (2, texts[6]), (3, texts[6]), (None, texts[6]), (4, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    want = {(None, texts[0]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, near), (8, texts[5]), (2, texts[6]), (4, None)}
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
