"""Clusters by slabs, and how many rows their operators shuffle."""

import random

from ledgerloom.operators.relatives import clustered
from ledgerloom.plans import transactions as T
from ledgerloom.streaming import mempool

TX = "txid string, fee long, vsize long, parents array<string>"


def shuffled(spark, run):
    """Rows that ``run`` writes to shuffles."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    run()
    return sum(n for stage, n in total().items() if stage not in before)


def orders(spark, n, files=3):
    """Each ten of transactions, where the first and the third before it in its ten are parents."""
    rows = [(str(k), k * 7919 % 5000 + 100, 100 + k % 400, [str(k - d) for d in (1, 3) if k % 10 >= d]) for k in range(n)]
    return spark.createDataFrame(rows, TX).coalesce(files)


def test_clusters_across_slabs_against_a_loop(spark):
    rng = random.Random(3)
    ids = [f"x{i:04d}" for i in range(900)]
    rng.shuffle(ids)
    parents = {t: [ids[i - 1]] if i % 150 else [None, "elsewhere"] for i, t in enumerate(ids[:600])}  # chains of 150
    parents |= {t: [rng.choice(ids[600:]), t] if rng.random() < 0.4 else None for t in ids[600:]}
    low = {t: t for t in ids}
    moved = True
    while moved:
        moved = False
        for t, ps in parents.items():
            for p in ps or ():
                if p in low and low[p] != low[t]:
                    low[p] = low[t] = min(low[p], low[t])
                    moved = True
    several = {c for c in low.values() if sum(x == c for x in low.values()) > 1}
    df = spark.createDataFrame([(t, ps) for t, ps in parents.items()], "txid string, parents array<string>")
    for files in (1, 40):  # all in one slab; most parents elsewhere
        got = {r.txid: (r.cluster, r.linked) for r in clustered(df.repartition(files)).collect()}
        assert got == {t: (low[t], low[t] in several) for t in ids}


def test_packages_by_rounds_are_those_of_a_task(spark):
    rng = random.Random(8)
    rows = [(str(k), rng.choice([None, 5, 70, 900]), rng.randrange(1, 9), [str(k - d) for d in (1, 2, 5) if rng.random() < 0.4 and k % 40 >= d]) for k in range(200)]
    rows += [("a", 1, 2, ["c", "a"]), ("b", 3, 4, ["a"]), ("c", 5, 6, ["b", "b", None])]  # a circle
    df = spark.createDataFrame(rows, TX).repartition(4)
    seeds = spark.createDataFrame([(r[0],) for r in rows[::2]] + [("none",), (None,)], "txid string")
    small, mixed, large = ({tuple(r) for r in T.packages(df, seeds, n).collect()} for n in (1000, 20, 1))
    assert small == mixed == large and len(small) == 102


def test_packages_shuffle_a_few_rows_a_transaction(spark):
    df = orders(spark, 3000)
    assert shuffled(spark, lambda: T.packages(df, df.select("txid")).collect()) < 10 * 3000  # 99 a transaction by rounds of joins


def test_blocks_shuffle_a_few_rows_a_transaction(spark):
    df = orders(spark, 3000)
    assert shuffled(spark, lambda: mempool.pack_blocks(mempool.linearize(df), df, most=2_000).collect()) < 10 * 3000  # 44 a transaction by rounds of labels


def test_only_the_last_block_is_left_unsorted(spark):
    df = orders(spark, 400)
    lines = mempool.linearize(df)
    chunks = {}
    for r in lines.collect():
        chunks.setdefault((-r.chunk_rate, r.cluster, r.chunk), []).append((r.txid, r.vsize))
    want, start = {}, 0
    for key in sorted(chunks):
        want |= {t: min(start // 5_000, 3) for t, _ in chunks[key]}
        start += sum(size for _, size in chunks[key])
    sizes = df.select("txid", "fee", "vsize")
    assert {r.txid: r.block for r in mempool.pack_blocks(lines, sizes, most=5_000, blocks=4).collect()} == want
    assert {r.txid: r.block for r in mempool.pack_blocks(lines.drop("vsize"), sizes, most=5_000, blocks=4).collect()} == want
    assert {r.block for r in mempool.pack_blocks(lines, sizes, blocks=1).collect()} == {0}
