"""The pool over time: as a table, as a stream that is stopped and started again, and as a plain loop."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import pool

START, EVERY, KEPT = datetime(2024, 1, 1), 60, 300
KIND = "at timestamp, txid string, spends array<string>, raw array<long>, paid array<long>"


def body(txid):
    k = int(txid)
    return ([f"{k % 7}:0", f"{k % 11 + 100}:1"], [k % 5, k % 3], [k % 5] if k % 2 else [])


def history(seed, cycles=40, ids=30):
    """Sets of txids, one a cycle; transactions leave and return after short and long whiles."""
    rng, now, out = random.Random(seed), set(), []
    for _ in range(cycles):
        now = {t for t in now if rng.random() > 0.25} | {str(rng.randrange(ids)) for _ in range(rng.randrange(5))}
        out.append(set(now))
    return out


def loop(sets):
    """The pool, its graveyard and what happens at each snapshot, one after the other."""
    live, tombs, out = set(), {}, []
    for c, now in enumerate(sets):
        fresh = [t for t in now - live if t not in tombs]
        for t in live - now:
            hits = [(i, f) for i, o in enumerate(body(t)[0]) for f in fresh if o in body(f)[0]]
            out.append((t, c, "replaced" if hits else "vanished", min(hits, key=lambda h: (h[0], h[1]))[1] if hits else None))
        out += [(t, c, "fresh" if t in fresh else "revived", None) for t in now - live]
        tombs = {t: b for t, b in tombs.items() if t not in now} | {t: c for t in live - now}
        tombs = {t: b for t, b in tombs.items() if (c - b) * EVERY < KEPT}  # forgets after each snapshot
        live = now
    return out, live


def rows(sets, first=0):
    return [(START + timedelta(seconds=EVERY * (first + c)), t, *body(t)) for c, now in enumerate(sets) for t in sorted(now)]


def plain(df):
    cycle = ((F.unix_timestamp("at") - int(START.replace(tzinfo=timezone.utc).timestamp())) / EVERY).cast("int")
    return sorted((tuple(r) for r in pool.replaced(df).select("txid", cycle, "change", "by").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_table_of_snapshots_against_a_loop(spark, seed):
    sets = history(seed)
    want, live = loop(sets)
    assert {c for _, _, c, _ in want} == {"fresh", "revived", "vanished", "replaced"}
    df = spark.createDataFrame(rows(sets) + rows(sets)[:5] + [(None, "9", None, None, None), (START, None, None, None, None)], KIND).repartition(3)
    found = pool.changes(df, EVERY, KEPT)
    assert plain(found) == sorted(want, key=repr)
    left = Counter((kind, b) for t in live for kind, bins in zip(("raw", "paid"), body(t)[1:], strict=True) for b in bins)
    assert {(r.kind, r.bin): r.n for r in pool.live_counts(found, ["raw", "paid"]).collect() if r.n} == left


def test_a_stream_that_is_stopped_and_started_again(spark, tmp_path):
    sets = history(3, cycles=24)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared")) if spark.sparkContext.getCheckpointDir() is None else None
    inbox, to, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    cuts = [0, 1, 2, 9, 15, 16, 24]
    for part, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows(sets[a:z], a), KIND).coalesce(1).write.mode("append").parquet(inbox)
        if part in (3, 5):
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(inbox)
            pool.run_changes(stream, EVERY, to, marks, KEPT)
    got = pool.stored_changes(spark, to)
    assert plain(got) == sorted(loop(sets)[0], key=repr) == plain(pool.changes(spark.read.schema(KIND).parquet(inbox), EVERY, KEPT))
    counted = spark.readStream.schema(pool.CHANGES).parquet(f"{to}/*")
    q = pool.live_counts(counted, ["raw", "paid"]).writeStream.outputMode("complete").format("memory").queryName("bins").trigger(availableNow=True).start()
    q.awaitTermination()
    left = Counter((kind, b) for t in loop(sets)[1] for kind, bins in zip(("raw", "paid"), body(t)[1:], strict=True) for b in bins)
    assert {(r.kind, r.bin): r.n for r in spark.table("bins").collect() if r.n} == left


def test_batches_are_joined_with_what_is_known(spark):
    """However snapshots are cut into batches; rows of a snapshot that was told already are too late."""
    sets = history(5, cycles=16)
    known, told, df = None, [], spark.createDataFrame([], pool.CHANGES)
    for a, z in ((0, 1), (1, 7), (7, 16)):
        late = rows(sets[:a])[:3]
        found, after = pool.fold_batch(spark.createDataFrame(rows(sets[a:z], a) + late, KIND), known, EVERY, KEPT)
        told += [tuple(r) for r in found.collect()]
        known = spark.createDataFrame([tuple(r) for r in after.collect()], pool.KNOWN)
    assert plain(spark.createDataFrame(told, df.schema)) == sorted(loop(sets)[0], key=repr)
    assert {r.txid for r in known.collect() if r.live} == loop(sets)[1]


def test_no_snapshots(spark):
    assert pool.changes(spark.createDataFrame([], KIND), EVERY).count() == 0
