"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 values. Two fingerprints within RADIUS bits agree
on at least one of RADIUS + 1 bands of their 64 bits, so each fingerprint goes to one group for each band value; that
loses no pair. For more fingerprints there are more bands, of which pairs agree on several at once. Within a group the 64 bit planes are stored vertically, a 64-bit word for 64 members, and a member is
compared with all others at once: the XOR of plane and own bit is added to vertical carry-save counters (three planes that
count to 4 and one that holds an overflow), and a word of 64 members is abandoned once all of them exceed the radius.

Distinct fingerprints only are compared; a group gives a spanning forest of its links, not all pairs; groups above GROUP
members are dealt into tiles. Links become components by joins of ever smaller labels in Spark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import release, texts

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Members of a tile, and of a group as it is meant to be.
GROUP, CROWD = 4096, 256
#: Rows of a fingerprint over which it may be sent to all tasks.
HOT = 500


# --------------------------------------------------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text whose A-Z are lower-cased; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z alone, and splits at the space and U+0009 to U+000D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the values, each as often as it occurs."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Each row's key and ``fp`` (long, the 64 bits)."""

    def run(batches):
        for part, chunk in texts(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in chunk), np.uint64, len(chunk)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["k", "fp"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, fp long").withColumnRenamed("k", key)


# -------------------------------------------------------------------------------------------------------------- compare


def within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, counts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of left and right fingerprints that differ in at most ``radius`` (up to 7) bits.

    ``counts``: the members of each of several groups that follow one another in ``left`` and ``right``; pairs are of one
    group then. Groups are laid out in words of their own, so many small ones cost one pass.
    """
    n_left, n_right = counts or (np.array([len(left)]), np.array([len(right)]))
    n_words = -(-n_right // 64)
    first_word = np.cumsum(n_words) - n_words
    one = np.uint64(1)
    slot = np.repeat(first_word * 64 - (np.cumsum(n_right) - n_right), n_right) + np.arange(len(right))
    words = int(n_words.sum())
    padded, valid, back = np.zeros(words * 64, np.uint64), np.zeros(words * 64, bool), np.zeros(words * 64, np.int64)
    padded[slot], valid[slot], back[slot] = right, True, np.arange(len(right))
    lanes = one << np.arange(64, dtype=np.uint64)
    table = padded.reshape(words, 64)
    planes = np.stack([np.where((table >> np.uint64(b)) & one, lanes, np.uint64(0)).sum(1, dtype=np.uint64) for b in range(64)])
    valid = np.where(valid.reshape(words, 64), lanes, np.uint64(0)).sum(1, dtype=np.uint64)
    group = np.repeat(np.arange(len(n_left)), n_left)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    loads = np.cumsum(n_words[group])
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(loads, (loads[at - 1] if at else 0) + (1 << 19), "right")))
        own, each = left[at:end], n_words[group[at:end]]
        q = np.repeat(np.arange(len(own)), each)
        w = np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_word[group[at:end]], each)
        alive = valid[w]
        c1, c2, c3 = (np.zeros(len(q), np.uint64) for _ in range(3))
        for b in range(64):
            # The own bit as a full word: all ones if set.
            x = planes[b][w] ^ (np.uint64(0) - ((own[q] >> np.uint64(b)) & one))
            c1, x = c1 ^ x, c1 & x
            c2, x = c2 ^ x, c2 & x
            c3, x = c3 ^ x, c3 & x
            alive &= ~x  # beyond 7
            if b % 8 == 7:
                alive &= ~_over(c1, c2, c3, radius)
                live = np.flatnonzero(alive)
                if len(live) < len(alive):
                    q, w, alive, c1, c2, c3 = q[live], w[live], alive[live], c1[live], c2[live], c3[live]
                if not len(q):
                    break
        if len(q):
            bits = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(bits)
            found_i.append(at + q[row])
            found_j.append(back[w[row] * 64 + lane])
        at = end
    return np.concatenate(found_i), np.concatenate(found_j)


def _over(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count c1 + 2 c2 + 4 c3 is over the radius."""
    out = np.zeros_like(c1)
    for n in range(radius + 1, 8):
        out |= (c1 if n & 1 else ~c1) & (c2 if n & 2 else ~c2) & (c3 if n & 4 else ~c3)
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member that each of n members is linked with, through any links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that any two values within the radius agree under one of them: of radius + k blocks of bits, each choice of k.

    k is the smallest (at most 4) with which random values leave about CROWD or fewer of ``n`` in a group, so that groups don't
    grow with the table; every k finds the same links.
    """
    k = next((k for k in range(1, 4) if n >> (64 * k // (radius + k)) <= CROWD), 4)
    edges = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    every = [sum(c) for c in itertools.combinations(blocks, k)]
    return [m - (1 << 64) if m >> 63 else m for m in every]  # as signed longs


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a long, b long): links between distinct fingerprints ``fp`` that connect all that are within the radius."""
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks(fps.count(), radius))))
    rows = fps.select("fp", F.explode(bands).alias("b")).select("fp", "b.band", "b.part")
    sizes = rows.groupBy("band", "part").agg(F.count("*").alias("n")).filter("n > 1")
    # A group above GROUP members is dealt into tiles, and each pair of tiles is compared in a task of its own.
    tiles = sizes.withColumn("tiles", F.ceil(F.col("n") / GROUP).cast("int")).drop("n")
    dealt = rows.join(tiles, ["band", "part"]).withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.withColumn("other", other).select("fp", "band", "part", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for fp, counts, same in _groups(batches):
            if same:
                i, j = within(fp, fp, radius, (counts, counts))
                keep = i < j
                i, j = i[keep], j[keep]
            else:
                i, j = within(fp[: counts[0]], fp[counts[0] :], radius)
                j = j + counts[0]
            label = forest(i, j, len(fp))
            i = np.flatnonzero(label != np.arange(len(fp)))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[label[i]].view(np.int64))], names=["a", "b"])

    keys = ("band", "part", "x", "y")
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "tile").mapInArrow(run, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Sorted rows to (fingerprints, members of each group, True) for whole groups of one tile, many at a time, and to
    (fingerprints, members of either tile, False) for a pair of tiles. Rows of a group may span batches.
    """
    held = np.zeros((0, 6), np.int64)
    for batch in batches:
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, n in enumerate(batch.schema.names)}
        rows = np.concatenate([held, np.stack([cols[n] for n in ("band", "part", "x", "y", "tile", "fp")], 1)])
        ends = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
        whole = int(ends[-1]) if len(ends) else 0
        yield from _split(rows[:whole])
        held = rows[whole:]
    yield from _split(held)


def _split(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    if not len(rows):
        return
    same = rows[:, 2] == rows[:, 3]
    for part, one_tile in ((rows[same], True), (rows[~same], False)):
        if not len(part):
            continue
        bounds = np.concatenate([[0], np.flatnonzero((part[1:, :4] != part[:-1, :4]).any(1)) + 1, [len(part)]])
        fp = np.ascontiguousarray(part[:, 5]).view(np.uint64)
        if one_tile:
            yield fp, np.diff(bounds), True
            continue
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            mine = part[lo:hi, 4] == part[lo, 2]
            yield np.concatenate([fp[lo:hi][mine], fp[lo:hi][~mine]]), np.array([mine.sum(), (~mine).sum()]), False


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, label): the smallest node reachable. Alternates joining neighbours' and labels' labels."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        stepped = labels.join(near, "node").select("node", F.least("label", "l").alias("new"), F.col("label").alias("old"))
        jump = stepped.select(F.col("node").alias("new"), F.col("new").alias("far"))
        jumped = cut(stepped.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        moved = jumped.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels


def near_duplicates(df: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Each row's key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable by links.

    Null and empty texts, and texts without a word, have fingerprint zero and are linked like any other. A text of fewer
    words than a shingle is one shingle. Repeated rows and null keys stay (a null key is never a component's name unless it
    has no other); other columns are ignored; no rows give no rows.
    """
    prints = cut(fingerprints(df, key, text, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    of = components(links(classes.select("fp"), radius))
    named = classes.join(of, classes["fp"] == of["node"]).select("fp", "label", "least")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    every = cut(classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    # Fingerprints of very many rows, of which there are 10,000 at most, go to the rows; the others' rows go to them.
    total = classes.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") > HOT) & (F.col("n") * 10_000 > total)
    hot, cold = F.broadcast(every.filter(often).select("fp", "component_id")), every.filter(~often).select("fp", "component_id")
    named = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    return named.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
