"""Best-fit packing of token sequences by a grouping genetic algorithm on islands with elite migration.

Documents become pieces of at most ``capacity`` ids. Pieces are dealt by a hash into regions of about REGION pieces, and
each region is solved by ISLANDS islands. An island's individuals are packings (groups of pieces, a group a bin): one is
best-fit decreasing, the others best fit in other orders. Crossover injects the best filled bins of one parent into the other,
removes the bins that held the same pieces, lets displaced pieces replace shorter ones where they fill a bin better, and puts
the rest back by best fit. After each epoch every island's elite migrates
to the next island of its region (a Spark join), and the best packing of a region wins in the end. Pieces of equal length
are interchangeable, so an individual is a list of bins of lengths and the pieces' identities never leave Spark until the
lengths are dealt out again.

Bins that stay below FULL of the capacity are opened again, and their pieces packed together with those of other regions, as
long as they take fewer bins then; so the loss of dealing pieces out doesn't grow with the number of regions, which stay small.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import string
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .words import Recent, held, release, texts

CAPACITY = 2048
#: Pieces of a region, islands of a region, individuals of an island, and epochs.
REGION, ISLANDS, INDIVIDUALS, EPOCHS = 8192, 3, 8, 4
#: Crossovers of an island in an epoch: so many pieces are handled, but for these bounds.
BUDGET, FEWEST, MOST = 100_000, 10, 200
#: An island ends its epoch after so many crossovers in a row that don't better its elite.
IDLE = 25
#: A bin below this share of the capacity is opened again while there is more than one region.
FULL = 0.995
#: Words whose ids are put together at once; ASCII symbols that may follow the letters of a word, and how many runs of them are kept.
WORDS, SYMBOLS, TAILS = 1 << 18, string.punctuation.encode(), 4096
#: Further deals of loosely filled bins that are tried after one that gained nothing.
DEALS = 2


# ------------------------------------------------------------------------------------------------- documents to pieces


def encoder(path: str):
    """bytes of whole texts to their ids as little-endian unsigned 32-bit integers.

    The tokenizer never joins across white space, so each distinct word is encoded once. Words of letters, with ASCII symbols
    behind, need none of its normalising and splitting: they go to its model at once, many in one string.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole, model = Tokenizer.from_file(path), Tokenizer.from_file(path)
    model.normalizer, model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
    last = np.zeros(whole.get_vocab_size(), bool)  # ids that end a word
    last[[i for t, i in whole.get_vocab().items() if t.endswith("</w>")]] = True
    shown = {b: c for b, c in _byte_characters().items() if ord(c) != b and b != ord(" ")}
    tails: dict[bytes, bytes] = {b"": b""}

    def plain(words: str) -> Iterator[bytes]:
        ids = np.array(model.encode_batch_fast([words], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(last[ids]) + 4).tolist()
        flat = ids.tobytes()
        return (flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))

    def tail_ids(tail: bytes) -> bytes:
        if tail not in tails:
            ids = array("I", whole.encode(tail.decode(), add_special_tokens=False).ids).tobytes()
            if len(tails) >= TAILS:
                return ids
            tails[tail] = ids
        return tails[tail]

    def work_out(words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        lettered, rest = [], []  # words of letters: the place, the letters in lower case, and what comes behind
        ids: dict[bytes, bytes | None] = {}  # of letters in lower case
        easy, accented = [], []
        for i, w in enumerate(words):
            core = w.rstrip(SYMBOLS)
            if core.isalpha():  # of ASCII
                low, group = core.lower(), easy
            elif core.isascii():
                rest.append((i, w.decode()))
                continue
            else:
                text = core.decode("utf-8", "replace")
                if not text.isalpha() or not (lower := text.lower()).isalpha() or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
                    rest.append((i, w.decode("utf-8", "replace")))
                    continue
                low, group = lower.encode(), accented
            lettered.append((i, low, w[len(core) :]))
            if low not in ids:
                ids[low] = known = None if low == w else recent.get(low)
                if known is None:
                    group.append(low)
        for group, joined in ((easy, b" ".join(easy).decode()), (accented, b" ".join(accented).decode("latin-1").translate(shown))):
            if group:
                ids.update(zip(group, plain(joined), strict=True))
        for i, low, tail in lettered:
            out[i] = ids[low] + tail_ids(tail) if tail else ids[low]
        for (i, _), e in zip(rest, whole.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    recent = Recent(work_out, slice_=32_000)

    def encode(batch: list[bytes]) -> Iterator[bytes]:
        whole_texts = pa.array(batch, pa.binary())
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(batch), whole_texts.buffers()))  # at the space and U+0009 to U+000D
        coded = split.values.dictionary_encode()
        known = recent.values(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        which, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().tolist()
        at, first = 0, 0  # texts are put together about WORDS words at once, a longer one in parts
        while at < len(batch):
            end = max(at + 1, bisect.bisect_right(bounds, first + WORDS, at, len(batch)))
            parts, ends = [], [np.zeros(1, np.int64)]
            for a in range(first, bounds[end], WORDS):
                own = which[a : min(a + WORDS, bounds[end])]
                n = sizes[own]
                upto = np.cumsum(n)
                parts.append(flat[np.repeat(starts[own] - upto + n, n) + np.arange(upto[-1])].tobytes())
                ends.append(upto + ends[-1][-1])
            ids, cuts = b"".join(parts), np.concatenate(ends)[np.array(bounds[at : end + 1]) - first] * 4
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]
            at, first = end, bounds[end]

    return encode


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in order
    from U+0100."""
    own = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    others = [b for b in range(256) if b not in own]
    return own | {b: chr(256 + n) for n, b in enumerate(others)}


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Each row's pieces: the key, ``piece``, ``start``, ``length``, ``ids_crc32`` and, ``with_ids``, ``ids`` (binary).

    A row's ids are its text's ids followed by id 0; only rows of more than ``capacity`` ids are cut.
    """

    def run(batches):
        encode = held(("packing", tokenizer), lambda: encoder(tokenizer))  # a worker keeps what it learned from task to task
        for part, chunk in texts(batches, rows=4096, octets=8 << 20, keep=True):
            out: list[tuple] = []
            for k, ids in zip(part.column(0), encode(chunk), strict=True):
                ids += b"\0\0\0\0"
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((k.as_py(), n, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["k", "piece", "start", "length", "ids_crc32", "ids"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long, ids binary").withColumnRenamed("k", key)
    return out if with_ids else out.drop("ids")


# ------------------------------------------------------------------------------------- the genetic algorithm of an island


def best_fit(lengths: list[int], capacity: int, bins: list[list[int]] | None = None, as_given: bool = False) -> list[list[int]]:
    """``bins`` with ``lengths`` added, longest first or ``as_given``, each to the fullest bin that still takes it."""
    bins = [] if bins is None else bins
    room: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        room.setdefault(capacity - sum(b), []).append(i)
    spaces = sorted(room)
    for n in lengths if as_given else sorted(lengths, reverse=True):
        at = bisect.bisect_left(spaces, n)
        if at == len(spaces):
            bins.append([n])
            i, left = len(bins) - 1, capacity - n
        else:
            space = spaces[at]
            i = room[space].pop()
            bins[i].append(n)
            left = space - n
            if not room[space]:
                del room[space], spaces[at]
        if left:
            if left not in room:
                bisect.insort(spaces, left)
                room[left] = []
            room[left].append(i)
    return bins


def fewest(lengths: list[int], capacity: int) -> int:
    """A bound that no packing can have fewer bins than: by the sum of lengths, by how many pieces of over a j-th of the capacity a
    bin can hold, and by the room that long pieces leave for others."""
    x = np.sort(np.asarray(lengths, np.int64))
    if not len(x):
        return 0
    total = np.concatenate([[0], np.cumsum(x)])
    over = [-(-(len(x) - int(np.searchsorted(x, capacity // (j + 1), "right"))) // j) for j in range(1, 9)]
    k = np.unique(x[2 * x <= capacity])  # pieces of k or more and up to half a bin, beside those that leave room for k
    low, half, high = np.searchsorted(x, k), np.searchsorted(x, capacity // 2, "right"), np.searchsorted(x, capacity - k, "right")
    room = (high - half) * capacity - (total[high] - total[half])
    beside = len(x) - half + np.maximum(0, -(-(total[half] - total[low] - room) // capacity))
    return max(math.ceil(int(total[-1]) / capacity), *over, *beside.tolist())


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then unevenly filled ones, whose emptiest bins are the next to vanish."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """``a`` with a share of ``b``'s best filled bins injected whole; what they displace is put back by replacement and best fit."""
    ranked = sorted(range(len(b)), key=lambda i: (-sum(b[i]), rng.random()))
    injected = [b[i] for i in sorted(ranked[: max(1, int(len(b) * rng.uniform(0.1, 0.5)))])]
    double = Counter(n for x in injected for n in x)
    kept, displaced = [], []
    order = sorted(range(len(a)), key=lambda i: (sum(a[i]), rng.random()))  # worst filled bins give up their pieces first
    for i in order:
        if any(double[n] for n in a[i]):
            for n in a[i]:
                if double[n]:
                    double[n] -= 1
                else:
                    displaced.append(n)
        else:
            kept.append(list(a[i]))
    replace(kept, displaced, capacity)
    return best_fit(displaced, capacity, [list(x) for x in injected] + kept)


def replace(bins: list[list[int]], displaced: list[int], capacity: int) -> None:
    """In place: where a displaced piece fills a bin better than a shorter one in it, they change places; the emptiest bins first."""
    displaced.sort()
    for own in bins:
        room = capacity - sum(own)
        if not room or not displaced:
            continue
        gain, piece, at = 0, 0, 0
        for n in set(own):
            k = bisect.bisect_right(displaced, n + room) - 1
            if k >= 0 and displaced[k] - n > gain:
                gain, piece, at = displaced[k] - n, n, k
        if gain:
            own[own.index(piece)] = displaced.pop(at)
            bisect.insort(displaced, piece)


def mutate(bins: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Some of the emptiest bins and as many others are opened; their pieces go back by replacement and best fit."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    n = max(2, len(bins) // 50)
    opened = set(order[:n]) | set(rng.sample(range(len(bins)), min(len(bins), n)))
    kept, loose = [list(bins[i]) for i in order if i not in opened], [x for i in opened for x in bins[i]]
    replace(kept, loose, capacity)
    return best_fit(loose, capacity, kept)


def varied(lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A packing by best fit in an order that is only roughly from the longest to the shortest."""
    noise = rng.choice([0.05, 0.2, 1.0])
    return best_fit(sorted(lengths, key=lambda n: -n * (1 + noise * rng.random())), capacity, as_given=True)


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, rng: random.Random) -> list[list[int]]:
    """The elite of an island after an epoch. Stops as soon as no packing can have fewer bins."""
    least, idle = fewest(lengths, capacity), 0
    own = [(fitness(p, capacity), p) for p in population or [best_fit(lengths, capacity)]]
    best = lambda some: max(some, key=lambda x: x[0])
    first = best(own)[1]  # stays the elite until a packing takes fewer bins
    if len(first) == least:
        return first
    while len(own) < INDIVIDUALS:
        own.append((fitness(p := varied(lengths, capacity, rng), capacity), p))
    for _ in range(min(MOST, max(FEWEST, BUDGET // len(lengths)))):
        a, b = (best(rng.sample(own, 2))[1] for _ in range(2))  # tournaments
        child = crossover(a, b, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, capacity, rng)
        fit = fitness(child, capacity)
        worst = min(range(len(own)), key=lambda k: own[k][0])
        idle = 0 if fit > best(own)[0] else idle + 1
        if fit > own[worst][0] and all(fit != x[0] for x in own):
            own[worst] = (fit, child)
        if len(child) == least or idle == IDLE:
            break
    elite = best(own)[1]
    return first if len(first) == len(elite) else elite


def _flat(bins: list[list[int]]) -> tuple[list[int], list[int]]:
    return [n for b in bins for n in b], [len(b) for b in bins]


def _bins(flat, counts) -> list[list[int]]:
    out, at = [], 0
    for c in counts:
        out.append([int(x) for x in flat[at : at + c]])
        at += c
    return out


def epoch(islands: DataFrame, capacity: int, number: int) -> DataFrame:
    """islands (region, island, lengths, and elites as two array columns) after one epoch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                rng = random.Random(f"{r.region}/{r.island}/{number}")
                lengths = [int(x) for x in r.lengths]
                guests = [_bins(f, c) for f, c in ((r.own_flat, r.own_counts), (r.guest_flat, r.guest_counts)) if f is not None and len(f)]
                bins = evolve(lengths, guests, capacity, rng)
                rows.append((r.region, r.island, lengths, *_flat(bins), len(bins), fitness(bins, capacity)[1], len(bins) > fewest(lengths, capacity)))
            yield pd.DataFrame(rows, columns=["region", "island", "lengths", "flat", "counts", "n_bins", "shape", "open"])

    return islands.mapInPandas(run, "region long, island int, lengths array<int>, flat array<int>, counts array<int>, n_bins int, shape double, open boolean")


def solve(lengths: DataFrame, capacity: int) -> DataFrame:
    """(region, length, n) to the best packing of each region: (region, bin, length, slot)."""
    spark = lengths.sparkSession
    spread = lengths.groupBy("region").agg(F.flatten(F.collect_list(F.expr("array_repeat(length, n)"))).cast("array<int>").alias("lengths"))  # a region is bounded
    nothing = F.lit(None).cast("array<int>")
    # An island a task: each is some seconds of work and small to send.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    state = spread.select("region", F.explode(F.expr(f"sequence(0, {ISLANDS - 1})")).alias("island"), "lengths", nothing.alias("own_flat"), nothing.alias("own_counts"), nothing.alias("guest_flat"), nothing.alias("guest_counts"))
    had = None
    for number in range(EPOCHS):
        ran = cut(epoch(state.repartition(tasks, "region", "island"), capacity, number))
        bins = ran.groupBy("region").agg(F.min("n_bins").alias("n"), F.min("open").alias("open")).agg(F.sum("n").alias("n"), F.max("open").alias("open")).first()
        if not bins.open or bins.n == had:
            break  # no packing has fewer bins, or the last epoch found none
        had = bins.n
        if number + 1 < EPOCHS:
            guests = ran.select("region", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("flat").alias("guest_flat"), F.col("counts").alias("guest_counts"))
            state = ran.join(guests, ["region", "island"]).select("region", "island", "lengths", F.col("flat").alias("own_flat"), F.col("counts").alias("own_counts"), "guest_flat", "guest_counts")
    best = ran.groupBy("region").agg(F.max_by(F.struct("flat", "counts"), F.struct(-F.col("n_bins"), "shape", -F.col("island"))).alias("b")).select("region", "b.flat", "b.counts")
    bin_of = F.expr("flatten(transform(counts, (c, i) -> array_repeat(i + 1, c)))")  # of each piece of flat
    pieces_ = best.select("region", F.explode(F.arrays_zip(bin_of.alias("bin"), F.col("flat").alias("length"))).alias("x"))
    return pieces_.select("region", "x.bin", "x.length")


def assign(sized: DataFrame, capacity: int = CAPACITY, region: int = REGION) -> DataFrame:
    """``sized`` (uid long, unique; length int, at most ``capacity``) with ``sequence_id`` and ``offset`` for each."""
    whole = sized.filter(F.col("length") == capacity)  # alone in any packing
    done = whole.select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, turn, before = cut(sized.filter(F.col("length") < capacity).select("uid", F.col("length").cast("int"))), 0, None
    tried = 0
    while True:
        n = rest.count()
        regions = math.ceil(n / region) if n > 3 * region else 1
        dealt = rest.select("uid", "length").withColumn("region", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(regions)))
        packed = solve(dealt.groupBy("region", "length").agg(F.count("*").cast("int").alias("n")), capacity)
        same = W.partitionBy("region", "length")  # within a region, so bounded
        slots = packed.withColumn("nth", F.row_number().over(same.orderBy("bin")))
        placed = dealt.withColumn("nth", F.row_number().over(same.orderBy("uid"))).join(slots, ["region", "length", "nth"])
        placed = placed.select("uid", "length", (F.lit(turn).cast("long") * F.lit(1 << 56) + F.col("region") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"))
        inside = W.partitionBy("sequence_id")
        placed = cut(placed.withColumn("filled", F.sum("length").over(inside)).withColumn("offset", F.sum("length").over(inside.orderBy(F.desc("length"), "uid").rowsBetween(W.unboundedPreceding, -1))))
        placed = placed.withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
        bins = placed.filter("offset = 0")
        if before is not None and bins.count() >= before:  # packed together, they take no fewer; another deal is tried
            if regions == 1 or tried == DEALS:
                return done.unionByName(rest.select("uid", "sequence_id", "offset"))
            turn, tried = turn + 1, tried + 1
            continue
        if regions == 1:
            return done.unionByName(placed.select("uid", "sequence_id", "offset"))
        loose = F.col("filled") < FULL * capacity
        done = done.unionByName(placed.filter(~loose).select("uid", "sequence_id", "offset"))
        tried = 0
        rest, before, turn = placed.filter(loose).select("uid", "length", "sequence_id", "offset"), bins.filter(loose).count(), turn + 1
        if not before:
            return done


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: the key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null and empty texts are the single id 0. Repeated rows and null keys are rows like any other, other columns are
    ignored, no rows give no rows. No sequence exceeds ``capacity``; offsets in a sequence have no gaps.
    """
    # Equal (key, piece, start, length, crc) rows are interchangeable; a number within the task tells them apart.
    sized = cut(pieces(df, tokenizer, capacity, key, text, with_ids=False).withColumn("uid", F.monotonically_increasing_id()))
    return sized.join(assign(sized.select("uid", "length"), capacity), "uid").select(F.col(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
