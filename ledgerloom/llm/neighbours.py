"""Approximate nearest neighbours by NN-descent and greedy graph search, for the largest inner product.

The graph is one of inner products: a node's edges lead to the nodes with which its product is largest, whatever their
lengths, so long vectors become the hubs that such searches need. Equal vectors are one node, whose smallest ids stand for
it. Nodes are numbered part by part, a part being some thousand nodes that lie close on random hyperplanes. A first graph
comes from blocks of nodes on the same sides of further hyperplanes, and from the products with the longest vectors. It
improves by joins of neighbours of neighbours: every node gathers some of its neighbours and of those it is a neighbour of,
compares new ones with all, and sends each better pair to both ends. A query is a node of the graph: its search begins at
its own edges and expands, round by round, the best nodes that weren't expanded yet: their edges come back to its part, which
asks for the products with those that are no candidates yet. What is found is scored again in double precision on the
original vectors.

Everything travels as a row a part and message: ids first, and a vector goes to each part that asks for it once. Directions
are 16-bit floats, lengths and products 32-bit ones. A task holds one part and what it is sent, which is cut down to what
can matter before it is sent; messages for a part that very many ask are dealt over several copies of the part. The driver
sees counts, hyperplanes and the longest vectors, all of bounded number.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .words import release

#: Nodes of a part, bits of a node's number within its part, nodes of a block of the first graph, and such divisions into blocks.
PART, BITS, BLOCK, TABLES = 4096, 16, 1024, 24
#: Edges of a node, edges that a block and that the hubs give a node at first, hubs (the longest vectors).
DEGREE, OF_BLOCK, FIRST, HUBS = 40, 8, 16, 512
#: Members that a node gathers of each kind, rounds of NN-descent at most, and the share of edges that must change for another.
GATHERED, ROUNDS, CHANGED = 22, 6, 0.03
#: Candidates that a search keeps, nodes that it expands in a round, rounds at most, candidates that are scored again at least.
BREADTH, EXPANDED, SEARCH_ROUNDS, SCORED = 800, 240, 4, 160
#: Nodes asked of a part that are answered together.
ASKED_NODES = 1 << 16
#: Asked nodes of a part beyond which the part is copied; ten thousand parts at most are.
LOAD = 1 << 22
#: Rows of a key up to which it is never joined apart, and keys that are at most.
HOT_ROWS, HOT_KEYS = 4096, 1000
TOP, SEED = 20, 42

MESSAGE = "part long, kind int, n long, a binary, b binary, c binary, d binary, e binary, f binary"
NAMES = ["part", "kind", "n", *"abcdef"]
NODES, GRAPH, SENT = 0, 1, 2

I8, I4, F4, F2, I1, U2 = np.int64, np.int32, np.float32, np.float16, np.int8, np.uint16


# ----------------------------------------------------------------------------------------------------------- messages


def _row(part: int, kind: int, n: int, *columns: np.ndarray) -> pa.RecordBatch:
    binary = [pa.array([c.tobytes()], pa.binary()) for c in columns] + [pa.nulls(1, pa.binary())] * (6 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), *binary], names=NAMES)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of each run of equal ones of sorted keys."""
    if len(keys):
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True)


def _send(kind: int, to: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A message for each part of ``to`` (node numbers), with the rows of the columns that go to it."""
    part = to >> BITS
    by = np.argsort(part, kind="stable")
    part, columns = part[by], [c[by] for c in columns]
    for lo, hi in _runs(part):
        yield _row(int(part[lo]), kind, hi - lo, *(c[lo:hi] for c in columns))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(part, its rows as (part, kind, a, b, ...)), the rows sorted by part and kind; columns are bytes."""
    release()

    def rows() -> Iterator[tuple]:
        for b in batches:
            at = [b.schema.get_field_index(n) for n in NAMES]
            for i in range(b.num_rows):
                yield (b.column(at[0])[i].as_py(), b.column(at[1])[i].as_py(), *(b.column(k)[i].as_buffer() for k in at[3:]))

    return ((key[0], group) for key, group in itertools.groupby(rows(), key=lambda r: (r[0],)))


def _together(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows that aren't messages one by one, messages in lists of about ``most`` rows of theirs: what answers a list goes to a part
    in one message, so that messages don't multiply with each exchange."""
    held, have = [], 0
    for r in rows:
        if r[1] != SENT:
            yield [r]
            continue
        held.append(r)
        have += r[2].size // 8
        if have >= most:
            yield held
            held, have = [], 0
    if held:
        yield held


def _exchange(frames: list[DataFrame], run: Callable, parts: int, spread: bool = False) -> DataFrame:
    """The frames' rows by part, sorted by kind, through ``run``. ``spread``: the last frame's messages for parts that very many
    ask are dealt over copies of the other frames' rows."""
    *still, sent = (f.withColumn("salt", F.lit(0)) for f in frames)
    spark = sent.sparkSession
    hot = []
    if spread:
        sent = cut(sent)
        loads = sent.groupBy("part").agg(F.sum("n").alias("n"))
        total = loads.agg(F.sum("n")).first()[0] or 0
        bound = max(LOAD, total // 10_000)
        hot = loads.filter(F.col("n") > bound).collect() if total > bound else []  # 10,000 rows at most
    if hot:
        copies = F.broadcast(spark.createDataFrame([(r.part, math.ceil(r.n / bound)) for r in hot], "part long, copies int"))
        n = F.coalesce("copies", F.lit(1))
        sent = sent.join(copies, "part", "left").withColumn("salt", F.pmod(F.xxhash64("a"), n).cast("int")).drop("copies")
        still = [f.join(copies, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("copies") for f in still]
    every = reduce(DataFrame.unionByName, [*still, sent])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 4)
    # No more tasks than parts have rows, as each starts a Python worker.
    dealt = every.repartition(tasks, "part", "salt").coalesce(min(tasks, 2 * parts + 4))
    return dealt.sortWithinPartitions("part", "salt", "kind").mapInArrow(run, MESSAGE)


def _as(buffer: pa.Buffer | None, kind: type, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(buffer, kind) if buffer is not None and buffer.size else np.zeros(0, kind)
    return out if width is None else out.reshape(-1, width)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _by(first: np.ndarray, then: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The order by two columns of numbers from 0 and a mark of -1 to 2: that of one number, where they fit into one."""
    bits = [int(c.max(initial=0)).bit_length() for c in (first, then)]
    if sum(bits) + 2 > 63:
        return np.lexsort((mark, then, first))
    return np.argsort((first.astype(I8) << bits[1] | then) << 2 | (mark + I8(1)), kind="stable")


def _unknown(i: np.ndarray, j: np.ndarray, more_i: np.ndarray, more_j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of ``more`` that aren't among the first, in order of j and i."""
    new = np.arange(len(i) + len(more_i)) >= len(i)
    i, j = np.concatenate([i, more_i]), np.concatenate([j, more_j])
    bits = int(i.max(initial=0)).bit_length()
    if bits + int(j.max(initial=0)).bit_length() + 1 <= 63:  # plain numbers are sorted much faster
        key = np.sort((j << bits | i) << 1 | new)
        i, j, new = key >> 1 & ((1 << bits) - 1), key >> bits + 1, key & 1 > 0
    else:
        by = np.lexsort((new, i, j))
        i, j, new = i[by], j[by], new[by]
    new[1:] &= (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return i[new], j[new]


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, mark: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Each owner's ``most`` best distinct others, the best first; of equal pairs the one with the smaller mark stays."""
    by = _by(owner, other, mark)
    owner, other, score, mark = owner[by], other[by], score[by], mark[by]
    once = np.ones(len(by), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, score, mark = owner[once], other[once], score[once], mark[once]
    # Floats as whole numbers of the same order, the largest first; equal ones keep the order of the others.
    bits = (score + F4(0)).view(I4).astype(I8)
    fall = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) * -1 + 0x7FFFFFFF
    group = np.cumsum(np.concatenate([[False], owner[1:] != owner[:-1]])[: len(owner)])
    by = np.argsort(group << 32 | fall, kind="stable")
    by = by[_ranks(group[by]) < most]
    return owner[by], other[by], score[by], mark[by]


def _lists(rows: int, width: int, owner: np.ndarray, other: np.ndarray, score: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted edges as arrays of ``rows`` lines; lines that aren't full end in -1, minus infinity and 0."""
    at = (owner, _ranks(owner))
    others, scores, marks = np.full((rows, width), -1, I8), np.full((rows, width), -np.inf, F4), np.zeros((rows, width), I1)
    others[at], scores[at], marks[at] = other, score, mark
    return others, scores, marks


# -------------------------------------------------------------------------------------------------------------- nodes


def usable(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the rows that take part, and the number of components; shorter vectors end in zeros."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    dim = most or 1
    return rows if least == most else rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))), dim


def members_of(rows: DataFrame, keep: int) -> DataFrame:
    """(node, id, v, r): of each vector its ``keep`` smallest ids, numbered; the first is the node's name."""
    same = W.partitionBy("v")
    few = rows.withColumn("r", F.row_number().over(same.orderBy("id"))).filter(F.col("r") <= keep)
    return cut(few.withColumn("node", F.min("id").over(same)))


def joined(many: DataFrame, once: DataFrame, key: str) -> DataFrame:
    """``many`` joined with ``once`` (a row a key). Keys of very many rows, HOT_KEYS of them at most, are joined by broadcast, so
    that no task gets all rows of one."""
    counts = many.groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return many.join(once, key)
    hot = cut(once.join(F.broadcast(counts.filter(F.col("n") > bound).select(key)), key, "left_semi"))
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.join(F.broadcast(hot), key).unionByName(rest.join(once, key))


def _planes(vectors: DataFrame, bits: int, tables: int, dim: int) -> np.ndarray:
    """Hyperplanes (tables x bits x dim + 1) halfway between directions of random vectors, of which the driver sees so many."""
    need = 2 * bits * tables
    sample = _units(np.array([r.v for r in vectors.orderBy(F.xxhash64("node")).limit(need).collect()], float).reshape(-1, dim))
    rng = np.random.default_rng(SEED)
    a, b = (sample[rng.integers(len(sample), size=need // 2)] for _ in range(2))
    normal = a - b + 1e-3 * rng.standard_normal((need // 2, dim))
    return np.concatenate([normal, -(normal * (a + b) / 2).sum(1, keepdims=True)], 1).reshape(tables, bits, dim + 1).astype(F4)


def _units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever the size of their components."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _places(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the sides of all hyperplanes as one number, the distance from the last) of directions."""
    d = x @ planes[:, :-1].T + planes[:, -1]
    return ((d[:, :-1] > 0) @ (1 << np.arange(planes.shape[0] - 1, dtype=I8))).astype(I8), d[:, -1]


def nodes_of(members: DataFrame, asked: DataFrame, planes: np.ndarray, dim: int, size: int) -> DataFrame:
    """Parts (kind NODES): directions, lengths, names of nodes, and whether each is in ``asked`` (node).

    Lengths are over a power of two near the greatest component of all, which changes no order of products and keeps them in the
    range of small floats.
    """
    greatest = members.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    exponent = math.frexp(greatest or 1.0)[1]

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            length, unit = np.linalg.norm(np.ldexp(v, -exponent), axis=1), _units(v)
            code, far = _places(unit.astype(F4), planes)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(far), b.column(0), pa.array(length.astype(F4)), b.column(2), pa.array([r.tobytes() for r in unit.astype(F2)], pa.binary())], names=["code", "far", "node", "length", "asked", "vec"])

    def number(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task, turn, held = TaskContext.get().partitionId(), 0, []
        for b in itertools.chain(frames, [None]):
            held += [] if b is None else [b]
            have = sum(x.num_rows for x in held)
            while have >= PART or (b is None and have):
                t = pa.Table.from_batches(held)
                own, held = t.slice(0, PART), t.slice(PART).to_batches()
                vec = np.frombuffer(b"".join(own.column("vec").to_pylist()), F2)
                yield _row(task << 24 | turn, NODES, own.num_rows, vec, own.column("length").to_numpy(), own.column("node").to_numpy(), own.column("asked").to_numpy().astype(I1))
                turn, have = turn + 1, have - own.num_rows

    once = members.filter("r = 1").select("node", "v").join(asked.withColumn("asked", F.lit(True)), "node", "left").select("node", "v", F.coalesce("asked", F.lit(False)).alias("asked"))
    placed = once.mapInArrow(place, "code long, far float, node long, length float, asked boolean, vec binary")
    # Parts are of some thousand nodes however many tasks the session deals rows to: each part may send a message to every other.
    tasks = math.ceil(size / (0.85 * PART))
    dealt = placed.repartitionByRange(tasks, "code", "far", "node").coalesce(tasks)
    return cut(dealt.sortWithinPartitions("code", "far", "node").mapInArrow(number, MESSAGE))


def _hubs(nodes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, vectors) of the HUBS longest vectors."""

    def longest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(frames):
            for _, _, a, b, *_ in rows:
                length = _as(b, F4)
                top = np.argsort(-length, kind="stable")[:HUBS]
                for i in top.tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([part << BITS | i], pa.int64()), pa.array([length[i]], pa.float32()), pa.array([_as(a, F2, dim)[i].tobytes()], pa.binary())], names=["id", "length", "vec"])

    found = nodes.mapInArrow(longest, "id long, length float, vec binary").orderBy(F.desc("length"), "id").limit(HUBS).collect()
    vec = np.frombuffer(b"".join(r.vec for r in found), F2).reshape(-1, dim).astype(F4)
    return np.array([r.id for r in found], I8), vec * np.array([r.length for r in found], F4)[:, None]


# -------------------------------------------------------------------------------------------------------------- graph


def start(nodes: DataFrame, planes: np.ndarray, dim: int, degree: int, parts: int) -> DataFrame:
    """A first graph: everyone's best others in blocks of nodes on the same sides of hyperplanes, and among the hubs."""
    hub_ids, hubs = _hubs(nodes, dim)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(frames):
            for _, _, a, b, *_ in rows:
                x, length = _as(a, F2, dim), _as(b, F4)
                vec = pa.array([r.tobytes() for r in x], pa.binary())
                for k, own in enumerate(planes):
                    code, far = _places(x.astype(F4), own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, I4)), pa.array(code), pa.array(far), pa.array(part << BITS | np.arange(len(x))), pa.array(length), vec], names=["k", "code", "far", "id", "length", "vec"])

    def block(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            found = []
            for at in range(0, b.num_rows, BLOCK):
                t = b.slice(at, BLOCK)
                ids = t.column(3).to_numpy()
                x = np.frombuffer(b"".join(t.column(5).to_pylist()), F2).reshape(-1, dim).astype(F4) * t.column(4).to_numpy()[:, None]
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                n = min(OF_BLOCK, len(ids) - 1)
                if n > 0:
                    own, top = np.nonzero(s >= np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n, None])
                    own, top = (z[_ranks(own) < n] for z in (own, top))  # of equal products as many as there is room for
                    found.append((ids[own], ids[top], s[own, top]))
            if found:
                i, j, s = (np.concatenate(z) for z in zip(*found, strict=True))
                yield from _send(SENT, i, i, j, s)

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(frames):
            i, j, s, size = [], [], [], 0
            for _, kind, a, b, c, *_ in rows:
                if kind == NODES:
                    x = _as(a, F2, dim).astype(F4) * _as(b, F4)[:, None]
                    size, n = len(x), min(FIRST, len(hub_ids))
                    products = x @ hubs.T
                    top = np.argpartition(-products, n - 1, axis=1)[:, :n]
                    own = np.repeat(part << BITS | np.arange(size), n)
                    j.append(hub_ids[top.ravel()])
                    i.append(own)
                    s.append(np.take_along_axis(products, top, 1).ravel())
                else:
                    i.append(_as(a, I8))
                    j.append(_as(b, I8))
                    s.append(_as(c, F4))
            owner, other, score = np.concatenate(i), np.concatenate(j), np.concatenate(s)
            fine = owner != other
            owner, other, score = owner[fine] & ((1 << BITS) - 1), other[fine], score[fine]
            lists = _lists(size, degree, *_best(owner, other, score, np.ones(len(owner), I1), degree))
            yield _row(part, GRAPH, int(lists[2].sum()), *lists)

    dealt = nodes.mapInArrow(place, "k int, code long, far float, id long, length float, vec binary").repartitionByRange("k", "code", "far", "id").sortWithinPartitions("k", "code", "far", "id")
    return cut(_exchange([nodes, dealt.mapInArrow(block, MESSAGE)], merge, parts))


def _gathered(part: int, turn: int, others: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which edges of a part are gathered in a round: of each node at most GATHERED, fresh ones first, else at random."""
    order = np.random.default_rng((SEED, part, turn)).random(others.shape, F4) + np.where(others < 0, F4(9), 1 - fresh)
    chosen = np.zeros(others.shape, bool)
    n = min(GATHERED, others.shape[1])
    np.put_along_axis(chosen, np.argpartition(order, n - 1, axis=1)[:, :n], True, 1)
    return chosen & (others >= 0)


MEMBER = np.dtype([("centre", "<i8"), ("at", "<i4"), ("fresh", "i1"), ("side", "i1")])


def descend(nodes: DataFrame, graph: DataFrame, dim: int, degree: int, parts: int, edges: int) -> DataFrame:
    """The graph after NN-descent."""
    for turn in range(ROUNDS):

        def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _parts(frames):
                for _, _, a, b, c, *_ in rows:
                    others, scores, fresh = _as(a, I8, degree), _as(b, F4, degree), _as(c, I1, degree)
                    yield _row(part, GRAPH, 0, scores[:, -1].copy())
                    chosen = _gathered(part, turn, others, fresh)
                    i = (part << BITS | np.arange(len(others)))[np.nonzero(chosen)[0]]
                    j, new = others[chosen], fresh[chosen]
                    yield from _send(SENT, j, j, i, new, np.zeros(len(i), I1))
                    # The other way round: of one part's nodes, a centre hears of at most GATHERED, whatever their number.
                    by = np.lexsort((np.random.default_rng((turn, part)).random(len(j)), 1 - new, j))
                    by = by[_ranks(j[by]) < GATHERED]
                    i, j, new = i[by], j[by], new[by]
                    yield from _send(SENT, i, i, j, new, np.ones(len(i), I1))

        def fetch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _parts(frames):
                asked = []
                for _, kind, a, b, c, d, *_ in rows:
                    if kind == NODES:
                        vec, length = _as(a, F2, dim), _as(b, F4)
                    elif kind == GRAPH:
                        worst = _as(a, F4)
                    else:
                        asked.append((_as(a, I8), _as(b, I8), _as(c, I1), _as(d, I1)))
                if not asked:
                    continue
                node, centre, fresh, side = (np.concatenate(z) for z in zip(*asked, strict=True))
                by = np.argsort(centre >> BITS, kind="stable")
                node, centre, fresh, side = node[by], centre[by], fresh[by], side[by]
                for lo, hi in _runs(centre >> BITS):
                    once, at = np.unique(node[lo:hi], return_inverse=True)
                    own = once & ((1 << BITS) - 1)
                    members = np.zeros(hi - lo, MEMBER)
                    members["centre"], members["at"], members["fresh"], members["side"] = centre[lo:hi], at, fresh[lo:hi], side[lo:hi]
                    yield _row(int(centre[lo] >> BITS), SENT, hi - lo, once, vec[own], length[own], worst[own], members)

        def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide = 2 * GATHERED
            for part, rows in _parts(frames):
                got = [(_as(a, I8), _as(b, F2, dim), _as(c, F4), _as(d, F4), _as(e, MEMBER)) for _, _, a, b, c, d, e, _ in rows]
                ids, unit, length, worst = (np.concatenate([g[k] for g in got]) for k in range(4))
                shift = np.cumsum([0, *(len(g[0]) for g in got)])[:-1]
                members = np.concatenate([g[4] for g in got])
                at = members["at"] + np.repeat(shift, [len(g[4]) for g in got])
                x = unit.astype(F4) * length[:, None]
                # By centre and side, fresh ones first, else at random: one number, as its sorting is much faster.
                place = ((members["centre"] & ((1 << BITS) - 1)) << 1 | members["side"]) << 1 | (1 - members["fresh"])
                by = np.argsort(place << 32 | np.random.default_rng((turn, part)).integers(1 << 32, size=len(at)))
                members, at = members[by], at[by]
                keep = _ranks(members["centre"] * 2 + members["side"]) < GATHERED
                members, at = members[keep], at[keep]
                slot = _ranks(members["centre"])
                group = np.cumsum(slot == 0) - 1
                who, new = np.full((group[-1] + 1, wide), -1), np.zeros((group[-1] + 1, wide), bool)
                who[group, slot], new[group, slot] = at, members["fresh"] > 0
                out: list[tuple[np.ndarray, ...]] = []
                for lo in range(0, len(who), 128):
                    w, n = who[lo : lo + 128], new[lo : lo + 128]
                    v = np.where((w >= 0)[:, :, None], x[w], 0)
                    s = v @ v.transpose(0, 2, 1)
                    fine = (w[:, :, None] >= 0) & (w[:, None, :] >= 0) & (ids[w][:, :, None] != ids[w][:, None, :])
                    fine &= (n[:, :, None] | n[:, None, :]) & (s > worst[w][:, :, None])
                    g, i, j = np.nonzero(fine)
                    out.append((w[g, i], w[g, j], s[g, i, j]))
                i, j, s = (np.concatenate(z) for z in zip(*out, strict=True))
                i, j, s, _ = _best(i, j, s, np.zeros(len(i), I1), degree)
                yield from _send(SENT, ids[i], ids[i], ids[j], s)

        def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _parts(frames):
                more, size = [], 0
                for _, kind, a, b, c, *_ in rows:
                    if kind == GRAPH:
                        others, scores, fresh = _as(a, I8, degree), _as(b, F4, degree), _as(c, I1, degree)
                        # Edges that were gathered have met each other; the others keep their turn.
                        fresh = np.where(_gathered(part, turn, others, fresh), 0, fresh)
                        size, real = len(others), others >= 0
                        best = (np.nonzero(real)[0], others[real], scores[real], fresh[real].astype(I1))
                    else:
                        own = _as(a, I8) & ((1 << BITS) - 1)
                        more.append((own, _as(b, I8), _as(c, F4), np.ones(len(own), I1)))
                        if sum(len(m[0]) for m in more) > 1 << 21:
                            best, more = _best(*(np.concatenate(z) for z in zip(best, *more, strict=True)), degree), []
                best = _best(*(np.concatenate(z) for z in zip(best, *more, strict=True)), degree)
                lists = _lists(size, degree, *best)
                yield _row(part, GRAPH, int(lists[2].sum()), *lists)

        asked = graph.mapInArrow(gather, MESSAGE)
        told = _exchange([_exchange([nodes, asked], fetch, parts)], compare, parts)
        graph = cut(_exchange([graph, told], merge, parts))
        if (graph.agg(F.sum("n")).first()[0] or 0) <= CHANGED * edges:
            break
    return graph


# ------------------------------------------------------------------------------------------------------------- search


def search(nodes: DataFrame, graph: DataFrame, dim: int, degree: int, parts: int, keep: int = SCORED) -> DataFrame:
    """(query, node): numbers of the ``keep`` best candidates of greedy searches from the nodes that are asked for."""
    wide = max(BREADTH, degree, keep)

    def begin(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(frames):
            for _, kind, a, b, c, d, *_ in rows:
                if kind == NODES:
                    own = np.flatnonzero(_as(d, I1))
                    unit, length = _as(a, F2, dim)[own], _as(b, F4)[own]
                elif len(own):
                    others, scores = np.full((len(own), wide), -1, I8), np.full((len(own), wide), -np.inf, F4)
                    others[:, :degree], scores[:, :degree] = _as(a, I8, degree)[own], _as(b, F4, degree)[own]
                    yield _row(part, GRAPH, int((others >= 0).sum()), part << BITS | own, others, scores, np.zeros(others.shape, I1), unit, length)

    def ahead(others: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Which candidates are expanded next: the best that weren't."""
        todo = (others >= 0) & (done == 0)
        return todo & (np.cumsum(todo, 1) <= EXPANDED)

    def ask(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _parts(frames):
            for _, _, a, b, _, d, *_ in rows:
                others = _as(b, I8, wide)
                i, k = np.nonzero(ahead(others, _as(d, I1, wide)))
                yield from _send(SENT, others[i, k], others[i, k], _as(a, I8)[i])

    def hop(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _parts(frames):
            for some in _together(rows, ASKED_NODES):
                if some[0][1] == GRAPH:
                    others = _as(some[0][2], I8, degree)
                    continue
                node, query = (np.concatenate([_as(r[k], I8) for r in some]) for k in (2, 3))
                yield from _send(SENT, query, query, others[node & ((1 << BITS) - 1)])

    def choose(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Asks for the products of what was met and is no candidate yet, each node once a query."""
        for _, rows in _parts(frames):
            for some in _together(rows, ASKED_NODES):
                if some[0][1] == GRAPH:
                    query, others, worst = _as(some[0][2], I8), _as(some[0][3], I8, wide), _as(some[0][4], F4, wide)[:, -1]
                    unit, length = _as(some[0][6], F2, dim), _as(some[0][7], F4)
                    known = (np.nonzero(others >= 0)[0], others[others >= 0])
                    continue
                i = np.repeat(np.searchsorted(query, np.concatenate([_as(r[2], I8) for r in some])), degree)
                j = np.concatenate([_as(r[3], I8) for r in some])
                fine = (j >= 0) & (j != query[i])
                i, j = _unknown(*known, i[fine], j[fine])
                yield from deliver(j, i, query, worst, unit, length)

    def deliver(to: np.ndarray, i: np.ndarray, query: np.ndarray, worst: np.ndarray, unit: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Messages for sorted nodes from the queries ``i``, each with its queries' vectors once."""
        for lo, hi in _runs(to >> BITS):
            has = np.zeros(len(query), bool)
            has[i[lo:hi]] = True
            own, at = np.flatnonzero(has), np.cumsum(has) - 1
            yield _row(int(to[lo] >> BITS), SENT, hi - lo, (to[lo:hi] & ((1 << BITS) - 1)).astype(U2), at[i[lo:hi]].astype(U2), query[own], worst[own], unit[own], length[own])

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(frames):
            for _, kind, a, b, c, d, e, f in rows:
                if kind == NODES:
                    x = _as(a, F2, dim).astype(F4) * _as(b, F4)[:, None]
                    continue
                own, at, query, worst, q = _as(a, U2), _as(b, U2), _as(c, I8), _as(d, F4), _as(e, F2, dim).astype(F4) * _as(f, F4)[:, None]
                s = np.concatenate([np.einsum("ij,ij->i", x[own[k : k + 1024]], q[at[k : k + 1024]]) for k in range(0, len(own), 1024)])
                fine = s > worst[at]
                to = query[at[fine]]
                yield from _send(SENT, to, to, part << BITS | own[fine].astype(I8), s[fine])

    def update(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(frames):
            more, query = [], np.zeros(0, I8)
            for _, kind, a, b, c, d, e, f in rows:
                if kind == GRAPH:
                    query, others, scores, done, rest = _as(a, I8), _as(b, I8, wide), _as(c, F4, wide), _as(d, I1, wide), (_as(e, F2), _as(f, F4))
                    # Marks: -1 for expanded ones, so that they stay so if they are found again.
                    mark = np.where(ahead(others, done), -1, -done)
                    real = others >= 0
                    best = (np.nonzero(real)[0], others[real], scores[real], mark[real].astype(I1))
                else:
                    own = np.searchsorted(query, _as(a, I8))
                    more.append((own, _as(b, I8), _as(c, F4), np.zeros(len(own), I1)))
                    if sum(len(m[0]) for m in more) > 1 << 21:
                        best, more = _best(*(np.concatenate(z) for z in zip(best, *more, strict=True)), wide), []
            if len(query):
                best = _best(*(np.concatenate(z) for z in zip(best, *more, strict=True)), wide)
                others, scores, marks = _lists(len(query), wide, *best)
                yield _row(part, GRAPH, int(((others >= 0) & (marks == 0)).sum()), query, others, scores, -marks, *rest)

    state = cut(_exchange([nodes, graph], begin, parts))
    for _ in range(SEARCH_ROUNDS):
        if not state.agg(F.sum("n")).first()[0]:
            break
        met = _exchange([graph, state.mapInArrow(ask, MESSAGE)], hop, parts, spread=True)
        scored = _exchange([nodes, _exchange([state, met], choose, parts)], score, parts, spread=True)
        state = cut(_exchange([state, scored], update, parts))

    def pairs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _parts(frames):
            for _, _, a, b, *_ in rows:
                query, others = _as(a, I8), _as(b, I8, wide)[:, :keep]
                i, k = np.nonzero(others >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(query[i]), pa.array(others[i, k])], names=["query", "node"])

    return state.mapInArrow(pairs, "query long, node long")


def nearest(df: DataFrame, queries: DataFrame, k: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each id of ``queries`` (column of name ``key``).

    Queries are rows of ``df``. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without an id; where vectors differ in length, shorter ones count as ended by zeros. Of equal scores the smaller id
    comes first; equal vectors are different candidates; a row is no candidate of its own query. Rows repeated with their id
    are one row, of several vectors of an id the first in order of components stands. Other columns are ignored; no rows, or
    one alone, give no rows.
    """
    rows, dim = usable(df, key, vector)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    members = members_of(rows, k + 1)
    wanted = queries.select(F.col(f"`{key}`").cast("long").alias("id")).filter("id is not null").distinct()
    once = members.filter("r = 1").select("node", "v")
    mine = cut(rows.join(wanted, "id").select(F.col("id").alias("query"), "v"))
    asked = cut(joined(mine, once, "v").select("query", F.col("node").alias("start")))
    size = once.count()
    starts = asked.select("start").distinct()
    found = starts.select("start", F.col("start").alias("node"))
    if size > 1:
        bits = max(2, math.ceil(math.log2(size / BLOCK)) + 2) if size > BLOCK else 2
        planes = _planes(once, bits, TABLES + 1, dim)
        nodes = nodes_of(members, starts.select(F.col("start").alias("node")), planes[0], dim, size)
        parts = nodes.count()
        graph = descend(nodes, start(nodes, planes[1:], dim, DEGREE, parts), dim, DEGREE, parts, size * min(DEGREE, size - 1))

        def names(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, own in _parts(frames):
                for _, _, _, _, c, *_ in own:
                    name = _as(c, I8)
                    yield pa.RecordBatch.from_arrays([pa.array(part << BITS | np.arange(len(name))), pa.array(name)], names=["id", "name"])

        named = nodes.mapInArrow(names, "id long, name long")
        pairs = search(nodes, graph, dim, DEGREE, parts, max(SCORED, 2 * k + 2)).join(named.select(F.col("id").alias("node"), F.col("name").alias("to")), "node").join(named.select(F.col("id").alias("query"), F.col("name").alias("start")), "query")
        found = found.unionByName(pairs.select("start", F.col("to").alias("node")))
    # Each distinct vector is scored once, whatever the number of its queries; one place more than asked for, as a query may find itself.
    inner = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    exact = found.join(members.select("node", "id", "v"), "node").join(starts.join(once.select(F.col("node").alias("start"), F.col("v").alias("q")), "start"), "start")
    best = W.partitionBy("start").orderBy(F.desc("score"), "id")
    ranked = exact.select("start", "id", inner.alias("score")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    lists = ranked.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query")), 1, k)
    rows = joined(asked, cut(lists), "start").select("query", F.posexplode(others).alias("r", "x"))
    return rows.select(F.col("query").alias("query_id"), (F.col("r") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
