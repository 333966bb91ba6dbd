"""Whitening of vectors from their exact scatter, summed as residues.

Entries become whole numbers, x = floor(UNITS * entry) + SHIFT. With n vectors and sums S, the centred n x - S are whole numbers
too, and so is their scatter. It outgrows 64 bits, so each partition multiplies residues modulo several primes: factors are so
small that a product of matrices of doubles is exact, and sums over all partitions reconstruct the scatter by the Chinese
remainder theorem, whatever the order in which Spark adds them. Only the last step, the eigenvectors, is in double precision. The table
is read once each for the sums, the scatter, the check of the whitened rows and the rows themselves; nothing of its size is
shuffled or kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed parts of the scale: units of an entry, and what is added.
UNITS, SHIFT = 1024, 100_000
#: Bits of a prime (largest first), and rows multiplied at once: a sum of ROWS products of two residues stays below 2**53.
PRIME_BITS, ROWS = 20, 4096
#: Components, the share of the trace below which a component counts as empty, and the largest size of a scaled entry.
COMPONENTS, EMPTY, LARGEST = 8, 1e-12, float(2**62)


def primes(product: int) -> list[int]:
    """The largest primes of PRIME_BITS bits, so many that their product is beyond ``product``."""
    out, p, so_far = [], 1 << PRIME_BITS, 1
    while so_far <= product:
        p -= 1
        if p % 2 and all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            so_far *= p
    return out


def reconstruct(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """Whole numbers between -M/2 and M/2, M the product of the moduli, from their residues (a row a modulus)."""
    total = math.prod(moduli)
    parts = [total // p * pow(total // p, -1, p) for p in moduli]
    out = []
    for column in residues.T.tolist():
        v = sum(r * x for r, x in zip(column, parts, strict=True)) % total
        out.append(v - total if 2 * v > total else v)
    return out


@dataclass
class Scatter:
    """Of the fitted vectors: their number, sums by dimension (whole numbers), the greatest size of n x - S, and its scatter."""

    n: int
    sums: list[int]
    most: int
    scatter: np.ndarray  # of Python's whole numbers


@dataclass
class Whitening:
    """Unit eigenvectors (a column each) of the covariance of x by falling eigenvalue, the eigenvalues, and the trace."""

    scatter: Scatter
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v) of all rows; which of them take part is found where they are read."""
    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v"))


def scaled(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, x as rows of ``size``, or of the longest vector's) of the rows that take part, some at a time.

    Vectors that are null or hold an entry that is null, not finite, or too large for x to be a long take no part. Shorter ones
    end in zeros, so in SHIFT.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            lists = b.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * UNITS  # nulls become NaN
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            fine = lists.is_valid().to_numpy(zero_copy_only=False)
            fine[row[~(np.abs(flat) < LARGEST)]] = False
            kept = fine[row]
            x = np.full((len(counts), int(counts[fine].max(initial=0)) if size is None else size), SHIFT, np.int64)
            x[row[kept], place[kept]] = np.floor(flat[kept]).astype(np.int64) + SHIFT
            yield b.column(0).filter(pa.array(fine)), x[fine]


def totals(rows: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """(number, sums, least, greatest) by dimension over all rows that take part.

    A partition sums the upper and lower halves of the numbers apart, so that neither overflows; Spark adds those in decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((5, 0), np.int64), 0  # rows, upper sums, lower sums, least, greatest
        for _, x in scaled(batches):
            n += len(x)
            wider = x.shape[1] - total.shape[1]
            if wider > 0:
                total = np.concatenate([total, np.repeat(np.array([[0], [0], [0], [SHIFT], [SHIFT]]), wider, 1)], 1)
            own, d = total[:, : x.shape[1]], x.shape[1]
            if len(x) and d:
                own[3] = np.where(own[0] > 0, np.minimum(own[3], x.min(0)), x.min(0))
                own[4] = np.where(own[0] > 0, np.maximum(own[4], x.max(0)), x.max(0))
                own[0] += len(x)
                own[1] += (x >> 31).sum(0)
                own[2] += (x & (2**31 - 1)).sum(0)
        dims = np.arange(-1, total.shape[1], dtype=np.int32)  # -1: the rows themselves
        columns = np.concatenate([[[n], [0], [0], [0], [0]], total], 1)
        yield pa.RecordBatch.from_arrays([pa.array(dims), *map(pa.array, columns)], names=["d", "n", "upper", "lower", "a", "b"])

    each = rows.mapInArrow(run, "d int, n long, upper long, lower long, a long, b long").filter("n > 0")
    add = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = each.groupBy("d").agg(F.sum("n").alias("n"), add("upper"), add("lower"), F.min("a").alias("a"), F.max("b").alias("b")).orderBy("d").collect()  # a row a dimension
    if not found:
        return 0, [], [], []
    n, found = found[0].n, found[1:]
    sums = [(int(r.upper) << 31) + int(r.lower) + (n - r.n) * SHIFT for r in found]
    low, high = [min(r.a, SHIFT) if r.n < n else r.a for r in found], [max(r.b, SHIFT) if r.n < n else r.b for r in found]
    return n, sums, low, high


def centred(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n x - S modulo p, as doubles."""
    return (((n % p) * (x % p) - np.array([s % p for s in sums], np.int64)) % p).astype(np.float64)


def fit(rows: DataFrame) -> Scatter:
    """The exact scatter of ``prepared`` rows: a residue matrix a partition and prime, summed by Spark, reconstructed here."""
    n, sums, low, high = totals(rows)
    d = len(sums)
    most = max((max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums, strict=True)), default=0)
    moduli = primes(2 * n * most * most)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), len(upper[0])), np.int64)
        seen = False
        for _, x in scaled(batches, d):
            seen = True
            for k, p in enumerate(moduli):
                y = centred(x, n, sums, p)
                total[k] = (total[k] + ((y.T @ y)[upper] % p).astype(np.int64)) % p
        if seen:
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[k])], names=["prime", "cell", "residue"])

    parts = rows.mapInArrow(run, "prime int, cell int, residue long")
    found = parts.groupBy("prime", "cell").agg(F.sum("residue").alias("r")).collect()  # half a square of the dimensions a prime
    residues = np.zeros((len(moduli), len(upper[0])), np.int64)
    for r in found:
        residues[r.prime, r.cell] = r.r % moduli[r.prime]
    exact = np.zeros((d, d), object)
    exact[upper] = exact.T[upper] = reconstruct(residues, moduli) if moduli else 0
    return Scatter(n, sums, most, exact)


def eigen(s: Scatter) -> Whitening:
    """Components of the covariance, the scatter of n x - S over n cubed, each entry rounded once."""
    d, cube = len(s.sums), max(s.n, 1) ** 3
    v = np.array([[x / cube for x in row] for row in s.scatter.tolist()], np.float64).reshape(d, d)
    values, vectors = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
    return Whitening(s, vectors[:, ::-1], values[::-1], sum(s.scatter[i, i] for i in range(d)) / cube)


def parts_of(w: Whitening, x: np.ndarray, some: int) -> np.ndarray:
    """The first components of x - S/n over the roots of their eigenvalues (rows x components); NaN where a component is empty."""
    n, s = w.scatter.n, w.scatter.sums
    if w.scatter.most < 2**62 and n * int(np.abs(x).max(initial=0)) < 2**62:
        y = (n * x - np.array(s, np.int64)) / float(n)
    else:
        y = np.array([[(n * c - t) / n for c, t in zip(row, s, strict=True)] for row in x.tolist()], np.float64).reshape(x.shape)
    full = w.values[:some] > EMPTY * max(w.trace, 0)
    with np.errstate(all="ignore"):
        return np.where(full, y @ w.vectors[:, :some] / np.sqrt(w.values[:some]), np.nan)


def deviations(s: Scatter, x: np.ndarray) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 of each row."""
    if s.most**2 * max(len(s.sums), 1) < 2**63 and s.n * int(np.abs(x).max(initial=0)) < 2**63:
        y = s.n * x - np.array(s.sums, np.int64)
        return (y * y).sum(1).tolist()
    moduli = primes(2 * len(s.sums) * s.most**2)
    squares = np.stack([(centred(x, s.n, s.sums, p).astype(np.int64) ** 2 % p).sum(1) % p for p in moduli])
    return reconstruct(squares, moduli)


def identity_error(rows: DataFrame, w: Whitening, some: int) -> float:
    """The largest entry, by size, of the covariance of the whitened rows minus the identity, over components that aren't empty.

    Measured on the rows: sums of products a partition, added by Spark. Whitened rows are centred, as n x - S sum to zero.
    """
    d = len(w.scatter.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((some, some))
        for _, x in scaled(batches, d):
            p = parts_of(w, x, some)
            total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(some * some, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"])

    found = rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    off = [abs(r.v / w.scatter.n - (r.cell // some == r.cell % some)) for r in found]
    return max((x for x in off if x == x), default=0.0)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each row that takes part and each of the first components: key, ``component`` (from 1), ``n``, ``deviation`` (a
    decimal: the exact sum of (n x - S)^2), ``whitened``, ``explained`` (eigenvalue over trace), ``identity_error`` (one value).

    Vectors that are null or hold an entry that is null, not finite, or too large for a long take no part. Shorter vectors end in
    zeros; there are no more components than dimensions. Where all vectors agree along a component, ``whitened`` is null, and
    ``explained`` is null if they agree in all. Repeated rows and null keys stay, other columns are ignored, no rows give no rows.
    """
    rows = prepared(df, key, vector)
    w = eigen(fit(rows))
    d = len(w.scatter.sums)
    some = min(components, d)
    error = identity_error(rows, w, some) if some else 0.0
    explained = [float(v / w.trace) if w.trace > 0 else None for v in w.values[:some]]
    n = w.scatter.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x in scaled(batches, d) if some else ():
            keys = k.take(pa.array(np.repeat(np.arange(len(x)), some)))
            flat = parts_of(w, x, some).ravel()
            off = pa.array([str(v) for v in deviations(w.scatter, x)], pa.string()).take(pa.array(np.repeat(np.arange(len(x)), some)))
            columns = [keys, pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(x))), off, pa.array(flat, mask=np.isnan(flat)), pa.array(explained * len(x), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "component", "deviation", "whitened", "explained"])

    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, component int, deviation string, whitened double, explained double")
    n_, error_ = F.lit(n).cast("long"), F.lit(error)
    return out.select(F.col("k").alias(key), "component", n_.alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", error_.alias("identity_error"))
