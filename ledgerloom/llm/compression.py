"""Quality by compression: what a text costs under a dictionary of good texts against what it costs under one of bad texts.

Both zstandard dictionaries are built from a bounded sample of blocks of labelled texts. A whole text is compressed block by
block under either, so that each block is held against the dictionary and not against the text before it. The difference of
both sizes over the text's own becomes a probability by a logistic curve, fitted to all labelled texts that gave no blocks.
A difference counts by how well the text compresses at all, as one that repeats itself costs next to nothing under either
dictionary, so the curve also has the size under the good one over the text's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import texts

#: Bytes of a block; blocks that a dictionary is built from at most (those with the smallest hashes); its bytes; the level.
BLOCK, FIT_BLOCKS, DICT_BYTES, LEVEL = 512, 8192, 65_536, 3
#: Steps of a difference and of a size (over the text's own) for the fit, which is thus over a bounded number of cells, and the
#: weight that holds the slopes back where labels are few.
STEPS, SIZE_STEPS, RIDGE = 2048, 256, 1e-3
#: Fixed parameters of the dictionary builder: bytes of a segment and of a d-mer.
SEGMENT, MER = 64, 8


@dataclass
class Classifier:
    """Dictionaries of good and bad texts (empty: none), the curve (slopes of difference and size, offset; none: flat), and what a
    text without evidence gets."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float] | None
    prior: float


def dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary of ``blocks``: a trained one, or, of too few blocks to train on, their last bytes as they are."""
    blocks = [b for b in blocks if len(b) >= MER]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, k=SEGMENT, d=MER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:]


def compressor(of: bytes) -> zstandard.ZstdCompressor:
    if not of:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    d = zstandard.ZstdCompressionDict(of)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def measure(df: DataFrame, good: bytes, bad: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key ``k``, a hash ``h`` of its text, its bytes ``n``, and the sizes ``g`` and ``b`` of its blocks under either dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under = [compressor(d).compress for d in (good, bad)]
        for part, chunk in texts(batches):
            sizes = np.zeros((2, len(chunk)), np.int64)
            for i, t in enumerate(chunk):
                blocks = [t[a : a + BLOCK] for a in range(0, len(t), BLOCK)]
                for k, size in enumerate(under):
                    sizes[k, i] = sum(len(size(x)) for x in blocks)
            n = pa.array([len(t) for t in chunk], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array(sizes[0]), pa.array(sizes[1])], names=["k", "h", "n", "g", "b"])

    rows = _rows(df, key, text).select("k", "h", "text")
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, h long, n long, g long, b long")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("binary")
    return df.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.coalesce(body, F.lit(b""))).alias("h"), body.alias("text"))


def labelled(df: DataFrame, labels: DataFrame, key: str, text: str, quality: str) -> DataFrame:
    """(h, n, good) of the distinct texts that have a label and a byte. A text labelled more than once is good if any label says so."""
    marks = labels.select(F.col(f"`{key}`").alias("k"), (F.col(f"`{quality}`") != 0).alias("good")).filter("k is not null and good is not null")
    marks = marks.groupBy("k").agg(F.max("good").alias("good"))
    rows = _rows(df, key, text).select("k", "h", F.octet_length("text").cast("long").alias("n")).filter("n > 0")
    return rows.join(marks, "k").groupBy("h").agg(F.max("n").alias("n"), F.max("good").alias("good"))


def gives_blocks(h: Column) -> Column:
    """Whether a text is for the dictionaries, and not for the curve: one bit of its hash, so copies are on one side."""
    return h.bitwiseAND(1) == 0


def sample(df: DataFrame, known: DataFrame, key: str, text: str) -> tuple[list[bytes], list[bytes]]:
    """(blocks of good texts, blocks of bad ones), FIT_BLOCKS of each at most, of all blocks those with the smallest hashes."""
    each = known.filter(gives_blocks(F.col("h"))).select("h", "good", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("at"))
    by_hash = (F.xxhash64("h", "at"), "h", "at")
    picks = [each.filter(F.col("good") == good).orderBy(*by_hash).limit(FIT_BLOCKS) for good in (True, False)]
    chosen = cut(picks[0].unionByName(picks[1]))  # at most twice FIT_BLOCKS rows of three numbers, so they're sent to all tasks
    block = F.expr(f"substring(text, cast(at * {BLOCK} + 1 as int), {BLOCK})")
    rows = _rows(df, key, text).join(F.broadcast(chosen), "h").groupBy("h", "at", "good").agg(F.first(block).alias("block"))
    found = sorted(((r.h, r["at"], r.good, bytes(r.block)) for r in rows.collect()), key=lambda r: r[:2])
    return [r[3] for r in found if r[2]], [r[3] for r in found if not r[2]]


def difference() -> Column:
    """How many bytes a text of ``n`` bytes saves under the good dictionary, over n."""
    return (F.col("b") - F.col("g")) / F.col("n")


def good_share() -> Column:
    """The size under the good dictionary, over n."""
    return F.col("g") / F.col("n")


def fit_curve(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Slopes of the columns of ``x`` and offset of the logistic curve through counts of good and bad texts, by Newton's method.

    Targets are drawn in by one text a class, so the curve stays finite where the classes part.
    """
    hits, misses, weight = good.sum(), bad.sum(), good + bad
    target = (good * (hits + 1) / (hits + 2) + bad / (misses + 2)) / weight
    centre = np.average(x, axis=0, weights=weight)
    spread = np.maximum(np.sqrt(np.average((x - centre) ** 2, axis=0, weights=weight)), 1e-9)
    rows = np.concatenate([(x - centre) / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(rows.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        uphill = rows.T @ (weight * (target - p)) - RIDGE * w
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(len(w)), uphill)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - slopes @ centre)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Each row's key, ``n_bytes``, ``good_bytes`` and ``bad_bytes`` (its blocks under either dictionary) and ``score``: the
    probability that it is good.

    ``labels``: key and quality (0 bad, others good, null unlabelled) of the rows that may be learned from. Null and empty texts
    have no evidence: they score as many good texts as there are among those labelled, and so does every row if there are no good
    or no bad ones (0.5 without labels). Repeated rows and null keys stay (null keys have no label), other columns are ignored, no
    rows give no rows.
    """
    return score(*learn(df, labels, key, text, quality), key)


def learn(df: DataFrame, labels: DataFrame, key: str, text: str, quality: str) -> tuple[DataFrame, Classifier]:
    """(``measure`` of every row; the classifier)."""
    known = cut(labelled(df, labels, key, text, quality))
    of = dict(known.groupBy("good").count().collect())
    prior = of.get(True, 0) / sum(of.values()) if of else 0.5
    good, bad = map(dictionary, sample(df, known, key, text))
    measured = cut(measure(df, good, bad, key, text))
    inside = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))
    cell = [F.round(inside(difference()) * STEPS).cast("int").alias("step"), F.round(inside(good_share()) * SIZE_STEPS).cast("int").alias("size")]
    once = measured.filter("n > 0").groupBy("h").agg(*(F.max(c).alias(c) for c in "ngb"))
    rows = once.join(known.filter(~gives_blocks(F.col("h"))).select("h", "good"), "h").groupBy(*cell).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = np.array(sorted(tuple(r) for r in rows.collect()), np.float64).reshape(-1, 4)  # a row a cell
    curve = None
    if good and bad and counts[:, 2].any() and counts[:, 3].any():
        curve = tuple(fit_curve(counts[:, :2] / [STEPS, SIZE_STEPS], counts[:, 2], counts[:, 3]).tolist())
    return measured, Classifier(good, bad, curve, prior)


def score(measured: DataFrame, model: Classifier, key: str) -> DataFrame:
    by_difference, by_size, offset = model.curve or (0.0, 0.0, 0.0)
    p = 1 / (1 + F.exp(-(difference() * by_difference + good_share() * by_size + offset)))
    known = F.when((F.col("n") > 0) & F.lit(model.curve is not None), p).otherwise(F.lit(float(model.prior)))
    return measured.select(F.col("k").alias(key), F.col("n").alias("n_bytes"), F.col("g").alias("good_bytes"), F.col("b").alias("bad_bytes"), known.alias("score"))
