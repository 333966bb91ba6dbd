"""Quality rules by an isolation forest on rule statistics.

Each text gives a few counts that fixed rules judge directly (too few words, too much repetition), and ratios of such
counts that describe its shape. A forest of random trees is grown on a bounded sample of those ratios; a text that few random splits
set apart from the sample is an anomaly. How anomalous a text may be is calibrated on all labelled rows: at most
SPARED of the good ones may go, as few bad ones as possible stay, and the threshold lies midway between both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import rows_where, texts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_digits", "n_stops", "n_lines", "n_bytes")
#: Rows that the forest is grown on (those with the smallest hashes), trees, rows of a tree, and steps of the score.
FIT_ROWS, TREES, TREE_ROWS, STEPS = 4096, 100, 256, 2000
#: Share of good labelled rows that the threshold may cost, and the score above which rows go where there are no labels.
SPARED, WITHOUT_LABELS = 0.002, 0.65
#: Splits on a path at most, and the margin around a node's values.
DEPTH, MARGIN = 14, 0.5
SEED = 42

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS, _UPPER = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(0xC0, 0x100))  # a letter beyond ASCII counts by its first byte
_DIGITS, _STOPS, _INNER = b"0123456789", b".!?,;:", bytes(range(0x80, 0xC0))


def repeated(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more; a word in several such windows counts once."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    seen: set[tuple] = set()
    twice: set[tuple] = set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (twice if w in seen else seen).add(w)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + size - max(i, reach)
            reach = i + size
    return total


def statistics(text: bytes) -> tuple[int, ...]:
    """BASE and MORE of a whole text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = len(text)

    def count(chars: bytes) -> int:
        return n - len(text.translate(None, chars))

    return (
        len(words), len(text.translate(None, _SPACE + _INNER)), count(_SYMBOLS), len(lines) - len(set(lines)), repeated(words),
        count(_UPPER), count(_LETTERS), count(_DIGITS), count(_STOPS), len(lines), n,
    )


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, BASE and MORE (long); a null text counts as an empty one."""

    def run(batches):
        for part, chunk in texts(batches):
            stats = np.array([statistics(t) for t in chunk], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in stats.T)], names=["k", *BASE, *MORE])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in (*BASE, *MORE)))


def shape(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The ratios (rows x features) that the forest sees."""
    x = {k: v.astype(np.float64) for k, v in stats.items()}
    words, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    return np.stack([
        np.log1p(x["n_words"]) * 0.1, x["word_chars"] / words, np.sqrt(x["n_symbols"] / words), np.sqrt(x["n_dup_lines"] / np.maximum(x["n_lines"], 1)),
        x["n_repeat_words"] / words, x["n_upper"] / chars, x["n_letters"] / chars, np.sqrt(x["n_digits"] / chars), np.sqrt(x["n_stops"] / words),
    ], 1)


@dataclass
class Forest:
    """Trees laid out in arrays (tree x node): the feature, the split, the left child (the right one follows) and, at leaves
    (feature -1), the path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    expected: float


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n rows, as for binary search trees."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, around: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS) -> Forest:
    """A forest of random splits of ``rows``: a random feature, a random value between its extremes and a margin beyond.

    The margin, a share of the feature's spread over ``around``, lets a split part the rows from values that none of them
    has, as where a count is zero in every good text; beyond such a split there is no row, and the path ends.
    """
    rng = np.random.default_rng(SEED)
    margin = MARGIN * (around.max(0) - around.min(0)) if len(around) else np.zeros(rows.shape[1])
    size = min(tree_rows, len(rows))
    limit = DEPTH
    nodes = 2 * DEPTH * max(size, 1) + 1
    f, s, left, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes))
    for t in range(trees):
        stack, used = [(0, rows[rng.choice(len(rows), size, replace=False)] if len(rows) else rows, 0)], 1
        while stack:
            at, own, depth = stack.pop()
            low, high = (own.min(0) - margin, own.max(0) + margin) if len(own) > 1 else (margin, margin)
            varies = np.flatnonzero(high > low)
            if depth == limit or not len(varies):
                path[t, at] = depth + average_path(len(own))
                continue
            k = int(rng.choice(varies))
            cut_at = rng.uniform(low[k], high[k])
            f[t, at], s[t, at], left[t, at] = k, cut_at, used
            below = own[:, k] < cut_at
            stack += [(used, own[below], depth + 1), (used + 1, own[~below], depth + 1)]
            used += 2
    return Forest(f, s, left, path, average_path(size))


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """2 ** (-mean path length / its expectation), 0 to 1: near 1 where few random splits isolate a row."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for t in range(len(forest.feature)):
        at = np.zeros(len(rows), np.int64)
        for _ in range(DEPTH):
            f = forest.feature[t, at]
            if (f < 0).all():
                break
            right = rows[every, np.maximum(f, 0)] >= forest.split[t, at]
            at = np.where(f < 0, at, forest.left[t, at] + right)
        total += forest.path[t, at]
    return 2.0 ** (-(total / len(forest.feature)) / max(forest.expected, 1e-9))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Each row's key, the counts, ``anomaly`` (double), ``base_failed`` and ``kept``.

    ``labels``: key and quality (0 bad, others good, null unlabelled); a key labelled more than once is good if any of its
    labels is. The forest is grown on FIT_ROWS good labelled rows that pass the base rules (on any rows that pass, if none is
    labelled good), the threshold is calibrated on all. Null and empty texts have no words, so they fail the base rules.
    Repeated rows and null keys stay (null keys have no label), other columns are ignored, no rows give no rows.
    """
    scored, _, limit = calibrate(df, labels, key, text, quality)
    kept = ~F.col("base_failed") & (F.col("anomaly") <= limit)
    return scored.select(F.col("k").alias(key), *BASE, "anomaly", "base_failed", kept.alias("kept"))


def keep(df: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, as they are. The forest and threshold are the same; rows are judged where they are
    read, so texts aren't shuffled."""
    _, forest, limit = calibrate(df, labels, key, text, quality)

    def fine(chunk: list[bytes]) -> tuple[list[bool], dict]:
        stats = np.array([statistics(t) for t in chunk], np.int64).reshape(len(chunk), -1)
        own = dict(zip((*BASE, *MORE), stats.T, strict=True))
        passed = (own["n_words"] >= 50) & (100 * own["n_repeat_words"] <= 50 * own["n_words"])
        return (passed & (anomaly(forest, shape(own)) <= limit)).tolist(), {}

    return rows_where(df, fine, text)


def calibrate(df: DataFrame, labels: DataFrame | None, key: str, text: str, quality: str) -> tuple[DataFrame, Forest, float]:
    """(every row's key ``k``, counts, label and anomaly; the forest; the threshold)."""
    rows = measure(df, key, text)
    if labels is None:
        rows = rows.withColumn("good", F.lit(None).cast("boolean"))
    else:
        marks = labels.select(F.col(f"`{key}`").alias("k"), (F.col(f"`{quality}`") != 0).alias("good")).filter("k is not null").groupBy("k").agg(F.max("good").alias("good"))
        rows = rows.join(marks, "k", "left")
    rows = cut(rows.withColumn("base_failed", base_failed()))
    fit_on = rows.filter(~F.col("base_failed") & F.coalesce("good", F.lit(True)))
    by_hash = (F.coalesce("good", F.lit(False)).desc(), F.xxhash64("k", *BASE))
    sample = fit_on.orderBy(*by_hash).limit(FIT_ROWS).select(F.coalesce("good", F.lit(False)).alias("good"), *BASE, *MORE).toPandas()
    sample = sample[sample["good"]] if sample["good"].any() else sample
    forest = grow(shape({c: sample[c].to_numpy() for c in (*BASE, *MORE)}), extremes(rows.filter(~F.col("base_failed"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*BASE, *MORE)}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anomaly(forest, shape(own)))], names=[*b.schema.names, "anomaly"])

    scored = rows.mapInArrow(run, rows._jdf.schema().toDDL() + ", anomaly double")
    return scored, forest, threshold(scored)


def extremes(rows: DataFrame) -> np.ndarray:
    """The least and the greatest value of each ratio over all ``rows`` of counts, as two rows; none, if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                own = shape({c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*BASE, *MORE)})
                low = own.min(0) if low is None else np.minimum(low, own.min(0))
                high = own.max(0) if high is None else np.maximum(high, own.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], names=["ratio", "low", "high"])

    of_tasks = rows.select(*BASE, *MORE).mapInArrow(run, "ratio int, low double, high double")
    found = of_tasks.groupBy("ratio").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("ratio").collect()  # a row a ratio
    return np.array([[r.low for r in found], [r.high for r in found]]) if found else np.zeros((0, 0))


def threshold(scored: DataFrame) -> float:
    """One of STEPS levels, from the labelled rows that pass the base rules: of the levels that keep all but SPARED of the good
    ones, those at which the fewest bad ones stay, and of these the middle one. Without bad ones above them, the lowest."""
    level = F.ceil(F.col("anomaly") * STEPS)
    counts = scored.filter(~F.col("base_failed") & F.col("good").isNotNull()).groupBy("good", level.alias("level")).agg(F.count("*").alias("n")).orderBy("level").collect()
    good, bad = ([r for r in counts if r.good == kind] for kind in (True, False))  # at most STEPS rows each
    total, seen = sum(r.n for r in good), 0
    for r in good:
        seen += r.n
        if seen >= (1 - SPARED) * total:
            above = [b.level for b in bad if b.level > r.level]
            return (r.level + min(above) - 1) // 2 / STEPS if above else r.level / STEPS
    return WITHOUT_LABELS
