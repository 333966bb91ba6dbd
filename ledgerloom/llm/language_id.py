"""Language ID by a linear-chain conditional random field over words.

Every word of a text is a position of the chain, labels are languages. A word's features are its affixes, its character
n-grams and, for words that are frequent in the training texts, the word itself (the lexicon); their weights and those of
the transitions are learned by gradient ascent on the likelihood. Forward-backward gives each word's probabilities, so
text that switches language within a document is labelled word by word; a document's language is that of the largest
mean probability over its words with a letter.

Forward-backward runs over all texts of a batch as one chain, in which a text's first word forgets what came before. The
chain is cut into blocks whose transition products are formed side by side, so it is exact and costs no Python per word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import Memo, held, rows_where, texts

#: The classifier is fitted on at most so many documents of each language (those with the smallest hashes, whole).
DOCS_PER_LABEL = 80
#: Bits of hashed feature slots, words of the lexicon, steps of gradient ascent, its rate, and the L2 penalty.
SLOT_BITS, LEXICON, STEPS, RATE, PENALTY = 15, 4000, 25, 0.2, 1e-4
SLOTS = (1 << SLOT_BITS) + LEXICON
UNKNOWN = "und"
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


@dataclass
class Crf:
    """labels; weights (slots x labels); transitions (from x to); start; the lexicon's words and their slots."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[bytes, int]


def core(word: bytes) -> bytes:
    """A word in lower case without what isn't a letter at its ends; empty if it has no letter."""
    w = word.decode("utf-8", "replace").lower()
    if w.isalpha():
        return w.encode()
    inner = EDGE.sub("", w)
    return inner.encode() if any(map(str.isalpha, inner)) else b""


def features(words: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all words one after the other, how many each word has; 0 for words without a letter).

    A word's affixes of up to four bytes, its n-grams of two to four bytes, with marks for its ends, and, if it is listed,
    its own slot. Slots of affixes and n-grams are hashes, worked out for all words at once.
    """
    cores = [core(w) for w in words]
    sizes = np.fromiter(map(len, cores), np.int64, len(cores))
    data = np.frombuffer(b"".join([b"\1" + c + b"\2\0\0\0" for c in cores]), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes + 5) - sizes - 5
    place = np.arange(len(data)) - np.repeat(starts, sizes + 5)  # within its word, the start mark at 0
    last = np.repeat(sizes + 1, sizes + 5)  # of the end mark
    owner = np.repeat(np.arange(len(cores)), sizes + 5)
    padded = np.concatenate([data, np.zeros(4, np.uint64)])
    gram, slots, owners = np.zeros(len(data), np.uint64), [], []
    for n in range(1, 5):
        gram = gram * np.uint64(257) + padded[n - 1 : n - 1 + len(data)] + np.uint64(1)
        whole = (place + n - 1 <= last) & (sizes[owner] > 0)
        for salt, take in ((1, whole & (n > 1)), (2, whole & (place == 1) & (place + n - 1 < last)), (3, whole & (place + n == last) & (place > 0))):
            at = np.flatnonzero(take)
            slots.append((((gram[at] * np.uint64(8) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
            owners.append(owner[at])
    listed = [(i, lexicon[c]) for i, c in enumerate(cores) if c in lexicon]
    owners.append(np.array([i for i, _ in listed], np.int64))
    slots.append(np.array([x for _, x in listed], np.int64))
    own, flat = np.concatenate(owners), np.concatenate(slots)
    by = np.argsort(own, kind="stable")
    return flat[by], np.bincount(own, minlength=len(words))


def emissions(words: list[bytes], crf_weights: np.ndarray, lexicon: dict[bytes, int]) -> np.ndarray:
    """(words x labels + 1): the sum of feature weights over the root of their number; the last column: has a letter."""
    flat, sizes = features(words, lexicon)
    out = np.zeros((len(words), crf_weights.shape[1] + 1), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        sums = np.add.reduceat(crf_weights[flat], np.cumsum(sizes[some]) - sizes[some], axis=0)
        out[some, :-1] = sums / np.sqrt(sizes[some])[:, None]
        out[some, -1] = 1
    return out


def forward_backward(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals (words x labels) of chains laid end to end; ``first`` marks each chain's first word.

    With ``pairs`` also the log-likelihood's normaliser and the expected transitions (labels x labels) and starts.
    """
    n, m = e.shape
    t, s = np.exp(transitions), np.exp(start)
    top = e.max(1)
    x = np.exp(e - top[:, None])
    block = max(1, int(np.sqrt(n)))
    nb = -(-n // block)
    pad = nb * block - n
    x = np.concatenate([x, np.ones((pad, m))]).reshape(nb, block, m)
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(nb, block)
    p = np.broadcast_to(np.eye(m), (nb, m, m)).copy()
    for k in range(block):
        # One step's matrix: transitions times emissions, or, at a chain's start, no memory of what came before.
        p = np.where(f[:, k, None, None], p.sum(2, keepdims=True) * s, p @ t) * x[:, k, None, :]
        p /= p.sum((1, 2), keepdims=True)
    ahead, behind = np.empty((nb, m)), np.empty((nb, m))
    v = np.full(m, 1 / m)
    for b in range(nb):
        ahead[b] = v
        v = v @ p[b]
        v = v / v.sum()
    v = np.ones(m)
    for b in range(nb - 1, -1, -1):
        behind[b] = v
        v = p[b] @ v
        v = v / v.sum()
    alpha, beta, scale = np.empty((nb, block, m)), np.empty((nb, block, m)), np.empty((nb, block))
    v = ahead
    for k in range(block):
        v = np.where(f[:, k, None], v.sum(1, keepdims=True) * s, v @ t) * x[:, k]
        scale[:, k] = v.sum(1)
        v = v / scale[:, k, None]
        alpha[:, k] = v
    v = behind
    for k in range(block - 1, -1, -1):
        beta[:, k] = v
        y = v * x[:, k]
        v = np.where(f[:, k, None], (y * s).sum(1, keepdims=True), y @ t.T)
        v = v / v.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    gamma = gamma.reshape(-1, m)[:n]
    if not pairs:
        return gamma
    a, y = alpha.reshape(-1, m)[: n - 1], (beta * x).reshape(-1, m)[1:n]
    within = ~first[1:]
    a, y = a[within], y[within]
    z = np.einsum("ni,ij,nj->n", a, t, y)
    expected = t * (a.T @ (y / z[:, None]))
    normaliser = float(np.log(scale.reshape(-1)[:n]).sum() + top.sum())
    return gamma, normaliser, expected, gamma[first].sum(0)


def fit(samples: list[tuple[bytes, str]]) -> Crf:
    """A CRF for (text, language) pairs: every word of a text has the text's language."""
    labels = sorted({y for _, y in samples})
    split = [(t.split(), labels.index(y)) for t, y in samples]
    split = [(ws, y) for ws, y in split if ws]
    counts = Counter(w for ws, _ in split for w in map(core, ws))
    frequent = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if w and n > 2][:LEXICON]
    lexicon = {w: (1 << SLOT_BITS) + i for i, w in enumerate(frequent)}
    m = len(labels)
    words = sorted({w for ws, _ in split for w in ws})
    if not words:
        return Crf(labels or [UNKNOWN], np.zeros((SLOTS, max(1, m)), np.float32), np.zeros((max(1, m),) * 2), np.zeros(max(1, m)), lexicon)
    at = {w: i for i, w in enumerate(words)}
    uid = np.array([at[w] for ws, _ in split for w in ws])
    gold = np.repeat([y for _, y in split], [len(ws) for ws, _ in split])
    first = np.zeros(len(uid), bool)
    first[np.cumsum([0, *(len(ws) for ws, _ in split)])[:-1]] = True
    flat, sizes = features(words, lexicon)
    owner = np.repeat(np.arange(len(words)), sizes)
    norm = 1 / np.sqrt(np.maximum(sizes, 1))
    seen = np.zeros((len(words), m))
    np.add.at(seen, (uid, gold), 1)
    same = ~first[1:]
    moves = np.zeros((m, m))
    np.add.at(moves, (gold[:-1][same], gold[1:][same]), 1)
    begins = np.bincount(gold[first], minlength=m)
    weights, transitions, start = np.zeros((SLOTS, m)), np.zeros((m, m)), np.zeros(m)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, transitions, start)]
    for step in range(1, STEPS + 1):
        e = np.stack([np.bincount(owner, weights[flat, k], len(words)) for k in range(m)], 1) * norm[:, None]
        gamma, _, expected, starts = forward_backward(e[uid], first, transitions, start, pairs=True)
        away = (seen - np.stack([np.bincount(uid, gamma[:, k], len(words)) for k in range(m)], 1)) * norm[:, None]
        g = np.stack([np.bincount(flat, away[owner, k], SLOTS) for k in range(m)], 1)
        grads = (g / len(uid) - PENALTY * weights, (moves - expected) / len(uid) - 0.01 * transitions, (begins - starts) / first.sum() - 0.01 * start)
        for p, d, (m1, m2) in zip((weights, transitions, start), grads, state, strict=True):
            m1 *= 0.9
            m1 += 0.1 * d
            m2 *= 0.99
            m2 += 0.01 * d * d
            p += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return Crf(labels, weights.astype(np.float32), transitions, start, lexicon)


def training_rows(df: DataFrame, train: Column, per_label: int, key: str, text: str, label: str) -> list[tuple[bytes, str]]:
    """At most ``per_label`` texts of each label, those with the smallest hashes of the key."""
    rows = df.filter(train & F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{text}`").cast("binary").alias("t"), F.col(f"`{label}`").cast("string").alias("y"), F.xxhash64(F.col(f"`{key}`")).alias("h"), F.octet_length(F.col(f"`{text}`")).alias("n"))
    picked = rows.withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("h", "n", "t"))).filter(F.col("r") <= per_label)
    return [(bytes(r.t), r.y) for r in picked.orderBy("y", "r").select("t", "y").collect()]


def label_batch(crf: Crf, memo: Memo, batch: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probabilities: words x labels, whether each word has a letter) for each text."""
    split = [t.split() for t in batch]
    memo.learn([w for ws in split for w in ws])
    m = len(crf.labels)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    e = np.frombuffer(b"".join([b"".join(map(memo.__getitem__, ws)) for ws in split]), np.float32).reshape(-1, m + 1)
    if not len(e):
        yield from ((np.zeros((0, m)), np.zeros(0, bool)) for _ in split)
        return
    first = np.zeros(len(e), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    gamma = forward_backward(e[:, :m].astype(np.float64), first, crf.transitions, crf.start)
    stops = np.cumsum(sizes)
    for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
        yield gamma[a:b], e[a:b, m] > 0


def memo_of(crf: Crf) -> Memo:
    """What a worker learned of words under the same weights, from task to task."""
    key = hashlib.sha256(crf.weights.tobytes()).digest()
    return held(key, lambda: Memo(lambda words: [r.tobytes() for r in emissions(words, crf.weights, crf.lexicon)]))


def identify(df: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, ``lang_pred`` and ``score`` (the language's mean probability over the words with a letter).

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the language first by name. Repeated rows and
    null keys stay, other columns are ignored, no rows give no rows.
    """

    def run(batches):
        for part, chunk in texts(batches, keep=True):
            langs, scores = verdicts(crf, chunk)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["k", "lang_pred", "score"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("k", key)


def verdicts(crf: Crf, chunk: list[bytes]) -> tuple[list[str], list[float]]:
    """The languages of texts and their scores."""
    langs, scores = [], []
    for gamma, has in label_batch(crf, memo_of(crf), chunk):
        mean = gamma[has].mean(0) if has.any() else np.zeros(1)
        langs.append(crf.labels[int(mean.argmax())] if has.any() else UNKNOWN)
        scores.append(min(1.0, float(mean.max())))
    return langs, scores


def keep(df: DataFrame, crf: Crf, least: float, text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of ``df`` whose language is known with a score of ``least`` or more, with ``label`` as predicted."""

    def fine(chunk: list[bytes]) -> tuple[list[bool], dict]:
        langs, scores = verdicts(crf, chunk)
        return [x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], {label: langs}

    return rows_where(df, fine, text, keep=True)


def label_words(df: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key and ``runs``: array of (lang, first word, words) of neighbouring words with one most likely language."""

    def run(batches):
        memo = memo_of(crf)
        for part, chunk in texts(batches, keep=True):
            out = []
            for gamma, _ in label_batch(crf, memo, chunk):
                best = gamma.argmax(1)
                edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else [0]
                out.append([{"lang": crf.labels[best[a]], "first": a, "words": b - a} for a, b in zip(edges, edges[1:], strict=False)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["k", "runs"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, runs array<struct<lang:string,first:int,words:int>>").withColumnRenamed("k", key)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 on division by 4; false for a null key, which isn't learned from either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, per_label: int = DOCS_PER_LABEL, key: str = "doc_id", text: str = "text", label: str = "lang") -> Crf:
    """A CRF from the rows that aren't held out."""
    train = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    return fit(training_rows(df, train, per_label, key, text, label))
