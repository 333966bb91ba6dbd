"""Periodic runs of words, by divide and conquer over interned word ids (Main and Lorentz).

A run is a longest stretch of words with a smallest period q that holds it at least EXPONENT times and at least LEAST words. A
text is halved again and again. Every run lies whole in one of the halves' ancestors and crosses its midpoint; there, Z-functions
to both sides of the midpoint tell how far the words stay equal to those q further on. What the border of a stretch cuts short
is found whole in a longer one, so it's dropped here; of equal intervals the smallest period stays.

Most midpoints lie in no run. A run of period q has at least 2 q words on one side of its midpoint, so the q words next to the
midpoint are equal to the q words after (or before) them; whether the first, last and middle ones are is looked up for all
midpoints of a level and of a batch of texts at once, and Z-functions are computed where some q passes. A stretch that has one
period below LEAST from end to end holds no other run (a run shorter than the sum of both periods would be too short; of a longer
one the common divisor of both would be a period), so it isn't halved.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import texts

#: A run has at least EXPONENT periods and LEAST words.
EXPONENT, LEAST = 4, 6
#: Pairs of midpoint and period looked at together, and words of texts handled together (a longer text comes alone).
PAIRS, WORDS = 1 << 20, 1 << 18

Run = tuple[int, int, int]


def common(x: list[int], a: int, b: int, most: int) -> int:
    """For how many places, ``most`` at most, x[a:] and x[b:] agree; in time in proportion to that, by slices that double."""
    done, step = 0, 8
    while done < most:
        step = min(step, most - done)
        if x[a + done : a + done + step] == x[b + done : b + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            if x[a + done : a + done + step] == x[b + done : b + done + step]:
                done += step
    return done


def z_function(x: np.ndarray) -> list[int]:
    """For each place i > 0, how long x[i:] agrees with x; at 0, the whole length. Places whose first word differs stay zero."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    own, left, right = x.tolist(), 0, 0
    for i in (np.flatnonzero(x[1:] == x[0]) + 1).tolist() if n else ():
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            k += common(own, k, i + k, n - i - k)
            left, right = i, i + k
        z[i] = k
    return z


def crossing(x: np.ndarray, low: int, mid: int, high: int, ahead: list[int], behind: list[int]) -> dict[tuple[int, int], int]:
    """(start, end): smallest period, of the runs inside low..high that cross ``mid`` and that no neighbour there extends.

    ``ahead``: periods to try with two of them right of the midpoint; ``behind``: left of it.
    """
    u, v, stop = x[low:mid], x[mid:high], np.array([-1], x.dtype)
    onward, backward = z_function(v), z_function(u[::-1])
    found: dict[tuple[int, int], int] = {}

    def note(start: int, end: int, q: int) -> None:
        if end - start >= max(LEAST, EXPONENT * q):
            found[start, end] = min(q, found.get((start, end), q))

    if ahead:
        before = z_function(np.concatenate([u[::-1], stop, v[::-1]]))  # how far words before mid + q agree with those before mid
        for q in ahead:
            back = before[high - q - low + 1]
            back = q + (backward[q] if q < len(u) else 0) if back >= q else back
            note(mid - back, mid + q + onward[q], q)
    if behind:
        after = z_function(np.concatenate([v, stop, u]))  # how far words from mid - q on agree with those from mid on
        for q in behind:
            on = after[high - low + 1 - q]
            on = q + (onward[q] if q < len(v) else 0) if on >= q else on
            note(mid - q - backward[q], mid + on, q)
    return found


def _hopeful(x: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(stretch, period, ahead?) where the first, last and middle of the q words next to the midpoint agree with those q further."""
    for ahead, room in ((True, (high - mid) // 2), (False, (mid - low) // 2)):
        upto = np.cumsum(room)
        total = int(upto[-1]) if len(upto) else 0
        for a in range(0, total, PAIRS):
            b = min(a + PAIRS, total)
            s0, s1 = np.searchsorted(upto, [a, b - 1], "right")
            first = upto[s0 : s1 + 1] - room[s0 : s1 + 1]
            counts = np.minimum(upto[s0 : s1 + 1], b) - np.maximum(first, a)
            s = np.repeat(np.arange(s0, s1 + 1), counts)
            q = np.arange(a, b) - np.repeat(first, counts) + 1
            m = mid[s]
            if ahead:
                keep = x[m + q] == x[m]
                s, q, m = s[keep], q[keep], m[keep]
                keep = (x[m + 2 * q - 1] == x[m + q - 1]) & (x[m + q + q // 2] == x[m + q // 2])
            else:
                keep = x[m - 1 - q] == x[m - 1]
                s, q, m = s[keep], q[keep], m[keep]
                keep = (x[m - 2 * q] == x[m - q]) & (x[m - 1 - q - q // 2] == x[m - 1 - q // 2])
            yield s[keep], q[keep], ahead


def find_runs(x: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """The runs (start, length, period) of each text bounds[k]:bounds[k+1] of the ids ``x`` (numbers from 0), by start and period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(bounds) - 1)]
    text, low, high = np.arange(len(bounds) - 1), bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    while True:
        long = high - low >= LEAST
        text, low, high = text[long], low[long], high[long]
        if not len(text):
            break
        mid = (low + high) // 2
        tries: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for s, q, ahead in _hopeful(x, low, mid, high):
            for k, p in zip(s.tolist(), q.tolist(), strict=True):
                tries[k][not ahead].append(p)
        whole = np.zeros(len(text), bool)
        for k, (ahead, behind) in tries.items():
            t = int(text[k])
            first, last = int(bounds[t]), int(bounds[t + 1])
            own = found[t]
            l, m, h = int(low[k]), int(mid[k]), int(high[k])
            through = next((q for q in sorted({*ahead[:2], *behind[:2]}) if q < LEAST and h - l >= EXPONENT * q and (x[l : h - q] == x[l + q : h]).all()), 0)
            whole[k] = through > 0
            for (a, b), q in ({(l, h): through} if through else crossing(x, l, m, h, ahead, behind)).items():
                if (a > first and x[a - 1] == x[a - 1 + q]) or (b < last and x[b] == x[b - q]):
                    continue  # cut short by the border of this stretch
                own[a, b] = min(q, own.get((a, b), q))
        text, low, mid, high = text[~whole], low[~whole], mid[~whole], high[~whole]
        text, low, high = np.concatenate([text, text]), np.concatenate([low, mid]), np.concatenate([mid, high])
    return [sorted((a - int(bounds[t]), b - a, q) for (a, b), q in own.items()) for t, own in enumerate(found)]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, q in runs:
            kept[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, ``n_words``, ``runs`` (array of start, length and period, in words, by start and period) and ``collapsed``.

    Words are runs of characters other than the space and U+0009 to U+000D, compared as they are. Null and empty texts have no
    words, no runs and an empty ``collapsed``. Repeated rows and null keys stay, other columns are ignored, no rows give no rows.
    A text is handled by one task in time of n log n; a run as long as the text is found like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunk in texts(batches):
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            words = [t.split() for t in chunk]
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            x = np.fromiter((number[w] for own in words for w in own), np.int32, int(bounds[-1]))
            runs: list[list[Run]] = []
            at = 0
            while at < len(words):  # in groups of bounded words
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WORDS, "right")) - 1)
                runs += find_runs(x, bounds[at : end + 1])
                at = end
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            at_ = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(at_), items)
            collapsed = pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), pa.int64()), lists, collapsed], names=["k", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.select(F.col("k").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def longest(runs: str = "runs"):
    """The run of greatest length of an array of runs (ties: the smallest start, then period); null if there is none."""
    by = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(by)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
