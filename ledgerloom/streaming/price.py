"""The price that payments of round amounts of dollars leave in the outputs of blocks.

Outputs that look like payments fall into bins of the logarithm of their amount; a decaying average of the last blocks'
histograms has peaks where one dollar, five, ten and so on lie, a fixed number of bins apart. Each block's bin of 100 dollars is
looked for near the one before.

That is a fold over blocks, but a short one in most of its length. Where the search doesn't learn a shape, its step depends on the
rounded bin before alone, so a chunk of blocks is a function of the bin that it starts from. Chunks work out their functions side
by side (paths from different starts soon meet, so few are followed), one pass over a row a chunk chains them, and each chunk is
then run from its true start. Where it learns a shape, in the early span of ``learns_until`` blocks, one task folds over the
sorted blocks as a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scalars import log_bin

#: Bins of a decade and in all; the bins of 1, 2, 3, 5, 10, 15, 20, 25, 30, 50, 100, 150, 200, 300, 500, 1000, 2000,
#: 5000 and 10000 dollars from that of 100; how fast the shape is learned.
PER_DECADE, BINS = 200, 2400
ARMS = (-400, -340, -305, -260, -200, -165, -140, -120, -105, -60, 0, 35, 60, 95, 140, 200, 260, 340, 400)
SHAPE_RATE = 0.004
#: Heights from which the search runs and from which it is fast; outputs of a transaction at most before and from a height;
#: the least amount of a payment; leading digits of amounts that are round in coins.
FIRST, FAST_FROM = 340_000, 508_000
FEW, MANY, MANY_FROM = 100, 250, 630_000
LEAST_SATS, ROUND_DIGITS = 1000, (1, 2, 3, 5, 6, 10)
#: Blocks of a chunk, and tasks of chunks at most.
CHUNK, MOST_TASKS = 2016, 2000
_PAD = 420


@dataclass(frozen=True)
class Regime:
    """The average's rate and blocks, how many bins are searched below and from the bin before on, and the weight of the shape."""

    rate: float
    blocks: int
    below: int = 12
    above: int = 11
    shape: float = 0.0


SLOW, FAST = Regime(0.10, 40, shape=8.0), Regime(2 / 7, 12)


@dataclass
class State:
    """Where a run stopped: the next height, the bin of the last block, and the learned shape."""

    height: int
    bin: float
    profile: list[float] = field(default_factory=lambda: [1 / len(ARMS)] * len(ARMS))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> State:
        return State(**json.loads(text))


def common_round(sats: Column) -> Column:
    """Whether an amount is within a thousandth of a leading digit that people like, times a power of ten."""
    size = F.rpad(F.lit("1"), F.length(sats.cast("string")), "0").cast("long")
    near = F.floor((sats + F.floor(size / 2)) / size)
    return (sats > 0) & near.isin(*ROUND_DIGITS) & (F.abs(sats - near * size) * 1000 <= near * size)


def payments(outputs: DataFrame, *more: str, few: int = FEW, many: int = MANY) -> DataFrame:
    """(height, tx_idx, bin, ...): outputs (height, tx_idx, sats, output_type) that may be payments.

    Transactions with a data output or more outputs than their height allows go, and so do taproot outputs, dust and amounts that
    are round in coins.
    """
    per = outputs.groupBy("tx_idx").agg(F.count("*").alias("_n"), F.max((F.col("output_type") == "op_return").cast("int")).alias("_data"), F.max("height").alias("_h"))
    fine = per.filter((F.col("_data") == 0) & (F.col("_n") <= F.when(F.col("_h") >= MANY_FROM, many).otherwise(few))).select("tx_idx")
    own = outputs.filter((F.col("output_type") != "p2tr") & (F.col("sats") >= LEAST_SATS) & ~common_round(F.col("sats")))
    return own.join(fine, "tx_idx", "left_semi").select("height", "tx_idx", log_bin(F.col("sats")).alias("bin"), *more).filter("bin is not null")


def histograms(paid: DataFrame) -> DataFrame:
    """(height, bins, counts): a row a block that has payments, of at most BINS entries."""
    n = paid.groupBy("height", "bin").agg(F.count("*").alias("_n"))
    rows = n.groupBy("height").agg(F.sort_array(F.collect_list(F.struct("bin", "_n"))).alias("_r"))
    return rows.select("height", F.col("_r.bin").alias("bins"), F.col("_r._n").alias("counts"))


def cents_to_bin(cents: float) -> float:
    return (10 - np.log10(cents / 100)) * PER_DECADE


def bin_to_cents(b: Column) -> Column:
    return F.floor(F.pow(F.lit(10.0), 10 - b / PER_DECADE) * 100 + 0.5).cast("long")


class Window:
    """The histograms of the last blocks, and their decaying average with room around it."""

    def __init__(self, regime: Regime):
        self.regime, self.rows = regime, []

    def push(self, histogram: tuple[np.ndarray, np.ndarray]) -> None:
        self.rows = [histogram, *self.rows[: self.regime.blocks - 1]]

    def average(self) -> np.ndarray:
        out = np.zeros(BINS + 2 * _PAD)
        for age, (bins, counts) in enumerate(self.rows):
            out[bins + _PAD] += self.regime.rate * (1 - self.regime.rate) ** age * counts
        return out


def _shape(average: np.ndarray, centre: int) -> np.ndarray | None:
    arms = np.array([average[_PAD + centre + a] for a in ARMS])
    return arms / arms.sum() if arms.sum() > 0 else None


def picks(average: np.ndarray, before: np.ndarray, regime: Regime, profile: np.ndarray | None = None) -> np.ndarray:
    """The bin for each rounded bin before: of the bins searched, the first with the best score, and a fraction by a parabola
    through its neighbours. A score is the sum over the arms of the average there over its peak among the bins searched, and how
    well the arms fit the shape."""
    searched = before[:, None] + np.arange(-regime.below, regime.above + 1)
    inside = (searched >= 0) & (searched < BINS)
    at = np.clip(searched, 0, BINS - 1)
    mass = np.where(inside, average[at + (np.array(ARMS) + _PAD)[:, None, None]], 0.0)
    peak = mass.max(2, keepdims=True)
    score = np.divide(mass, peak, out=np.zeros_like(mass), where=peak > 0).sum(0)  # one arm after the other
    if regime.shape:
        arms = np.stack([average[_PAD + at + a] for a in ARMS], -1)
        total = arms.sum(-1, keepdims=True)
        fits = 1 - np.abs(np.divide(arms, total, out=np.zeros_like(arms), where=total > 0) - profile).sum(-1)
        score += regime.shape * np.where(total[..., 0] > 0, fits, 0.0)
    score = np.where(inside, score, -np.inf)
    best = score.argmax(1)
    every, last = np.arange(len(before)), searched.shape[1] - 1
    middle = score[every, best]
    left, right = score[every, np.maximum(best - 1, 0)], score[every, np.minimum(best + 1, last)]
    left, right = np.where((best == 0) | np.isinf(left), middle, left), np.where((best == last) | np.isinf(right), middle, right)
    bend = left - 2 * middle + right
    part = np.clip(np.divide(0.5 * (left - right), bend, out=np.zeros_like(bend), where=np.abs(bend) > 1e-10), -0.5, 0.5)
    return searched[every, best] + part


def rounded(b: np.ndarray | float) -> np.ndarray:
    return np.floor(np.asarray(b) + 0.5).astype(np.int64)


def _blocks(rows: pd.DataFrame, first: int, end: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(height, histogram as its bins and counts) of first to end - 1; blocks without payments are empty."""
    have = dict(zip(rows["height"].tolist(), zip(rows["bins"], rows["counts"], strict=True), strict=True))
    for h in range(first, end):
        bins, counts = have.get(h, ((), ()))
        yield h, (np.asarray(bins, np.int64), np.asarray(counts, np.float64))


def _learning(rows: DataFrame, state: State, origin: int, end: int, regime: Regime) -> tuple[DataFrame, State]:
    """((height, bin) from the state's height to before ``end``; the state after), by one task over the sorted blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, profile, b, nxt = Window(regime), np.array(state.profile), state.bin, max(origin, state.height - regime.blocks + 1)
        for batch in batches:
            frame = batch.to_pandas()
            out: list[tuple] = []
            for height, histogram in _blocks(frame, nxt, int(frame["height"].max()) + 1) if len(frame) else ():
                window.push(histogram)
                nxt = height + 1
                if height < state.height:
                    continue
                average = window.average()
                b = float(picks(average, rounded([b]), regime, profile)[0])
                shape = _shape(average, int(rounded(b)))
                profile = profile if shape is None else (1 - SHAPE_RATE) * profile + SHAPE_RATE * shape
                out.append((height, b, profile if nxt == end else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.list_(pa.float64()))], names=["height", "bin", "profile"])

    low = max(origin, state.height - regime.blocks + 1)
    # Every height has a row, so that the fold also goes over blocks without payments.
    every = rows.sparkSession.range(low, end).select(F.col("id").alias("height")).join(rows, "height", "left")
    filled = every.select("height", F.coalesce("bins", F.array().cast("array<int>")).alias("bins"), F.coalesce("counts", F.array().cast("array<bigint>")).alias("counts"))
    out = cut(filled.repartition(1).sortWithinPartitions("height").mapInArrow(run, "height long, bin double, profile array<double>"))
    last = out.filter("profile is not null").first()
    return out.select("height", "bin"), State(end, last.bin, list(last.profile))


def _free(rows: DataFrame, state: State, origin: int, end: int, regime: Regime, chunk: int) -> tuple[DataFrame, State]:
    """As ``_learning``, of a regime without a shape: all chunks side by side."""
    halo, first = regime.blocks - 1, state.height
    of = lambda h: F.floor((h - first) / chunk)
    near = rows.filter((F.col("height") >= max(origin, first - halo)) & (F.col("height") < end))
    chunks = F.sequence(F.greatest(of(F.col("height")), F.lit(0)), F.greatest(F.least(of(F.col("height") + halo), F.lit((end - 1 - first) // chunk)), F.lit(0)))
    dealt = near.withColumn("chunk", F.explode(chunks))
    empty = rows.sparkSession.range((end - 1 - first) // chunk + 1).select(F.col("id").alias("chunk"))  # chunks without payments run, too
    dealt = cut(empty.join(dealt, "chunk", "left"))

    # A chunk is much work and few bytes, by which tasks would be made too few.
    by_chunk = lambda: dealt.repartition(min((end - 1 - first) // chunk + 1, MOST_TASKS), "chunk").groupBy("chunk")

    def blocks_of(own: pd.DataFrame) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], bool]]:
        c = int(own["chunk"].iloc[0])
        a, z = first + c * chunk, min(first + (c + 1) * chunk, end)
        for h, x in _blocks(own.dropna(subset=["height"]), max(origin, a - halo), z):
            yield h, x, h >= a

    def function(own: pd.DataFrame) -> pd.DataFrame:
        window, ends, where = Window(regime), np.arange(BINS + 1, dtype=np.float64), np.arange(BINS + 1)
        for _, x, counts in blocks_of(own):
            window.push(x)
            if counts:
                now, where_now = np.unique(rounded(ends), return_inverse=True)
                ends, where = picks(window.average(), now, regime), where_now[where]
        return pd.DataFrame({"chunk": own["chunk"].iloc[:1], "ends": [ends[where].tolist()]})

    table = cut(by_chunk().applyInPandas(function, "chunk long, ends array<double>")).orderBy("chunk")
    b, starts = state.bin, {}
    for r in table.toLocalIterator():  # a row of BINS numbers a chunk
        starts[r.chunk] = b
        b = r.ends[int(rounded(b))]

    def replay(own: pd.DataFrame) -> pd.DataFrame:
        window, at, out = Window(regime), starts[int(own["chunk"].iloc[0])], []
        for h, x, counts in blocks_of(own):
            window.push(x)
            if counts:
                at = float(picks(window.average(), rounded([at]), regime)[0])
                out.append((h, at))
        return pd.DataFrame(out, columns=["height", "bin"])

    return by_chunk().applyInPandas(replay, "height long, bin double"), State(end, b, state.profile)


def estimate(rows: DataFrame, end: int, state: State, origin: int | None = None, fast_from: int = FAST_FROM, slow: Regime = SLOW, fast: Regime = FAST, chunk: int = CHUNK) -> tuple[DataFrame, State]:
    """((height, bin, cents) from the state's height to before ``end``; the state to go on from).

    ``rows``: ``histograms``, also of the blocks before that the averages reach back to. ``origin``: the height at which the very
    first run began (this one, if it's the first); averages hold no block before. Null heights don't count.
    """
    origin = state.height if origin is None else origin
    parts = []
    turn = min(max(fast_from, state.height), end)
    if state.height < turn:
        part, state = _learning(rows, state, origin, turn, slow)
        parts.append(part)
    if state.height < end:
        part, state = _free(rows, state, origin, end, fast, chunk)
        parts.append(part)
    none = rows.sparkSession.createDataFrame([], "height long, bin double")
    out = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else none
    return out.select("height", "bin", bin_to_cents(F.col("bin")).alias("cents")), state
