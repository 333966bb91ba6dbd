"""Order-dependent operators over series that are too long for one task.

A window over a whole series would bring it into one task. Here a series is cut into chunks of its index (or of time), and
either every chunk also gets the rows before it that its frames reach back to (a halo), or per-chunk totals are carried
forward and added. Both are exact and shuffle each row once, or once and a halo.

Frames: ``by`` names the series' columns, ``idx`` its position (long, unique within the series, about dense).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a chunk.
CHUNK = 100_000

#: name: (aggregate of a column, how the carry joins with a value)
FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda carry, x: F.coalesce(carry + x, x, carry)),
    "count": (F.count, lambda carry, x: F.coalesce(carry, F.lit(0)) + x),
    "max": (F.max, lambda carry, x: F.greatest(carry, x)),
    "min": (F.min, lambda carry, x: F.least(carry, x)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carry, x: F.coalesce(x, carry)),
}


def running(df: DataFrame, folds: dict[str, tuple[str, Column]], by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``df`` with, for each name of ``folds``, the fold (a name of FOLDS and an expression) over all positions up to the row's.

    Each chunk is folded by a window of its own; the chunks' totals, a row each, are folded in turn and joined back.
    """
    by = by or []
    whole = df.withColumn("_chunk", F.floor(F.col(idx) / chunk)).withColumns({f"_x_{n}": x for n, (_, x) in folds.items()})
    inside = W.partitionBy(*by, "_chunk").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    parts = whole.withColumns({f"_in_{n}": FOLDS[f][0](F.col(f"_x_{n}")).over(inside) for n, (f, _) in folds.items()})
    totals = whole.groupBy(*by, "_chunk").agg(*((F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), F.col(idx))) if f == "last" else FOLDS[f][0](F.col(f"_x_{n}"))).alias(f"_t_{n}") for n, (f, _) in folds.items()))
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry_of = {"count": F.sum}
    carried = totals.select(*by, "_chunk", *(carry_of.get(f, FOLDS[f][0])(F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (f, _) in folds.items()))
    joined = parts.join(carried, [*by, "_chunk"])
    return joined.select(*df.columns, *(FOLDS[f][1](F.col(f"_c_{n}"), F.col(f"_in_{n}")).alias(n) for n, (f, _) in folds.items()))


def in_rows(df: DataFrame, back: int, columns: Callable[[object], dict[str, Column]], by: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``df`` with window columns whose frames reach at most ``back`` rows back.

    ``columns`` gets a window ordered by ``idx`` without a frame. The index has to be dense: then the ``back`` positions
    before a chunk are the ``back`` rows before it.
    """
    by = by or []
    chunk = max(chunk, back)
    own = F.floor(F.col(idx) / chunk)
    reach = F.floor((F.col(idx) + back) / chunk)
    dealt = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, reach)) if back else own)
    w = W.partitionBy(*by, "_chunk").orderBy(idx)
    return dealt.withColumns(columns(w)).filter("_own = _chunk").drop("_own", "_chunk")


def dealt_in_time(df: DataFrame, seconds: int, ts: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``_own``, each row's chunk of time, once for each ``_chunk`` whose rows reach back to it in less than ``seconds``."""
    width = max(seconds, chunk)
    own = F.floor(F.col(ts) / width)
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, F.floor((F.col(ts) + seconds) / width))))
