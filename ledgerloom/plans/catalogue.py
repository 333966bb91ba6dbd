"""The catalogue of named series, and range queries over them."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import GRAINS, HEIGHTS, ORIGIN
from ..operators.resample import last_by_height, last_of

#: How many of a grain's last periods may still change.
MARGINS = {"minute10": 8, "minute30": 3, "hour1": 2, "hour4": 2, "hour12": 2, "day1": 2, "day3": 2, "week1": 2, "month1": 1, "month3": 1, "month6": 1, "year1": 1, "year10": 1, "height": 6}
#: Cells that one query may ask for.
MOST_CELLS = 50_000_000


def normal(name: str) -> str:
    return name.replace("-", "_").lower()


@dataclass
class Catalogue:
    """Series by name: each a function that gives (idx, ts, value) by height. Names are unique."""

    series: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)

    def add(self, name: str, rows: Callable[[], DataFrame], version: int = 1) -> None:
        if (key := normal(name)) in self.series:
            raise ValueError(f"there is a series {key} already")
        self.series[key], self.versions[key] = rows, version

    def counts(self) -> dict[str, int]:
        return {"series": len(self.series), "indexes": len(GRAINS) + len(HEIGHTS) + 1, "total": len(self.series) * (len(GRAINS) + len(HEIGHTS) + 1)}

    def page(self, number: int, size: int = 100) -> dict:
        """Names by length, then alphabet."""
        names = sorted(self.series, key=lambda n: (len(n), n))
        return {"page": number, "names": names[number * size : (number + 1) * size], "has_more": (number + 1) * size < len(names)}

    def search(self, words: str, limit: int = 10) -> list[str]:
        """Names by how well they fit: as a whole, then by words they hold or that begin with one, then by shared trigrams."""
        want = normal(words)
        parts = [p for p in re.split(r"[^a-z0-9]+", want) if p]
        grams = {want[i : i + 3] for i in range(len(want) - 2)}

        def score(name: str) -> tuple:
            own = name.split("_")
            exact = sum(p in own for p in parts)
            prefix = sum(any(o.startswith(p) for o in own) for p in parts)
            shared = len(grams & {name[i : i + 3] for i in range(len(name) - 2)})
            return name == want, exact, prefix, "".join(parts) in name.replace("_", ""), shared / max(1, len(grams))

        ranked = sorted(((score(n), n) for n in self.series), key=lambda x: (*(-float(v) for v in x[0]), len(x[1]), x[1]))
        return [n for s, n in ranked if any(s[:4]) or s[4] >= 0.4][:limit]

    def find(self, name: str, index: str) -> DataFrame:
        """(idx, value) of a series at a grain."""
        key = normal(name)
        if key not in self.series:
            near = self.search(name, 3)
            raise KeyError(f"no series {key}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        rows = self.series[key]()
        if index == "height":
            return rows.select("idx", "value")
        if index in HEIGHTS:
            return last_by_height(rows, index, ["value"]).withColumnRenamed("bucket", "idx")
        if index in GRAINS:
            return last_of(rows, index, ["value"], from_=0).withColumnRenamed("bucket", "idx")
        raise KeyError(f"no index {index}; there are height, {', '.join((*HEIGHTS, *GRAINS))}")

    def select(self, names: list[str], index: str, start=None, end=None, limit: int | None = None) -> DataFrame:
        """(idx, a column a series) of positions ``start`` up to, without, ``end``: integers (negative from the end), dates (daily
        series) or datetimes. ``end`` beats ``limit``. The shortest series bounds all; the whole must not exceed MOST_CELLS."""
        frames = {normal(n): self.find(n, index) for n in names}
        out = None
        for n, f in frames.items():
            f = f.withColumnRenamed("value", n)
            out = f if out is None else out.join(f, "idx")
        length = 0
        if any(isinstance(x, int) and x < 0 for x in (start, end)) or start is None or (end is None and limit is None):
            length = (out.agg(F.max("idx")).first()[0] or -1) + 1
        a = 0 if start is None else self._place(start, length, index)
        b = self._place(end, length, index) if end is not None else a + limit if limit is not None else length
        b = max(a, b)
        if (b - a) * len(frames) > MOST_CELLS:
            raise ValueError(f"{(b - a) * len(frames)} cells asked for; {MOST_CELLS} are the most")
        return out.filter((F.col("idx") >= a) & (F.col("idx") < b))

    @staticmethod
    def _place(x, length: int, index: str) -> int:
        if isinstance(x, int):
            return min(max(0, length + x), length) if x < 0 else x
        if isinstance(x, dt.datetime):
            seconds = int(x.replace(tzinfo=x.tzinfo or dt.UTC).timestamp())
        elif isinstance(x, dt.date):
            seconds = int(dt.datetime(x.year, x.month, x.day, tzinfo=dt.UTC).timestamp())
        else:
            raise TypeError("an integer, a date or a datetime")
        if index != "day1":
            raise ValueError("dates and times place days only; give a position")
        return (seconds - ORIGIN) // 86_400

    def latest(self, name: str, index: str) -> DataFrame:
        return self.find(name, index).agg(F.max_by("value", "idx").alias("value"), F.max("idx").alias("idx"))

    def stable_length(self, length: int, index: str) -> int:
        """How many of the first positions can't change any more."""
        return max(0, length - MARGINS.get(index, 1))


def as_json(df: DataFrame, names: list[str], index: str, version: int = 1, stamp: Column | None = None) -> DataFrame:
    """One row a series (name, json): {version, index, type, start, end, stamp, data} with the data in order. ``stamp``: when it
    was made, now unless given, in ISO 8601. A range of more than MOST_CELLS cells fails, as it becomes one row."""
    if stamp is None:
        stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    _bounded(df, names)
    span = [F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")]
    lists = [F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(n).alias("v")))), lambda x: x["v"]).alias(n) for n in names]
    whole = df.agg(*span, *lists)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.to_json(F.struct(F.lit(version).alias("version"), F.lit(index).alias("index"), F.lit(df.schema[n].dataType.simpleString()).alias("type"), "start", "end", stamp.alias("stamp"), F.col(n).alias("data")), {"ignoreNullFields": "false"}).alias("json")) for n in names)))
    return whole.select(each.alias("x")).select("x.*")


def _bounded(df: DataFrame, names: list[str]) -> int:
    """How many rows are asked for; more than MOST_CELLS cells fail, as they become one row."""
    rows = df.count()
    if rows * len(names) > MOST_CELLS:
        raise ValueError(f"{rows * len(names)} cells asked for; {MOST_CELLS} are the most")
    return rows


def _lists(df: DataFrame, names: list[str]) -> list[Column]:
    """Each series' values in order, as JSON."""
    return [F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(f"`{n}`").alias("v")))), lambda x: x["v"])) for n in names]


def as_raw_json(df: DataFrame, names: list[str]) -> DataFrame:
    """One row (json): the bare values of one series in order, or a list of such lists for several. No rows give empty lists."""
    _bounded(df, names)
    lists = _lists(df, names)
    return df.agg((lists[0] if len(names) == 1 else F.concat(F.lit("["), F.concat_ws(",", *lists), F.lit("]"))).alias("json"))


def as_legacy_json(df: DataFrame, names: list[str]) -> DataFrame:
    """One row (json) in the older form: the value alone for one row of one series, else as ``as_raw_json``; no series give []."""
    if not names:
        return df.limit(0).agg(F.lit("[]").alias("json"))
    raw = as_raw_json(df, names)
    return raw.select(F.expr("substring(json, 2, length(json) - 2)").alias("json")) if len(names) == 1 and _bounded(df, names) == 1 else raw


def write_csv(df: DataFrame, path: str) -> None:
    """One column a series under a header, ordered by position."""
    df.orderBy("idx").drop("idx").write.mode("overwrite").csv(path, header=True)


def downsample(df: DataFrame, most: int, length: int) -> DataFrame:
    """Every nth row, so that about ``most`` of ``length`` remain, and the last."""
    step = max(length // max(1, most), 1)
    return df.filter((F.col("idx") % step == 0) | (F.col("idx") == length - 1))
