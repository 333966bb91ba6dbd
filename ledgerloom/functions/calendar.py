"""Coarser grains of time and of the chain: the number of the bucket that a second, or a height, falls into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2009-01-01 in seconds, the origin of all buckets of time.
ORIGIN = 1_230_768_000
DAY = 86_400
SECONDS = {"minute10": 600, "minute30": 1800, "hour1": 3600, "hour4": 14_400, "hour12": 43_200, "day1": DAY}
MONTHS = {"month1": 1, "month3": 3, "month6": 6}
HEIGHTS = {"halving": 210_000, "epoch": 2016}
GRAINS = (*SECONDS, "day3", "week1", *MONTHS, "year1", "year10")


def bucket(seconds: Column, grain: str) -> Column:
    """The bucket (long) of a time in seconds since 1970, or of a height for ``halving`` and ``epoch``."""
    since = seconds - ORIGIN
    date = F.date_add(F.lit("2009-01-01").cast("date"), F.floor(since / DAY).cast("int"))
    months = (F.year(date) - 2009) * 12 + F.month(date) - 1
    if grain in SECONDS:
        out = F.floor(since / SECONDS[grain])
    elif grain == "day3":
        out = F.floor((since + DAY) / (3 * DAY))
    elif grain == "week1":  # whole ISO weeks since that of 2009-01-01, which began on a Monday three days before
        out = F.floor((since + 3 * DAY) / (7 * DAY))
    elif grain in MONTHS:
        out = F.floor(months / MONTHS[grain])
    elif grain == "year1":
        out = F.year(date) - 2009
    elif grain == "year10":  # decades count from 2000
        out = F.floor((F.year(date) - 2000) / 10)
    elif grain in HEIGHTS:
        out = F.floor(seconds / HEIGHTS[grain])
    else:
        raise ValueError(f"no grain {grain}")
    return out.cast("long")
