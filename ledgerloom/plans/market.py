"""Market series from a price series (idx, ts in seconds, price): all compositions of the window and recursive operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import windows as Win
from ..operators.recursive import ema_time
from ..operators.resample import ohlc

DAY = 86_400
#: Days of the moving averages.
SMA_DAYS = (7, 8, 13, 21, 30, 34, 55, 89, 111, 144, 200, 350, 365, 730, 1400, 1460)
DCA_CENTS = 10_000


def moving_average(prices: DataFrame, days: int, out: str) -> DataFrame:
    return Win.rolling_time(prices, days * DAY, "price", ["average"]).withColumnRenamed("average", out)


def exponential_average(prices: DataFrame, days: int, value: str, out: str, wilder: bool = False) -> DataFrame:
    started = Win.window_start(prices, days * DAY, "_start")
    return ema_time(started, "_start", value, out, wilder=wilder).drop("_start")


def returns(prices: DataFrame, seconds: int, out: str = "ret") -> DataFrame:
    """Growth since the start of each row's window; 0 where the price there is 0."""
    return Win.rolling_change(prices, seconds, "price").select(*prices.columns, F.col("rate").alias(out))


def volatility(prices: DataFrame, days: int, step: int = DAY) -> DataFrame:
    """The deviation of ``step`` returns over ``days``, carried to that many days."""
    moved = returns(prices, step)
    return Win.rolling_time(moved, days * DAY, "ret", ["sd"]).withColumn("volatility", S.times_sqrt(F.col("sd"), days)).drop("sd", "ret")


def _rsi_windows(days: int, step: int) -> list:
    return [(step, "price", {"first": "_before"}), (days * DAY, "idx", {"first": "_since"})]


def _rsi(rolled: DataFrame) -> DataFrame:
    moved = rolled.withColumn("_ret", S.ratio(F.col("price") - F.col("_before"), F.col("_before"))).drop("_before")
    moved = moved.withColumns({"_gain": F.greatest("_ret", F.lit(0.0)), "_loss": F.greatest(-F.col("_ret"), F.lit(0.0))}).drop("_ret")
    for c in ("gain", "loss"):
        moved = ema_time(moved, "_since", f"_{c}", f"_avg_{c}", wilder=True).drop(f"_{c}")
    both = F.col("_avg_gain") + F.col("_avg_loss")
    return moved.withColumn("rsi", F.when(both == 0, F.lit(0.5)).otherwise(F.try_divide(F.col("_avg_gain"), both))).drop("_since", "_avg_gain", "_avg_loss")


def rsi(prices: DataFrame, days: int = 14, step: int = DAY) -> DataFrame:
    """Gain over gain and loss, smoothed over ``days``; one half where both are 0."""
    return _rsi(Win.rolling_times(prices, _rsi_windows(days, step)))


def stochastic(rows: DataFrame, value: str, days: int, smooth: int) -> DataFrame:
    """Where a value lies within its window's range (0 to 1), and its means ``k`` and ``d`` over ``smooth`` days."""
    r = Win.rolling_time(rows, days * DAY, value, ["min", "max"])
    r = r.withColumn("_s", S.ratio(F.col(value) - F.col("min"), F.col("max") - F.col("min"))).drop("min", "max")
    r = Win.rolling_time(r, smooth * DAY, "_s", ["average"]).withColumnRenamed("average", "k").drop("_s")
    return Win.rolling_time(r, smooth * DAY, "k", ["average"]).withColumnRenamed("average", "d")


def _macd_windows(fast: int, slow: int, signal: int) -> list:
    return [(d * DAY, "idx", {"first": n}) for d, n in ((fast, "_of_fast"), (slow, "_of_slow"), (signal, "_of_signal"))]


def _macd(rolled: DataFrame) -> DataFrame:
    p = ema_time(rolled, "_of_fast", "price", "_fast").drop("_of_fast")
    p = ema_time(p, "_of_slow", "price", "_slow").withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_of_slow", "_fast", "_slow")
    return ema_time(p, "_of_signal", "macd", "signal").withColumn("histogram", F.col("macd") - F.col("signal")).drop("_of_signal")


def macd(prices: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return _macd(Win.rolling_times(prices, _macd_windows(fast, slow, signal)))


_PI_WINDOWS = [(111 * DAY, "price", {"average": "_a"}), (350 * DAY, "price", {"average": "_b"})]


def _pi_cycle(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("pi_cycle", S.ratio(F.col("_a"), 2 * F.col("_b"))).drop("_a", "_b")


def pi_cycle(prices: DataFrame) -> DataFrame:
    return _pi_cycle(Win.rolling_times(prices, _PI_WINDOWS))


def _true_ranges(prices: DataFrame) -> DataFrame:
    return Win.lookback_rows(prices, 1, "price").withColumn("_tr", F.abs("change")).drop("previous", "change", "ratio_change", "percentage_change")


def _choppiness_windows(days: int) -> list:
    return [(days * DAY, "price", {"min": "_min", "max": "_max", "count": "_n"}), (days * DAY, "_tr", {"sum": "_sum"})]


def _choppiness(rolled: DataFrame) -> DataFrame:
    r = rolled.withColumn("_range", F.col("_max") - F.col("_min"))
    fine = (F.col("_range") > 0) & (F.col("_n") > 1) & (F.col("_sum") > 0)
    value = F.try_divide(F.log10(F.col("_sum") / F.when(fine, F.col("_range"))), F.log10(F.col("_n").cast("double")))
    return r.withColumn("choppiness", F.when(fine, value).otherwise(0.0)).drop("_tr", "_range", "_n", "_sum", "_min", "_max")


def choppiness(prices: DataFrame, days: int = 14) -> DataFrame:
    """log10(sum of true ranges / range) / log10(rows); 0 where the range is not above 0 or there is one row."""
    return _choppiness(Win.rolling_times(_true_ranges(prices), _choppiness_windows(days)))


def technical(prices: DataFrame) -> DataFrame:
    """``rsi`` and its stochastic ``k`` and ``d``, ``macd``, ``pi_cycle`` and ``choppiness``; windows of the price are one pass."""
    rolled = Win.rolling_times(_true_ranges(prices), [*_rsi_windows(14, DAY), *_macd_windows(12, 26, 9), *_PI_WINDOWS, *_choppiness_windows(14)])
    return stochastic(_rsi(_macd(_choppiness(_pi_cycle(rolled)))), "rsi", 14, 3)


def dca(prices: DataFrame, days: int) -> DataFrame:
    """A fixed sum spent each day at its closing price: ``stack`` of sats over the last ``days`` days, ``invested`` cents, their
    ``basis`` in cents a bitcoin, and ``dca_return`` at the day's close. One row a day."""
    daily = ohlc(prices, "day1", "price").select(F.col("bucket").alias("idx"), F.col("close").alias("price"))
    daily = daily.withColumn("sats", S.cents_to_sats(F.lit(DCA_CENTS), F.col("price")))
    first = daily.agg(F.min("idx").alias("_first"))
    bought = Win.rolling_rows(daily, days, "sats", ["sum"]).withColumnRenamed("sum", "stack").crossJoin(F.broadcast(first))  # one row
    bought = bought.withColumn("invested", DCA_CENTS * F.least(F.lit(days), F.col("idx") - F.col("_first") + 1)).drop("_first")
    basis = S.ratio(F.col("invested") * S.SATS, F.col("stack"))
    return bought.withColumn("basis", basis).withColumn("dca_return", S.ratio_difference(F.col("price"), F.col("basis")))


#: The codes of the phases.
PHASES = {
    "raging_bull": 1, "bull": 2, "cautious_bull": 3, "hopeful_bull": 4, "early_bull": 5, "weak_bull": 6, "limbo": 7,
    "deep_bear": 8, "bear": 9, "early_bear": 10,
}


def sentiment(price: Column, whole: Column, short: Column, long: Column, average: Column) -> Column:
    """The code of the phase that a price is in, against the capitalised prices of all, of short-term and of long-term holders and
    the yearly moving average (null while there is none). Null where a price but the average is null."""
    on_whole, on_short, on_long = price >= whole, price >= short, price >= long
    known, on_average = average.isNotNull(), F.coalesce(price >= average, F.lit(False))
    slow, rising = on_whole & on_long, short > long
    below = sum((F.coalesce((c > price).cast("int"), F.lit(0)) for c in (whole, short, long, average)), F.lit(0))
    phase = {name: F.lit(code) for name, code in PHASES.items()}
    bull = F.when(whole > average, phase["raging_bull"]).otherwise(phase["bull"])
    bear = F.when(long > whole, phase["deep_bear"]).otherwise(phase["bear"])
    without = (
        F.when(on_short & slow, bull).when(on_short & (rising | on_whole | on_long), phase["early_bull"]).when(on_short, phase["cautious_bull"])
        .when(rising & slow, phase["weak_bull"]).when(rising & (on_whole | on_long), phase["early_bear"]).otherwise(bear)
    )
    confirmed = (
        F.when(~(on_whole | on_short | on_long | on_average), bear).when(~on_short & (below == 2), phase["limbo"]).when(rising & ~(slow & on_average), phase["early_bear"])
        .when(on_average & on_short, F.when(slow, bull).otherwise(phase["early_bull"])).when(on_average & slow, phase["weak_bull"])
        .when(on_short, phase["cautious_bull"]).when(on_average, phase["hopeful_bull"]).otherwise(phase["early_bear"])
    )
    return F.when(price.isNull() | whole.isNull() | short.isNull() | long.isNull(), F.lit(None)).when(known, confirmed).otherwise(without)
