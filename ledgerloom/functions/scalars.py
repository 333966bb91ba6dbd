"""Scalar functions over columns. Undefined values follow the operator: IEEE results, zero, or null, as each says."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SATS, PPM = 100_000_000, 1_000_000
WEIGHT_FACTOR = 4
MAX_LONG = 2**63 - 1


def divide(a: Column, b: Column) -> Column:
    """a / b as IEEE floats do it: infinite or NaN where b is 0, null only for nulls."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null, or the quotient is null or NaN. Each operand stands in the expression once, so that
    ratios of ratios stay small."""
    return F.nanvl(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), F.lit(0.0))


def ratio_difference(a: Column, b: Column) -> Column:
    """a / b - 1, and 0 where b is 0, NaN or null."""
    b = b.cast("double")
    return F.when(b.isNull() | F.isnan(b) | (b == 0), F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b) - 1)


def percentage(a: Column, b: Column) -> Column:
    """100 a / b; whole numbers are multiplied first, so that only the quotient is rounded."""
    return divide(a.cast("double") * 100, b)


def percentage_difference(a: Column, b: Column) -> Column:
    return percentage(a, b) - 100


def floor_div(a: Column, b: int) -> Column:
    """The whole part, rounded down, of a decimal of 38 digits without fraction over a whole number. A plain quotient keeps six
    digits of the fraction, so that .9999995 and more would come out as the next whole number."""
    by = F.lit(b).cast("decimal(10,0)")
    return F.floor((a - F.pmod(a, by)) / by)


def saturating_add(a: Column, b: Column, most: int = MAX_LONG) -> Column:
    """a + b, and the largest value where it would be beyond."""
    return F.least(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.lit(most).cast("decimal(38,0)")).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    """a - b, and 0 where it would be below."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def checked_sub(a: Column, b: Column) -> Column:
    """a - b, and null where it would be below 0."""
    return F.when(a >= b, a - b)


def unsigned_sub(a: Column, b: Column) -> Column:
    """a - b; fails where it would be below 0."""
    return F.when(F.assert_true(a >= b, F.lit("a difference of unsigned values is below 0")).isNull(), a - b)


def halve(a: Column) -> Column:
    """Half of a non-negative integer, cut off."""
    return F.floor(a / 2).cast("long")


def sats_to_bitcoin(a: Column) -> Column:
    return a.cast("double") / SATS


def sats_to_cents(sats: Column, price_cents: Column) -> Column:
    """sats x price / 1e8, cut off, in 128-bit integers."""
    return F.floor(sats.cast("decimal(19,0)") * price_cents.cast("decimal(19,0)") / F.lit(SATS)).cast("long")


def cents_to_dollars(a: Column) -> Column:
    return a.cast("double") / 100


def cents_to_sats(cents: Column, price_cents: Column) -> Column:
    """cents x 1e8 / price, cut off; 0 where the price is 0."""
    q = F.try_divide(cents.cast("decimal(19,0)") * F.lit(SATS), price_cents.cast("decimal(19,0)"))
    return F.coalesce(F.floor(q).cast("long"), F.lit(0).cast("long"))


def cents_times_tenths(cents: Column, tenths: int) -> Column:
    return F.floor(cents.cast("decimal(19,0)") * tenths / 10).cast("long")


def mask(flag: Column, a: Column) -> Column:
    return F.when(flag, a).otherwise(F.lit(0).cast("long"))


def one_minus(a: Column) -> Column:
    return 1 - a


def odds(a: Column) -> Column:
    """x / (1 - x), IEEE."""
    return divide(a, 1 - a)


def fixed_to_ratio(ppm: Column) -> Column:
    return ppm.cast("double") / PPM


def fixed_to_percent(ppm: Column) -> Column:
    return ppm.cast("double") / 10_000


def difficulty_to_hash_rate(difficulty: Column) -> Column:
    """Expected hashes a second at ten minutes a block."""
    return difficulty.cast("double") * (2.0**32) / 600


def vbytes_to_weight(a: Column) -> Column:
    return a * WEIGHT_FACTOR


def weight_to_vsize(a: Column) -> Column:
    return F.ceil(a / WEIGHT_FACTOR).cast("long")


def per_second(a: Column, seconds: int) -> Column:
    return a.cast("double") / seconds


def days_to_years(a: Column) -> Column:
    return a.cast("double") / 365


def times_sqrt(a: Column, days: int) -> Column:
    """A daily deviation carried to a number of days."""
    return a * math.sqrt(days)


def cagr(percent: Column, days: int) -> Column:
    """Yearly growth in percent from growth in percent over days, which are a multiple of 365 above 0."""
    if days <= 0 or days % 365:
        raise ValueError("days must be a multiple of 365 above 0")
    return (F.pow(percent / 100 + 1, F.lit(1 / (days // 365))) - 1) * 100


def z_score(x: Column, mean: Column, deviation: Column) -> Column:
    return divide(x - mean, deviation)


def significant(cents: Column, digits: int = 5, most: int = 100_000_000) -> Column:
    """A price in cents cut to ``digits`` significant digits; prices of ``most`` or above count as ``most``."""
    scale = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.greatest(cents, F.lit(1)).cast("double"))) - (digits - 1), F.lit(0))).cast("long")
    return F.least(F.floor(cents / scale).cast("long") * scale, F.lit(most).cast("long"))


def linear_floor(cents: Column, size: int) -> Column:
    """The lower end of a price's bucket of ``size`` cents."""
    return F.floor(cents / size).cast("long") * size


def log_floor(cents: Column, per_decade: int) -> Column:
    """The lower end, rounded to a cent, of a price's bucket of which there are ``per_decade`` in a decade; 0 stays 0."""
    step = F.floor(F.log10(F.greatest(cents, F.lit(1)).cast("double")) * per_decade) / per_decade
    return F.when(cents <= 0, F.lit(0)).otherwise(F.round(F.pow(F.lit(10.0), step))).cast("long")


def log_bin(sats: Column, per_decade: int = 200, bins: int = 2400) -> Column:
    """round(log10(sats) x per_decade); null for 0 and beyond the last bin."""
    b = F.round(F.log10(F.greatest(sats, F.lit(1)).cast("double")) * per_decade).cast("int")
    return F.when((sats > 0) & (b >= 0) & (b < bins), b)


def bin_price(b: Column, per_decade: int = 200) -> Column:
    """Cents of a bitcoin where the outputs that are worth a round dollar fall into a bin."""
    return F.round(F.pow(F.lit(10.0), 10 - b / per_decade) * 100).cast("long")


def series_name(name: Column) -> Column:
    return F.lower(F.translate(name, "-", "_"))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once a row however often f uses it."""
    return F.transform(F.array(x), f)[0]
