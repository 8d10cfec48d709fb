"""Rounding and numeric checks: three-valued, null where an input is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def significant(x: Column | str, n: int) -> Column:
    """x with n significant figures, half up on its decimal digits."""
    return F.when(col(x) == 0, 0.0).otherwise(F.format_string(f"%.{n - 1}e", col(x).cast("double")).try_cast("double"))


def significant_any(x: Column, n: Column) -> Column:
    """As significant, with the number of figures in a column."""
    return F.when(x == 0, 0.0).when(n >= 1, F.call_function("format_string", F.concat(F.lit("%."), (n - 1).cast("string"), F.lit("e")), x.cast("double")).try_cast("double"))


def _bucket(ok: Column, no: str = "negative") -> Column:
    return F.when(ok, "positive").when(~ok, no)


def product_matches(reported: Column, a: Column, b: Column) -> Column:
    return _bucket(F.abs(reported - F.round(a * b, 2)) <= 0.01)


def lower_bound(value: Column, most: Column) -> Column:
    return F.least(value, most)


def at_least(value: Column, least: Column) -> Column:
    return _bucket(value >= least)


def in_range(value: Column, lo: Column, hi: Column) -> Column:
    """Null where the value or a bound is missing."""
    return F.when(value.isNotNull() & lo.isNotNull() & hi.isNotNull(), _bucket((value >= lo) & (value <= hi)))


def percentage_threshold(deviation: Column, limit: Column) -> Column:
    """neutral within the limit; above it no bucket."""
    return F.when(F.abs(deviation) <= limit, "neutral")


def thresholds(values: Column, lows: Column, highs: Column) -> Column:
    """negative on the first value outside its bounds; null if there are not as many values as checks."""
    out = F.exists(F.arrays_zip(values.alias("v"), lows.alias("l"), highs.alias("h")), lambda z: (z["v"] < z["l"]) | (z["v"] > z["h"]))
    return F.when((F.size(values) != F.size(lows)) | (F.size(lows) != F.size(highs)), None).when(out, "negative").otherwise("positive")


def text_match(condition: Column, a: Column, b: Column) -> Column:
    """neutral if the condition doesn't hold; else equality without case and repeated white space."""
    same = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.when(~F.coalesce(condition, F.lit(False)), "neutral").when(same(a) == same(b), "positive").otherwise("negative")


def usage_cost(prompt: Column, cached: Column, output: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """Dollars of a call, prices per million tokens; cached tokens are part of the prompt."""
    return ((prompt - cached) * price_in + cached * F.coalesce(price_cached, price_in) + output * price_out) / 1_000_000
