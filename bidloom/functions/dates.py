"""Dates and deadlines."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, once
from .vocab import DATE_FORMATS


def parse_date(text: Column | str) -> Column:
    """The printed date forms in order, ordinal endings dropped; null for anything else."""
    t = F.regexp_replace(F.trim(col(text).cast("string")), r"(\d)(st|nd|rd|th)\b", "$1")
    # A form is tried where the text has its marks: each trial that fails costs an exception.
    marks = lambda x, f: reduce(and_, [F.contains(x, F.lit(m)) for m in sorted({c for c in f if not c.isalpha()})])
    return once(t, lambda x: F.coalesce(*[F.when(marks(x, f), F.try_to_date(x, f)) for f in DATE_FORMATS]))


def add_working_days(day: Column | str, n: int) -> Column:
    """The n-th Monday to Friday after a day; public holidays aren't known."""
    d = col(day)
    span = F.sequence(F.date_add(d, 1), F.date_add(d, n + 2 * (n // 5 + 1) + 2))
    return F.element_at(F.filter(span, lambda x: F.weekday(x) < 5), n)


def add_working_days_by(day: Column, n: Column) -> Column:
    """As add_working_days, with the number of days in a column."""
    span = F.sequence(F.date_add(day, 1), F.date_add(day, (n + 2 * (F.floor(n / 5) + 1) + 2).cast("int")))
    return F.when(day.isNotNull() & (n >= 1), F.get(F.filter(span, lambda x: F.weekday(x) < 5), n - 1))


def add_calendar_days(day: Column | str, n: int) -> Column:
    return F.date_add(col(day), n)


def on_time(actual: Column | str, deadline: Column | str) -> Column:
    return F.when(col(actual).isNull() | col(deadline).isNull(), None).when(col(actual) <= col(deadline), "positive").otherwise("negative")


def not_earlier_than(check: Column | str, closing: Column | str, months: int) -> Column:
    """check lies within so many months before closing; the day is clamped to the month's end."""
    return col(check) >= F.add_months(col(closing), -months)


def within(issue: Column | str, closing: Column | str, expiry: Column | str) -> Column:
    return col(closing).between(col(issue), col(expiry))


def retry_wait(attempts: Column | str, base: float = 2.0, most: float = 120.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), col(attempts)))


def iso_utc(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
