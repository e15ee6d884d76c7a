"""Partial dates, months and approximate intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill.functions.bind import let
from recordmill.functions.hashing import _col

DEFAULT_MONTH = 6
DAYS_PER_YEAR, DAYS_PER_MONTH = 365, 30

#: Datetime patterns of whole dates, of months and of years.
DAY_PATTERNS, MONTH_PATTERNS = ("d-MMM-yyyy", "yyyy-M-d", "yyyy/M/d"), ("MMM-yyyy", "yyyy-M")


def parse_partial_date(raw: Column | str) -> Column:
    """Struct ``(y, m, d, precision)``; nulls where a part is missing.

    A text that has the shape of a date with a month's name, but no month of that name, still
    gives its year and day. A numeric date that no calendar has, a range of years or any other text gives nulls
    and the precision ``none``.
    """
    text = F.trim(_col(raw))
    # month names are matched in any case
    named = F.regexp_replace(F.initcap(F.lower(F.regexp_replace(text, "-", " "))), " ", "-")

    def first(patterns: tuple[str, ...]) -> Column:
        tries = [F.try_to_timestamp(named if "MMM" in p else text, F.lit(p)).cast("date") for p in patterns]
        return F.coalesce(*tries)

    def described(v: Column) -> Column:
        date = F.coalesce(v["day"], v["month"])
        odd = F.split(v["odd"], "-")
        y = F.coalesce(F.year(date), F.element_at(odd, -1).try_cast("int"), v["year"])
        m = F.month(date)
        d = F.coalesce(F.day(v["day"]), F.when(F.size(odd) == 3, F.element_at(odd, 1).try_cast("int")))
        precision = F.when(y.isNull(), "none").when(m.isNull(), "year").when(d.isNull(), "month").otherwise("day")
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"), precision.alias("precision"))

    return let(
        described,
        day=first(DAY_PATTERNS),
        month=first(MONTH_PATTERNS),
        year=F.when(text.rlike("^[0-9]{4}$"), text).try_cast("int"),
        odd=F.when(text.rlike("^([0-9]{1,2}-)?[A-Za-z]{3}-[0-9]{4}$"), text),
    )


def ym_string(year: Column, month: Column) -> Column:
    """``YYYY-MM`` with month 06 where it is missing; null without a year."""
    return F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"),
        F.lpad(F.coalesce(month, F.lit(DEFAULT_MONTH)).cast("string"), 2, "0"),
    )


def month_of(ts: Column | str) -> Column:
    return F.trunc(_col(ts), "month")


def approx_days(start: Column, end: Column) -> Column:
    """Days between two months counted as 365 per year and 30 per month."""
    return (F.year(end) - F.year(start)) * DAYS_PER_YEAR + (
        F.month(end) - F.month(start)
    ) * DAYS_PER_MONTH


def interval_bin(days: Column, allow_negative: bool = False) -> Column:
    """Year bins; a negative value is its own bin, or counts by its absolute value."""
    years = (days if allow_negative else F.abs(days)) / 365.25
    bins = F.when(years < 1, "<1yr").when(years < 3, "1-3yr").when(years < 5, "3-5yr")
    bins = F.when(days.isNotNull(), bins.otherwise("5yr+"))
    if allow_negative:
        bins = F.when(days < 0, "negative").otherwise(bins)
    return bins


def digitize(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value (right-open bins)."""
    out = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(value < edge, F.lit(i)).otherwise(out)
    return F.when(value.isNotNull(), out)
