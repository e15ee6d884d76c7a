"""Ordered exclusion with reasons, funnel counts, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject_reason(rules: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """Name of the first rule that holds; a null condition does not reject."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit(kept))


def out_of_range(value: Column, low: float, high: float) -> Column:
    """True for a value outside [low, high] and for one that is not a number at all."""
    return ~F.coalesce(value.try_cast("double").between(low, high), F.lit(False))


def funnel(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def any_match(columns: Sequence[str], pattern: str) -> Column:
    """True if any of the columns matches."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return cond


def known(value: Column, missing: Sequence[str] = ("", "-1", "unknown")) -> Column:
    """The value, or null if it is a missing-value sentinel."""
    return F.when(~F.trim(value).isin(*missing), value)
