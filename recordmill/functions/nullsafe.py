"""Joins in which a null key matches a null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``table`` for the same keys; nulls are a key like any other.

    Spark plans the null-safe comparison as an equi-join. Key columns come from ``df``.
    """
    marked = {k: f"__key_{i}" for i, k in enumerate(keys)}
    other = table.select(*[F.col(k).alias(m) for k, m in marked.items()], *[c for c in table.columns if c not in marked])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(m)) for k, m in marked.items()])
    return df.join(other, same, how).drop(*marked.values())
