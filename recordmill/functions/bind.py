"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct holding the values, each computed once per row.

    An expression used several times, or inside a lambda, is otherwise evaluated at every use.
    """
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(row), body)[0]
