"""Joins with the checks and reports the curation work needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.operators import gates


def join_validated(
    left: DataFrame, right: DataFrame, keys: Sequence[str], check_left: bool = True
) -> DataFrame:
    """Inner join that fails unless the keys are unique on the right (and on the left)."""
    gates.require_unique(right, keys)
    if check_left:
        gates.require_unique(left, keys)
    return left.join(right, list(keys))


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, object] | None = None
) -> DataFrame:
    """Left join to a table with one row per key; listed columns get a default.

    The right side has unique keys, so a hot key only makes the left side of one join partition
    large, and adaptive execution splits that side. Small lookups become broadcasts by size.
    """
    out = left.join(right, list(keys), "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()}
    return out.withColumns(filled) if filled else out


def drop_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kept and dropped rows of an inner join to a key table, in one row."""
    marked = left.join(
        right.select(*keys).distinct().withColumn("__hit", F.lit(1)), list(keys), "left"
    )
    return marked.agg(
        F.count("__hit").alias("n_kept"),
        F.count(F.when(F.col("__hit").isNull(), 1)).alias("n_dropped"),
    )


def upsert_fill_missing(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], value: str, unknown: str = "unknown"
) -> DataFrame:
    """Insert new keys; replace a stored value only if it is unknown and the new one is known.

    Both inputs have one row per key. The result has the columns of ``stored`` and ``action``.
    """
    rest = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*rest).alias("__old"))
    new = incoming.select(*keys, F.struct(*rest).alias("__new"))
    both = old.join(new, list(keys), "full_outer")
    is_unknown = F.coalesce(F.col(f"__old.{value}"), F.lit(unknown)) == unknown
    improves = is_unknown & (F.coalesce(F.col(f"__new.{value}"), F.lit(unknown)) != unknown)
    action = (
        F.when(F.col("__old").isNull(), "insert")
        .when(F.col("__new").isNotNull() & improves, "replace")
        .otherwise("keep")
    )
    both = both.withColumn("action", action)
    picked = [
        F.when(F.col("action") == "keep", F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c)
        for c in rest
    ]
    return both.select(*keys, *picked, "action")


def table_diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Rows added, removed or changed between two tables with one row per key."""
    a = old.select(*keys, F.struct(*columns).alias("__old"))
    b = new.select(*keys, F.struct(*columns).alias("__new"))
    both = a.join(b, list(keys), "full_outer")
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "removed")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    )
    values = [F.col(f"__old.{c}").alias(f"old_{c}") for c in columns]
    values += [F.col(f"__new.{c}").alias(f"new_{c}") for c in columns]
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", *values)


def batch_pairs(
    df: DataFrame, block: str, key: str, target: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Unordered pairs with unequal target inside one training batch, labelled +1 / -1.

    ``block`` numbers batches of a fixed small size (see ``batch_number``), so the number of
    pairs grows with the number of rows, not with its square.
    """
    cols = [key, target, *carry]
    a = df.select(block, *[F.col(c).alias(f"{c}_i") for c in cols])
    b = df.select(block, *[F.col(c).alias(f"{c}_j") for c in cols])
    pairs = a.join(b, block).where(
        (F.col(f"{key}_i") < F.col(f"{key}_j")) & (F.col(f"{target}_i") != F.col(f"{target}_j"))
    )
    sign = F.when(F.col(f"{target}_i") > F.col(f"{target}_j"), 1).otherwise(-1)
    return pairs.withColumn("preference", sign)


def batch_number(row_number: Column, size: int) -> Column:
    return F.floor((row_number - 1) / size).cast("bigint")
