"""Data-quality gates: each returns a small report, ``require_*`` raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"key {list(keys)} is not unique, for example {bad[0]}")


def key_set_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys on both sides and on one side only."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(1))
    return a.join(b, list(keys), "full_outer").agg(
        F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("n_both"),
        F.count(F.when(F.col("__b").isNull(), 1)).alias("n_left_only"),
        F.count(F.when(F.col("__a").isNull(), 1)).alias("n_right_only"),
    )


def require_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    r = key_set_diff(left, right, keys).first()
    if r.n_left_only or r.n_right_only:
        raise ValueError(f"key sets differ: {r.n_left_only} left only, {r.n_right_only} right only")


def varying_groups(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Groups in which a value that should be constant is not.

    Minimum against maximum instead of a distinct count: one partial aggregate, no second shuffle.
    """
    return (
        df.groupBy(*group)
        .agg(
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.count(F.when(F.col(value).isNull(), 1)).alias("n_null"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("low <> high or (n_null > 0 and n_null < n)")
        .drop("n_null")
    )


def allowed_values(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    inside = F.col(column).isin(*allowed)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(column).isNull(), 1)).alias("n_null"),
        F.count(F.when(~inside, 1)).alias("n_outside"),
    )


def implication(df: DataFrame, if_true: Column, then: Column) -> DataFrame:
    """Rows where the premise holds and where it holds without the conclusion."""
    return df.agg(
        F.count(F.when(if_true, 1)).alias("n_premise"),
        F.count(F.when(if_true & ~F.coalesce(then, F.lit(False)), 1)).alias("n_violation"),
    )


def equal_length(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return df.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len")).withColumn(
        "equal", F.col("min_len").eqNullSafe(F.col("max_len"))
    )


def unassigned(df: DataFrame, column: str) -> DataFrame:
    empty = F.col(column).isNull() | (F.col(column) == "")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(empty, 1)).alias("n_unassigned"))


def in_band(metrics: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Every ``metric, value`` row of a named metric with its band and whether the value is inside.

    A null or missing value is outside: a metric without rows has one row with a null value. Other columns stay.
    """
    spark = metrics.sparkSession
    expected = spark.createDataFrame([(m, float(a), float(b)) for m, (a, b) in bands.items()], "metric string, low double, high double")
    inside = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False))
    return expected.join(metrics, "metric", "left").withColumn("inside", inside)


def require_band(metrics: DataFrame, metric: str, low: float, high: float) -> None:
    """Raise if a value of the named metric is outside [low, high]."""
    bad = metrics.where(
        (F.col("metric") == metric)
        & ~F.coalesce(F.col("value").between(low, high), F.lit(False))
    ).limit(1).collect()
    if bad:
        raise ValueError(f"{metric} outside [{low}, {high}]: {bad[0]}")
