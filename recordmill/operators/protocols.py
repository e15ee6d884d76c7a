"""Selection and validation protocols over long metric and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.operators import metrics


def select_on_val(
    table: DataFrame, cells: Sequence[str], candidate: str, value: str, then: Sequence[str] = ()
) -> DataFrame:
    """Best candidate per cell: highest value, then further metrics, then first name."""
    order = [F.col(value), *[F.col(m) for m in then]]
    named = F.struct(*order, F.col(candidate).alias("__name"))
    # The name breaks ties in ascending order: take the smallest name among the best values.
    best = table.groupBy(*cells).agg(F.max(F.struct(*order)).alias("__best"))
    joined = table.join(best, list(cells)) if cells else table.withColumn("__best", best.select("__best").scalar())
    keep = joined.where(F.struct(*order).eqNullSafe(F.col("__best")))
    return keep.groupBy(*cells).agg(F.min(named).alias("s")).select(
        *cells, F.col("s.__name").alias("selected"), F.col(f"s.{value}").alias("val_value")
    )


def select_then_test(
    aucs: DataFrame, cells: Sequence[str], candidate: str = "candidate", split: str = "split", value: str = "auc"
) -> DataFrame:
    """Pick on val, read test once: ``(cells, selected, val_value, test_value)``."""
    val = aucs.where((F.col(split) == "val") & F.col(value).isNotNull())
    picked = select_on_val(val, cells, candidate, value)
    test = aucs.where(F.col(split) == "test").select(
        *cells, F.col(candidate).alias("selected"), F.col(value).alias("test_value")
    )
    return picked.join(test, [*cells, "selected"], "left")


def summarise_seeds(picked: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Mean and population sd of the test value over seeds, and the most frequent pick."""
    stats = picked.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("test_value").alias("test_mean"),
        F.stddev_pop("test_value").alias("test_sd"),
    )
    counts = picked.groupBy(*cells, "selected").agg(F.count(F.lit(1)).alias("__c"))
    mode = counts.groupBy(*cells).agg(
        F.min_by("selected", F.struct(-F.col("__c"), F.col("selected"))).alias("top_pick"),
        F.max("__c").alias("top_freq"),
    )
    return stats.join(mode, list(cells))


def arm_delta(summary: DataFrame, cells: Sequence[str], arm: str, high: str, low: str, value: str) -> DataFrame:
    """Value of one arm minus the other, per cell."""
    v = F.col(value)
    return summary.groupBy(*cells).agg(
        F.max(F.when(F.col(arm) == high, v)).alias(f"{high}_mean"),
        F.max(F.when(F.col(arm) == low, v)).alias(f"{low}_mean"),
    ).withColumn("delta", F.col(f"{high}_mean") - F.col(f"{low}_mean"))


def restrict_pool(aucs: DataFrame, pool: DataFrame, candidate: str = "candidate") -> DataFrame:
    return aucs.join(pool.select(candidate), candidate, "left_semi")


def result_delta(
    base: DataFrame, other: DataFrame, cells: Sequence[str], choice: str, value: str
) -> DataFrame:
    """Changed choices and value differences of two result tables on common cells."""
    a = base.select(*cells, F.col(choice).alias("base_choice"), F.col(value).alias("base_value"))
    b = other.select(*cells, F.col(choice).alias("other_choice"), F.col(value).alias("other_value"))
    return a.join(b, list(cells)).select(
        *cells, "base_choice", "other_choice",
        (~F.col("base_choice").eqNullSafe(F.col("other_choice"))).alias("changed"),
        (F.col("other_value") - F.col("base_value")).alias("delta"),
    )


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows in common, largest absolute difference and rank correlation of two runs."""
    both = a.select(*keys, F.col(value).alias("__a")).join(
        b.select(*keys, F.col(value).alias("__b")), list(keys)
    )
    diff = both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_abs_diff"))
    rho = metrics.spearman(both, [], "__a", "__b").select("spearman")
    return diff.withColumn("spearman", rho.scalar())


def tidy(df: DataFrame, cells: Sequence[str], experiment: str) -> DataFrame:
    """Wide metric columns to long ``(experiment, cells, metric, value)`` rows."""
    values = [c for c in df.columns if c not in cells]
    wide = df.select(*cells, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(list(cells), values, "metric", "value").withColumn("experiment", F.lit(experiment))


def eval_side(year: Column, cutoff: Column) -> Column:
    return F.when(year <= cutoff, "train").otherwise("eval")
