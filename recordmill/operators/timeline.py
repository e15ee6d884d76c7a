"""First-seen timelines per group and the labels and intervals derived from them.

A *member* row has group columns, a category and a month (null if undated). Groups are keyed by
all of their columns, usually (domain, group). Every step is a partial aggregate, so a group that
holds a third of all members is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.nullsafe import attach
from recordmill.functions.dates import approx_days, interval_bin

UNKNOWN = "unknown"


def group_size(members: DataFrame, group: Sequence[str]) -> DataFrame:
    """All members count, dated or not."""
    return members.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))


def first_seen(members: DataFrame, group: Sequence[str], category: str, ym: str) -> DataFrame:
    """Earliest month per (group, category) over dated members."""
    return (
        members.where(F.col(ym).isNotNull())
        .groupBy(*group, category)
        .agg(F.min(ym).alias("first_ym"))
    )


def first_seen_wide(
    first: DataFrame, group: Sequence[str], category: str, names: dict[str, str]
) -> DataFrame:
    """One ``first_<name>`` column per category; ``names`` maps category value to name."""
    return first.groupBy(*group).agg(
        *[
            F.min(F.when(F.col(category) == value, F.col("first_ym"))).alias(f"first_{name}")
            for value, name in names.items()
        ]
    )


def group_mode(members: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-empty value; ties go to the smallest value."""
    counts = (
        members.where(F.col(value).isNotNull() & (F.col(value) != ""))
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy(*group).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"),
        F.max("n").alias("mode_n"),
    )


def category_list(first: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """Sorted present categories as an array (bounded by the category vocabulary)."""
    return first.groupBy(*group).agg(F.array_sort(F.collect_set(category)).alias("categories"))


def _label_columns(category: str, target: str, when: Column | None = None) -> list[Column]:
    c = F.col(category)
    seen = (c != UNKNOWN) & when if when is not None else c != UNKNOWN
    known = F.count(F.when(seen, 1))
    hit = F.count(F.when(seen & (c == target), 1))
    return [
        (known >= 2).cast("int").alias("multi_category"),
        ((hit > 0) & (known > hit)).cast("int").alias("target_plus_other"),
    ]


def group_labels(first: DataFrame, group: Sequence[str], category: str, target: str) -> DataFrame:
    """``multi_category``: two known categories; ``target_plus_other``: target and another one.

    ``first`` has one row per (group, category), so counting rows counts distinct categories.
    """
    return first.groupBy(*group).agg(*_label_columns(category, target))


def group_intervals(
    first: DataFrame, group: Sequence[str], category: str, target: str
) -> DataFrame:
    """Span between first and last category, target minus earliest other, and that other."""
    c, ym = F.col(category), F.col("first_ym")
    known, other = c != UNKNOWN, (c != UNKNOWN) & (c != target)
    out = first.groupBy(*group).agg(
        *_label_columns(category, target),
        F.min(F.when(known, ym)).alias("first_any"),
        F.max(F.when(known, ym)).alias("last_any"),
        F.min(F.when(c == target, ym)).alias("first_target"),
        F.min(F.when(other, ym)).alias("first_other"),
        F.min(F.when(other, F.struct(ym.alias("ym"), c.alias("c")))).alias("source"),
    )
    span = F.when(F.col("multi_category") == 1, approx_days(F.col("first_any"), F.col("last_any")))
    signed = F.when(
        F.col("target_plus_other") == 1, approx_days(F.col("first_other"), F.col("first_target"))
    )
    return out.select(
        *group,
        "multi_category",
        "target_plus_other",
        span.alias("span_days"),
        F.coalesce(interval_bin(span), F.lit("")).alias("span_bin"),
        signed.alias("signed_days"),
        F.coalesce(interval_bin(signed, allow_negative=True), F.lit("")).alias("signed_bin"),
        F.when(F.col("target_plus_other") == 1, F.col("source.c")).alias("source_category"),
    )


def record_interval(
    ym: Column, category: Column, target: str, first_target: Column, first_other: Column,
    signed: bool = False,
) -> Column:
    """Days from a record to its group's event.

    A record of another category looks ahead to the first target; a target record looks back to
    the first other category. Negative values become 0 unless ``signed``.
    """
    days = F.when(category == target, approx_days(first_other, ym)).otherwise(
        approx_days(ym, first_target)
    )
    complete = ym.isNotNull() & first_target.isNotNull() & first_other.isNotNull()
    days = F.when(complete, days)
    return days if signed else F.greatest(days, F.when(days.isNotNull(), F.lit(0)))


def labels_as_of(
    first: DataFrame, group: Sequence[str], category: str, target: str, cutoffs: dict[int, str]
) -> DataFrame:
    """Labels known at each cutoff: one row per (group, cutoff) that has any dated member.

    ``cutoffs`` maps a number to the last day counted. The first-seen table already says when a
    category appeared, so all cutoffs need one pass over one row per (group, category).
    """
    dates = F.array(
        *[
            F.struct(F.lit(k).alias("cutoff"), F.lit(d).cast("date").alias("last_day"))
            for k, d in cutoffs.items()
        ]
    )
    rows = first.select("*", F.explode(dates).alias("__c")).select(
        *group, category, "first_ym", F.col("__c.cutoff").alias("cutoff"),
        F.col("__c.last_day").alias("last_day"),
    )
    known_by = F.col("first_ym") <= F.col("last_day")
    return rows.groupBy(*group, "cutoff").agg(*_label_columns(category, target, known_by))


def merge_pools(
    pools: DataFrame, keys: Sequence[str], first_of: dict[str, Column], any_of: Sequence[str]
) -> DataFrame:
    """One row per key: value of the first row in the given order, OR of the flags."""
    return pools.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c, order in first_of.items()],
        *[F.bool_or(c).alias(c) for c in any_of],
    )


def group_scores(records: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Mean score, highest label and size per group."""
    return records.groupBy(*group).agg(
        F.avg(score).alias("score"), F.max(label).alias("label"), F.count(F.lit(1)).alias("n")
    )


def size_weights(df: DataFrame, cells: Sequence[str], kind: str, out: str = "weight") -> DataFrame:
    """Row weights from cell sizes: ``balanced`` gives n/(k*n_cell), ``inverse`` gives 1/n_cell.

    Sizes are aggregated and joined back; a window would put a whole cell into one task.
    """
    sizes = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n_cell"))
    if kind == "inverse":
        weight = 1 / F.col("__n_cell")
        table = sizes.select(*cells, weight.alias(out))
    else:
        total = sizes.agg((F.sum("__n_cell") / F.count(F.lit(1))).alias("per_cell"))
        table = sizes.select(*cells, (total.scalar() / F.col("__n_cell")).alias(out))
    return attach(df, table, cells, "left")


def composition_subset(
    records: DataFrame, group: Sequence[str], category: str, label: str, allowed: Sequence[str]
) -> DataFrame:
    """All records of negative groups and of positive groups that touch an allowed category."""
    groups = records.groupBy(*group).agg(
        F.max(label).alias("__label"),
        F.coalesce(F.bool_or(F.col(category).isin(*allowed)), F.lit(False)).alias("__touches"),
    )
    keep = groups.where((F.col("__label") == 0) | F.col("__touches")).select(*group)
    return attach(records, keep, group, "left_semi")
