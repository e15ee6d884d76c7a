"""Ranks, percentiles, quantiles, top-k and key-set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.nullsafe import attach
from recordmill.operators.ordering import row_numbers, running
from recordmill.session import materialize

GROUP_LIMIT = 1000  # default of spark.sql.optimizer.windowGroupLimitThreshold


def positions(df: DataFrame, part: Sequence[str], score: str, key: Sequence[str], out: str = "position") -> DataFrame:
    """1-based position by descending score, ties by key."""
    return row_numbers(df, part, [F.desc(score), *[F.asc(k) for k in key]], out)


def rank_table(
    df: DataFrame, part: Sequence[str], value: str, descending: bool = False, weight: str | None = None, total: str | None = None
) -> DataFrame:
    """One row per distinct value: count, rows before it, average-tie rank; ``total`` names a column for all rows of the part.

    Ties cost nothing here: equal values are one row before anything is ordered.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(n.alias("n_tied"))
    order = F.desc(value) if descending else F.asc(value)
    out = running(distinct, part, [order], before={"n_before": "n_tied"}, total={total: "n_tied"} if total else None, store=True)
    return out.withColumn("avg_rank", F.col("n_before") + (F.col("n_tied") + 1) / 2)


def average_ranks(df: DataFrame, part: Sequence[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Average-tie rank of each row; null for a null value."""
    table = rank_table(df, part, value, descending).select(*part, value, F.col("avg_rank").alias(out))
    return attach(df, table, [*part, value], "left")


def train_percentile(
    train: DataFrame, evaluated: DataFrame, part: Sequence[str], score: str
) -> DataFrame:
    """Share of training scores strictly below each evaluated score.

    Training counts and evaluated scores meet in one table of distinct scores, so neither side
    is broadcast and no row is compared with the whole training set.
    """
    both = (
        train.select(*part, score, F.lit(1).alias("__t"))
        .unionByName(evaluated.select(*part, score, F.lit(0).alias("__t")))
        .where(F.col(score).isNotNull())
        .groupBy(*part, score)
        .agg(F.sum("__t").alias("__t"))
    )
    both = materialize(both, "scores")
    below = running(both, part, [F.asc(score)], before={"__below": "__t"})
    if part:
        total = both.groupBy(*part).agg(F.sum("__t").alias("__total"))
        below = attach(below, total, part)
    else:
        below = below.withColumn("__total", both.agg(F.sum("__t")).scalar())
    share = F.col("__below") / F.nullif(F.col("__total"), F.lit(0))
    table = below.select(*part, score, share.alias("train_pct"))
    return attach(evaluated, table, [*part, score], "left")


#: Size of a quantile sketch, and the rank error that its estimates stay within (three times its stated error at 99 percent).
SKETCH_SIZE, SKETCH_ERROR = 400, 0.02


def quantile_sketches(df: DataFrame, part: Sequence[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable sketch a group, of fixed size: ``part, sketch``; nulls do not count."""
    return df.where(F.col(value).isNotNull()).groupBy(*part).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_sketches(sketches: DataFrame, part: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of finer groups put together, without reading the rows again."""
    return sketches.groupBy(*part).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, part: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``part, p, value, n``: estimated quantiles, and the number of values that the sketch has seen."""
    found = F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs
    ]))
    return sketches.select(*part, F.kll_sketch_get_n_double("sketch").alias("n"), found.alias("q")).select(*part, "q.p", "q.value", "n")


def exact_quantiles(df: DataFrame, part: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation; ``probs`` maps output names to probabilities."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("__n"))
    run = running(counts, part, [F.asc(value)], upto={"__upto": "__n"}, total={"__last": "__n"}, store=True)
    run = run.withColumn("__last", F.col("__last") - 1)

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("__upto") > index, F.col(value)))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * F.col("__last")
        low = F.floor(pos)
        aggs += [
            at(low).alias(f"__{name}_lo"),
            at(F.least(low + 1, F.col("__last"))).alias(f"__{name}_hi"),
            F.max(pos - low).alias(f"__{name}_w"),
        ]
    found = run.groupBy(*part).agg(*aggs)
    return found.select(
        *part,
        *[
            (
                F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_w")
            ).alias(n)
            for n in probs
        ],
    )


def top_k(df: DataFrame, part: Sequence[str], k: int, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """First k rows per group.

    Up to ``GROUP_LIMIT`` rows Spark cuts each group before the shuffle, so hot groups are cheap;
    beyond that the rows are numbered by ``row_numbers``.
    """
    if k > GROUP_LIMIT:
        return row_numbers(df, part, order, out).where(F.col(out) <= k).withColumn(out, F.col(out).cast("int"))
    w = W.partitionBy(*(part or [F.lit(0)])).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def percent_ranks(df: DataFrame, part: Sequence[str], value: str, out: str = "percent_rank") -> DataFrame:
    """``rows before / (n - 1)``, ties share the lowest rank; 0 for a single row, null for a null value."""
    table = rank_table(df, part, value, total="__n")
    pr = F.when(F.col("__n") > 1, F.col("n_before") / (F.col("__n") - 1)).otherwise(F.lit(0.0))
    return attach(df, table.select(*part, value, pr.alias(out)), [*part, value], "left")


def set_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Jaccard overlap of two key sets, per part."""
    on = [*part, *keys]
    a = left.select(*on).distinct().withColumn("__a", F.lit(1))
    b = right.select(*on).distinct().withColumn("__b", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).groupBy(*on).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b")).groupBy(*part).agg(
        F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("n_both"),
        F.count(F.lit(1)).alias("n_any"),
    ).withColumn("jaccard", F.col("n_both") / F.nullif(F.col("n_any"), F.lit(0)))
