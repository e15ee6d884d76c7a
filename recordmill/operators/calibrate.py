"""Calibration of probabilities and score tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.nullsafe import attach
from recordmill.operators.ranks import exact_quantiles
from recordmill.session import materialize

EPS = 1e-7
N_BINS = 15
LOG_T = (-4.6, 4.6)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def nll_term(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def nll_brier(df: DataFrame, cells: Sequence[str], p: Column, y: Column) -> DataFrame:
    return df.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(nll_term(p, y)).alias("nll"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )


def bin_index(p: Column, n_bins: int = N_BINS) -> Column:
    """Equal-width bin; the right edge 1.0 belongs to the last bin."""
    return F.least(F.floor(p * n_bins), F.lit(n_bins - 1)).cast("int")


def reliability_bins(
    df: DataFrame, cells: Sequence[str], p: Column, y: Column, n_bins: int = N_BINS
) -> DataFrame:
    """Count, mean confidence and observed share per bin; empty bins are kept with nulls."""
    found = df.groupBy(*cells, bin_index(p, n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_conf"), F.avg(y).alias("emp_freq")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))
    base = found.select(*cells).distinct() if cells else df.sparkSession.range(1).select()
    grid = base.select(*cells, every.alias("bin"))
    out = attach(grid, found, [*cells, "bin"], "left")
    return out.select(
        *cells, "bin", (F.col("bin") / n_bins).alias("lo"), ((F.col("bin") + 1) / n_bins).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_conf", "emp_freq",
    )


def ece_from_bins(bins: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Expected calibration error: bin share times gap, summed."""
    gap = F.col("n") * F.abs(F.col("emp_freq") - F.col("mean_conf"))
    return bins.groupBy(*cells).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def fit_temperature(
    df: DataFrame, cells: Sequence[str], z: str, y: str, points: int = 24, rounds: int = 3
) -> DataFrame:
    """Temperature with the lowest NLL of sigmoid(z / T), searched on a log grid.

    Equal (score, label) rows are counted and written once, so the rounds read a narrow table.
    Each round evaluates ``points + 1`` temperatures in one pass and zooms in around the best;
    the rows are combined per (cell, temperature) where they are read.
    """
    low, high = LOG_T
    counts = df.groupBy(*cells, F.col(z).alias("__z"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__w"))
    df = materialize(counts, "scores")
    centre = df.select(*cells).distinct() if cells else df.sparkSession.range(1).select()
    centre = centre.withColumn("log_t", F.lit((low + high) / 2))
    half = (high - low) / 2
    for _ in range(rounds):
        offsets = F.array(*[F.lit(round(half * (2 * i / points - 1), 12)) for i in range(points + 1)])
        if cells:
            rows = attach(df, centre.select(*cells, "log_t"), cells)
        else:
            rows = df.withColumn("log_t", centre.select("log_t").scalar())
        rows = rows.withColumn("__o", F.explode(offsets))
        log_t = F.least(F.greatest(F.round(F.col("log_t") + F.col("__o"), 9), F.lit(low)), F.lit(high))
        term = nll_term(sigmoid(F.col("__z") / F.exp("__lt")), F.col("__y"))
        scored = rows.withColumn("__lt", log_t).groupBy(*cells, "__lt").agg(
            (F.sum(term * F.col("__w")) / F.sum("__w")).alias("__nll")
        )
        best = F.struct(F.round("__nll", 12), F.abs("__lt"))
        centre = scored.groupBy(*cells).agg(
            F.min_by("__lt", best).alias("log_t"), F.min("__nll").alias("nll")
        )
        half = 2 * half / points
    return centre.select(*cells, F.exp("log_t").alias("temperature"), "nll")


def calibration_report(
    df: DataFrame, cells: Sequence[str], columns: dict[str, Column], y: Column, n_bins: int = N_BINS
) -> DataFrame:
    """NLL, Brier and ECE of several probability columns in one long table."""
    versions = F.explode(
        F.array(*[F.struct(F.lit(k).alias("version"), v.alias("p")) for k, v in columns.items()])
    )
    long = df.select(*cells, y.alias("y"), versions.alias("v")).select(
        *cells, "y", F.col("v.version").alias("version"), F.col("v.p").alias("p")
    )
    by = [*cells, "version"]
    p, yy = F.col("p"), F.col("y")
    # One pass: sums per bin carry everything the three metrics need.
    bins = long.groupBy(*by, bin_index(p, n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(yy).alias("sy"),
        F.sum(nll_term(p, yy)).alias("snll"), F.sum((p - yy) * (p - yy)).alias("sb"),
    )
    return bins.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum("snll") / F.sum("n")).alias("nll"),
        (F.sum("sb") / F.sum("n")).alias("brier"),
        (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"),
    )


# Tiers


def tier_thresholds(
    train: DataFrame, cells: Sequence[str], score: str, label: str, neg_q: float = 0.95
) -> DataFrame:
    """``high`` = median of positives, ``mid`` = quantile of negatives, both from training rows."""
    q = exact_quantiles(train, [*cells, label], score, {"q50": 0.5, "qneg": neg_q})
    out = q.groupBy(*cells).agg(
        F.max(F.when(F.col(label) == 1, F.col("q50"))).alias("high"),
        F.max(F.when(F.col(label) == 0, F.col("qneg"))).alias("mid"),
    )
    return out.withColumn("degenerate", F.col("high") < F.col("mid"))


def tier(score: Column, high: Column, mid: Column) -> Column:
    return F.when(score >= high, "high").when(score >= mid, "mid").otherwise("low")


def domain_status(domain: Column, valid: Sequence[str], out_of_scope: Sequence[str]) -> Column:
    return (
        F.when(domain.isin(*out_of_scope), "out_of_scope")
        .when(domain.isin(*valid), "validated")
        .otherwise("unvalidated")
    )


def tier_metrics(df: DataFrame, cells: Sequence[str], tier_col: str, label: str) -> DataFrame:
    """Precision, recall and false-positive rate of the top tier and of the top two."""
    tiers = F.explode(
        F.array(
            F.struct(F.lit("high").alias("name"), (F.col(tier_col) == "high").alias("hit")),
            F.struct(F.lit("mid_plus").alias("name"), (F.col(tier_col) != "low").alias("hit")),
        )
    )
    y = F.col(label) == 1
    rows = df.select(*cells, y.alias("y"), tiers.alias("t")).select(
        *cells, "y", F.col("t.name").alias("tier_set"), F.col("t.hit").alias("hit")
    )
    out = rows.groupBy(*cells, "tier_set").agg(
        F.count(F.when(F.col("hit"), 1)).alias("n"),
        F.count(F.when(F.col("hit") & F.col("y"), 1)).alias("tp"),
        F.count(F.when(F.col("y"), 1)).alias("n_pos"),
        F.count(F.when(~F.col("y"), 1)).alias("n_neg"),
    )
    return out.select(
        *cells, "tier_set", "n", "tp",
        (F.col("tp") / F.nullif(F.col("n"), F.lit(0))).alias("precision"),
        (F.col("tp") / F.greatest("n_pos", F.lit(1))).alias("recall"),
        ((F.col("n") - F.col("tp")) / F.greatest("n_neg", F.lit(1))).alias("fpr"),
    )
