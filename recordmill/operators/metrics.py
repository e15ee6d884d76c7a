"""Exact score metrics per cell.

Rows are reduced to one row per (cell, distinct score) before anything is ordered, so ties are
exact and the ordered part is as small as the scores allow. ``cells`` may be empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions.nullsafe import attach
from recordmill.functions.bind import let
from recordmill.functions.hashing import hash_unit
from recordmill.operators.ordering import running
from recordmill.operators.ranks import rank_table
from recordmill.session import materialize


def with_totals(df: DataFrame, cells: Sequence[str], **sums: str) -> DataFrame:
    """Attach per-cell sums; keyword = output name, value = summed column."""
    totals = df.groupBy(*cells).agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    if cells:
        return attach(df, totals, cells)
    one = totals.select(F.struct(*sums).alias("__t")).scalar()
    return df.withColumn("__t", one).select(df["*"], *[F.col(f"__t.{o}").alias(o) for o in sums])


def score_counts(
    df: DataFrame, cells: Sequence[str], score: str, label: str, weight: str | None = None
) -> DataFrame:
    """Weighted positives ``p`` and negatives ``n`` per (cell, score); null scores are left out."""
    w = F.col(weight) if weight else F.lit(1)
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*cells, F.col(score).alias("score"))
        .agg(F.sum(F.col(label) * w).alias("p"), F.sum((1 - F.col(label)) * w).alias("n"))
    )


def auc_from_counts(counts: DataFrame, cells: Sequence[str]) -> DataFrame:
    """ROC AUC from ``score_counts``; ties count one half; null if a cell has one class."""
    ordered = running(counts, cells, [F.asc("score")], before={"lower_n": "n"}, store=True)
    won = F.col("p").cast("double") * (F.col("lower_n") + F.col("n") / 2)
    pairs = F.sum("p").cast("double") * F.sum("n")
    return ordered.groupBy(*cells).agg(
        (F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.sum("p").alias("n_pos"),
        F.sum("n").alias("n_neg"),
    )


def auc(
    df: DataFrame, cells: Sequence[str], score: str, label: str, weight: str | None = None
) -> DataFrame:
    return auc_from_counts(score_counts(df, cells, score, label, weight), cells)


def auc_both(df: DataFrame, cells: Sequence[str], score: str, label: str) -> DataFrame:
    """AUC of the score and of its negative."""
    out = auc(df, cells, score, label)
    return out.withColumn("auc_flipped", 1 - F.col("auc")).withColumn(
        "auc_best", F.greatest("auc", "auc_flipped")
    )


def roc_points(df: DataFrame, cells: Sequence[str], score: str, label: str) -> DataFrame:
    """True and false positive rate when every score at or above the threshold is positive."""
    counts = score_counts(df, cells, score, label)
    out = running(counts, cells, [F.desc("score")], upto={"tp": "p", "fp": "n"}, total={"n_pos": "p", "n_neg": "n"}, store=True)
    return out.select(
        *cells, F.col("score").alias("threshold"), "tp", "fp", "n_pos", "n_neg",
        (F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0))).alias("fpr"),
    )


def average_precision(df: DataFrame, cells: Sequence[str], score: str, label: str) -> DataFrame:
    """Sum over distinct scores of recall gain times precision."""
    counts = score_counts(df, cells, score, label)
    out = running(counts, cells, [F.desc("score")], upto={"tp": "p", "fp": "n"}, store=True)
    gain = F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return out.groupBy(*cells).agg(
        (F.sum(gain) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"),
        F.sum("p").alias("n_pos"),
    )


def youden_threshold(df: DataFrame, cells: Sequence[str], score: str, label: str) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one if several share it."""
    points = roc_points(df, cells, score, label).withColumn("j", F.col("tpr") - F.col("fpr"))
    return points.groupBy(*cells).agg(
        F.max_by("threshold", F.struct(F.round("j", 12), F.col("threshold"))).alias("threshold"),
        F.max("j").alias("youden_j"),
    )


def confusion(df: DataFrame, cells: Sequence[str], predicted: Column, label: str) -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*cells).agg(
        F.count(F.when(predicted & y, 1)).alias("tp"),
        F.count(F.when(predicted & ~y, 1)).alias("fp"),
        F.count(F.when(~predicted & y, 1)).alias("fn"),
        F.count(F.when(~predicted & ~y, 1)).alias("tn"),
    )


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 if a margin is empty."""
    tp, fp, fn, tn = [c.cast("double") for c in (tp, fp, fn, tn)]
    margin = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce((tp * tn - fp * fn) / F.nullif(margin, F.lit(0.0)), F.lit(0.0))


def binary_metrics(df: DataFrame, cells: Sequence[str], predicted: Column, label: str) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on empty denominators) and positive rate."""
    out = confusion(df, cells, predicted, label)
    tp, fp, fn, tn = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    n = tp + fp + fn + tn

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return out.select(
        *cells, n.alias("n"), "tp", "fp", "fn", "tn",
        ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + fn, n).alias("positive_rate"),
        mcc(tp, fp, fn, tn).alias("mcc"),
    )


def class_table(
    df: DataFrame, cells: Sequence[str], truth: str, predicted: str, weight: str | None = None
) -> DataFrame:
    """Per cell and class: true count, predicted count, hits.

    Classes are the union of true and predicted labels; the input shrinks to the confusion
    matrix first.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    matrix = df.groupBy(*cells, F.col(truth).alias("__y"), F.col(predicted).alias("__q")).agg(w.alias("__w"))
    n, none = F.col("__w"), F.col("__w") * 0
    hit = F.when(F.col("__y") == F.col("__q"), n).otherwise(none)
    sides = F.array(
        F.struct(F.col("__y").alias("cls"), n.alias("t"), none.alias("q"), hit.alias("h")),
        F.struct(F.col("__q").alias("cls"), none.alias("t"), n.alias("q"), none.alias("h")),
    )
    return (
        matrix.select(*cells, F.explode(sides).alias("s"))
        .groupBy(*cells, F.col("s.cls").alias("cls"))
        .agg(F.sum("s.t").alias("n_true"), F.sum("s.q").alias("n_pred"), F.sum("s.h").alias("hits"))
    )


def multiclass_metrics(
    df: DataFrame, cells: Sequence[str], truth: str, predicted: str, weight: str | None = None
) -> DataFrame:
    """Accuracy, balanced accuracy over true classes, macro F1 over all classes."""
    return multiclass_from_classes(class_table(df, cells, truth, predicted, weight), cells)


def multiclass_from_classes(classes: DataFrame, cells: Sequence[str]) -> DataFrame:
    recall = F.col("hits") / F.nullif(F.col("n_true"), F.lit(0))
    f1 = 2 * F.col("hits") / (F.col("n_true") + F.col("n_pred"))
    return classes.groupBy(*cells).agg(
        (F.sum("hits") / F.sum("n_true")).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.sum("n_true").alias("n"),
        F.count(F.when(F.col("n_true") > 0, 1)).alias("n_classes"),
    )


def regression_metrics(df: DataFrame, cells: Sequence[str], truth: str, predicted: str) -> DataFrame:
    y, q = F.col(truth), F.col(predicted)
    err = q - y
    out = df.where(y.isNotNull() & q.isNotNull()).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.avg(err * err) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.corr(y, q).alias("pearson"),
    )
    return out


def spearman(df: DataFrame, cells: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average-tie ranks, from the table of distinct (x, y) values."""
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*cells, F.col(x).alias("__x"), F.col(y).alias("__y"))
        .agg(F.count(F.lit(1)).cast("double").alias("__w"))
    )
    pairs = materialize(pairs, "pairs")
    rx = rank_table(pairs, cells, "__x", weight="__w").select(*cells, "__x", F.col("avg_rank").alias("__rx"))
    ry = rank_table(pairs, cells, "__y", weight="__w").select(*cells, "__y", F.col("avg_rank").alias("__ry"))
    ranked = attach(attach(pairs, rx, [*cells, "__x"]), ry, [*cells, "__y"])
    ranked = with_totals(ranked, cells, __n="__w")
    # The mean of average-tie ranks is always (n + 1) / 2.
    dx = F.col("__rx") - (F.col("__n") + 1) / 2
    dy = F.col("__ry") - (F.col("__n") + 1) / 2
    w = F.col("__w")
    out = ranked.groupBy(*cells).agg(
        F.sum(w * dx * dy).alias("__xy"), F.sum(w * dx * dx).alias("__xx"),
        F.sum(w * dy * dy).alias("__yy"), F.sum(w).cast("bigint").alias("n"),
    )
    scale = F.sqrt(F.col("__xx")) * F.sqrt(F.col("__yy"))
    return out.select(*cells, "n", (F.col("__xy") / F.nullif(scale, F.lit(0.0))).alias("spearman"))


def kendall_tau(df: DataFrame, cells: Sequence[str], x: str, y: str) -> DataFrame:
    """Kendall tau-b without forming pairs.

    Give each distinct y its rank as a binary number. Two values first differ in exactly one bit
    below their common prefix, so every pair is decided in one (bit level, prefix) bucket. Within
    a bucket, sorted by x, counting earlier ones before each zero gives the discordant pairs and
    earlier zeros before each one the concordant pairs: n log n rows in place of n squared pairs.
    """
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*cells, F.col(x).alias("__x"), F.col(y).alias("__y"))
        .agg(F.count(F.lit(1)).cast("double").alias("__w"))
    )
    pairs = materialize(pairs, "pairs")
    ys = pairs.select(*cells, "__y").distinct()
    dense = running(ys, cells, [F.asc("__y")], number="__r").withColumn("__r", F.col("__r") - 1)
    bits = int(dense.agg(F.coalesce(F.max("__r"), F.lit(0))).first()[0]).bit_length()
    ranked = attach(pairs, dense, [*cells, "__y"])

    levels = F.explode(F.sequence(F.lit(0), F.lit(max(bits - 1, 0))))
    spread = ranked.select(*cells, "__x", "__r", "__w", levels.alias("__level"))
    r = F.col("__r")
    prefix = F.floor(r / F.pow(F.lit(2.0), F.col("__level") + 1)).cast("bigint")
    one = F.pmod(F.floor(r / F.pow(F.lit(2.0), F.col("__level"))), F.lit(2)).cast("double")
    buckets = spread.groupBy(*cells, "__level", prefix.alias("__prefix"), "__x").agg(
        F.sum(one * F.col("__w")).alias("ones"), F.sum((1 - one) * F.col("__w")).alias("zeros")
    )
    counted = running(
        buckets, [*cells, "__level", "__prefix"], [F.asc("__x")],
        before={"ones_before": "ones", "zeros_before": "zeros"}, store=True,
    )
    net = counted.groupBy(*cells).agg(
        F.sum(F.col("ones") * F.col("zeros_before")).alias("concordant"),
        F.sum(F.col("zeros") * F.col("ones_before")).alias("discordant"),
    )

    def tied(by: Sequence[str], out: str) -> DataFrame:
        n = pairs.groupBy(*cells, *by).agg(F.sum("__w").alias("__t"))
        return n.groupBy(*cells).agg(F.sum(F.col("__t") * (F.col("__t") - 1) / 2).alias(out))

    parts = [net, tied([], "__n0"), tied(["__x"], "__nx"), tied(["__y"], "__ny")]
    if cells:
        out = parts[0]
        for p in parts[1:]:
            out = attach(out, p, cells)
    else:
        out = parts[0]
        for p, c in zip(parts[1:], ["__n0", "__nx", "__ny"]):
            out = out.withColumn(c, p.scalar())
    scale = F.sqrt(F.col("__n0") - F.col("__nx")) * F.sqrt(F.col("__n0") - F.col("__ny"))
    tau = (F.col("concordant") - F.col("discordant")) / F.nullif(scale, F.lit(0.0))
    return out.select(*cells, "concordant", "discordant", tau.alias("tau_b"))


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent class, the smallest of those tied."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("cls"))


def random_baseline(
    train: DataFrame, test: DataFrame, label: str, key: Sequence[str], runs: int, seed: int
) -> DataFrame:
    """Test rows with a class drawn by hash from the training shares, once per run.

    The class list is bounded by the label vocabulary and travels as one array.
    """
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    shares = counts.agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), F.col("__n").alias("n")))).alias("a")
    ).select(
        F.transform(
            "a",
            lambda e, i: F.struct(
                e["c"].alias("c"),
                (
                    F.aggregate(F.slice("a", 1, i + 1), F.lit(0).cast("bigint"), lambda s, v: s + v["n"])
                    / F.aggregate("a", F.lit(0).cast("bigint"), lambda s, v: s + v["n"])
                ).alias("upto"),
            ),
        ).alias("a")
    )
    rows = test.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    rows = rows.withColumn("__shares", shares.scalar())
    drawn = let(
        lambda v: F.element_at(F.filter("__shares", lambda e: e["upto"] > v["u"]), 1)["c"],
        u=hash_unit(seed, "run", *key),
    )
    return rows.withColumn("drawn", drawn).drop("__shares")


def log_binomial_window(n: Column, k_mean: Column, sd: Column) -> tuple[Column, Column]:
    """Support of a distribution around its mean beyond which terms vanish in double precision."""
    reach = F.ceil(40 * sd) + 50
    return F.greatest(F.lit(0), F.floor(k_mean) - reach), F.least(n, F.ceil(k_mean) + reach)


def _log_weight(low: Column, at: Column, ratio) -> Column:
    """Log of weight(at) / weight(low), where ``ratio(k)`` is weight(k) / weight(k - 1)."""
    steps = F.when(at > low, F.sequence((low + 1).cast("bigint"), at.cast("bigint")))
    steps = F.coalesce(steps, F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(0.0), lambda w, k: w + F.log(ratio(k)))


def _mass(low: Column, high: Column, base: Column, ratio, keep=None) -> Column:
    """Sum of weight(k) over k in low..high where ``keep(k, log weight)``, in units of exp(base)."""

    def step(acc: Column, k: Column) -> Column:
        w = acc["w"] + F.when(k > low, F.log(ratio(k))).otherwise(0.0)
        term = F.exp(w) if keep is None else F.when(keep(k, w), F.exp(w)).otherwise(0.0)
        return F.struct(w.alias("w"), (acc["s"] + term).alias("s"))

    start = F.struct((-base).alias("w"), F.lit(0.0).alias("s"))
    ks = F.sequence(low.cast("bigint"), high.cast("bigint"))
    return F.aggregate(ks, start, step)["s"]


def sign_test_p(k: Column, n: Column) -> Column:
    """Two-sided sign test: twice the smaller binomial tail at one half, at most 1."""
    low, high = log_binomial_window(n, n / 2, F.sqrt(n.cast("double")) / 2)

    def p(v: Column) -> Column:
        def ratio(i: Column) -> Column:
            return (v["n"] - i + 1) / i

        def masses(u: Column) -> Column:
            tail = _mass(v["low"], v["high"], u["base"], ratio, lambda i, w: i <= v["small"])
            return F.least(F.lit(1.0), 2 * tail / _mass(v["low"], v["high"], u["base"], ratio))

        return let(masses, base=_log_weight(v["low"], F.greatest(v["low"], F.floor(v["n"] / 2)), ratio))

    return let(p, n=n, small=F.least(k, n - k), low=low, high=high)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher exact test of [[a, b], [c, d]]: tables at most as likely as the observed."""
    row, col, n = a + b, a + c, a + b + c + d
    mean = row * col / n
    sd = F.sqrt(mean * ((n - row) / n) * ((n - col) / F.greatest(n - 1, F.lit(1))))
    low, high = log_binomial_window(F.least(row, col), mean, sd)
    low = F.greatest(low, row + col - n)

    def p(v: Column) -> Column:
        def ratio(k: Column) -> Column:
            return ((v["row"] - k + 1) * (v["col"] - k + 1)) / (k * (v["rest"] + k))

        def masses(u: Column) -> Column:
            base = u["base"]
            seen = u["seen"] - base + 1e-7
            extreme = _mass(v["low"], v["high"], base, ratio, lambda k, w: w <= seen)
            value = F.least(F.lit(1.0), extreme / _mass(v["low"], v["high"], base, ratio))
            # Outside the window every table of this kind is rarer than double precision can say.
            return F.when(v["a"].between(v["low"], v["high"]), value).otherwise(0.0)

        at = F.least(F.greatest(v["a"], v["low"]), v["high"])
        return let(
            masses, base=_log_weight(v["low"], F.greatest(v["low"], v["middle"]), ratio),
            seen=_log_weight(v["low"], at, ratio),
        )

    return let(p, a=a, row=row, col=col, rest=n - row - col, middle=F.floor(mean), low=low, high=high)


def bh_adjust(df: DataFrame, family: Sequence[str], p: str, key: Sequence[str], out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q values: running minimum of p * n / rank from the largest p down."""
    order = [F.asc(p), *[F.asc(k) for k in key]]
    ranked = running(df, family, order, number="__rank")
    ranked = with_totals(ranked.withColumn("__one", F.lit(1)), family, __n="__one")
    ranked = ranked.withColumn("__raw", F.least(F.col(p) * F.col("__n") / F.col("__rank"), F.lit(1.0)))
    done = running(ranked, family, [F.desc("__rank")], lowest={out: "__raw"})
    return done.select(*df.columns, out)


def js_distance(
    df: DataFrame, part: Sequence[str], side: Column, category: str, min_count: int = 1
) -> DataFrame:
    """Jensen-Shannon distance (base 2, square root) between the categories of two sides.

    ``side`` is a boolean column; parts with fewer than ``min_count`` rows on a side give null.
    """
    counts = df.groupBy(*part, F.col(category).alias("__c")).agg(
        F.count(F.when(side, 1)).alias("__a"), F.count(F.when(~side, 1)).alias("__b")
    )
    return js_from_counts(counts, part, "__a", "__b", min_count)


def js_from_counts(counts: DataFrame, part: Sequence[str], a: str, b: str, min_count: int = 1) -> DataFrame:
    """The same from one row per (part, category) with the counts of both sides."""
    rows = with_totals(counts, part, n_a=a, n_b=b)
    pa, pb = F.col(a) / F.nullif(F.col("n_a"), F.lit(0)), F.col(b) / F.nullif(F.col("n_b"), F.lit(0))
    mid = (pa + pb) / 2
    term = F.when(pa > 0, pa * F.log2(pa / mid)).otherwise(0.0) + F.when(
        pb > 0, pb * F.log2(pb / mid)
    ).otherwise(0.0)
    out = rows.groupBy(*part).agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"),
        F.sqrt(F.greatest(F.sum(term) / 2, F.lit(0.0))).alias("__js"),
    )
    enough = (F.col("n_a") >= min_count) & (F.col("n_b") >= min_count)
    return out.select(*part, "n_a", "n_b", F.when(enough, F.col("__js")).alias("js_distance"))
