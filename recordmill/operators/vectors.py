"""Vector statistics, reference-set similarity and second moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.functions import vectors as V
from recordmill.functions.hashing import hash_key
from recordmill.operators.nearest import nearest_references
from recordmill.operators.ordering import row_numbers


def moments(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Count, mean and population variance per dimension, as arrays, in one aggregate."""
    v = array_to_vector(F.col(vector))
    out = df.groupBy(*by).agg(
        Summarizer.mean(v).alias("__m"), Summarizer.variance(v).alias("__v"), F.count(F.lit(1)).alias("n")
    )
    shrink = (F.col("n") - 1) / F.col("n")
    return out.select(
        *by, "n", vector_to_array("__m").alias("mean"),
        V.scale(vector_to_array("__v"), shrink).alias("var"),
    )


def standardize(train: DataFrame, apply_to: DataFrame, vector: str, out: str = "z") -> DataFrame:
    """Subtract the training mean and divide by the population sd; a constant dimension stays 0."""
    fitted = moments(train, [], vector).select(F.struct("mean", "var").alias("s")).scalar()
    sd = F.transform(F.col("__s.var"), lambda x: F.when(x > 0, F.sqrt(x)).otherwise(1.0))
    centred = V.subtract(F.col(vector), F.col("__s.mean"))
    z = F.zip_with(centred, sd, lambda x, s: x / s)
    return apply_to.withColumn("__s", fitted).withColumn(out, z).drop("__s")


def dimensions(df: DataFrame, by: Sequence[str], array: str, value: str) -> DataFrame:
    """One row per dimension of an aggregated vector."""
    return df.select(*by, F.posexplode(array).alias("dim", value))


def variance_ratio(df: DataFrame, domain: str, vector: str) -> DataFrame:
    """Between-domain over within-domain variance, summed over dimensions, domains weighing the same."""
    whole = moments(df, [], vector).select("mean").scalar()
    gap = V.subtract(F.col("mean"), F.col("__all"))
    rows = moments(df, [domain], vector).withColumn("__all", whole).select(
        V.dot(gap, gap).alias("b"), V.total(F.col("var")).alias("v")
    )
    out = rows.agg(F.avg("b").alias("between"), F.avg("v").alias("within"))
    return out.withColumn("ratio", F.col("between") / (F.col("within") + 1e-12))


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """Sample covariance as rows ``(i, j, cov)``.

    Each task adds up its own Gram matrix; only those matrices are shuffled.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, n = None, 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                x = np.hstack([x, np.ones((len(x), 1))])
                gram = x.T @ x if gram is None else gram + x.T @ x
                n += len(x)
        if gram is not None:
            i, j = np.indices(gram.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": gram.ravel()})

    sums = df.select(vector).mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    # The appended column of ones is the last index: its row holds the sums, its corner the count.
    size = sums.agg(F.max("i").alias("d")).scalar()
    flat = sums.withColumn("__d", size)
    n = flat.where((F.col("i") == F.col("__d")) & (F.col("j") == F.col("__d"))).select("s").scalar()
    firsts = flat.where((F.col("j") == F.col("__d")) & (F.col("i") < F.col("__d"))).select("i", F.col("s").alias("si"))
    body = flat.where((F.col("i") < F.col("__d")) & (F.col("j") < F.col("__d"))).withColumn("__n", n)
    joined = body.join(firsts, "i").join(
        firsts.select(F.col("i").alias("j"), F.col("si").alias("sj")), "j"
    )
    cov = (F.col("s") - F.col("si") * F.col("sj") / F.col("__n")) / (F.col("__n") - 1)
    return joined.select("i", "j", cov.alias("cov"))


def participation_ratio(df: DataFrame, vector: str) -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squares = trace(C)^2 / sum of squared entries of C."""
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("cov")))
    return covariance(df, vector).agg(
        (trace * trace / F.sum(F.col("cov") * F.col("cov"))).alias("participation_ratio")
    )


def random_pair_cosine(df: DataFrame, key: Sequence[str], vector: str, draws: int, seed: int) -> DataFrame:
    """Mean cosine of every vector with ``draws`` partners drawn by hash."""
    placed = row_numbers(df.select(*key, vector), [], [F.asc(k) for k in key], "idx")
    placed = placed.withColumn("idx", F.col("idx") - 1)
    n = df.agg(F.count(F.lit(1))).scalar()
    pairs = (
        placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("__n", n)
        .withColumn("other", F.pmod(hash_key(seed, "draw", "idx"), F.col("__n")))
    )
    partner = placed.select(F.col("idx").alias("other"), F.col(vector).alias("__o"))
    return pairs.join(partner, "other").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(V.cosine(F.col(vector), F.col("__o"))).alias("mean_cosine")
    )


# Similarity to a reference set


def reference_similarity(
    queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 1, exclude_self: bool = False, **sizes: int
) -> DataFrame:
    """``(key, max_sim, topk_mean)``: cosine to the nearest and to the k nearest references, one row per query row."""
    best = nearest_references(queries, reference, key, vector, k, exclude_self, **sizes)
    sims = F.col("sims")
    return best.select(
        key, F.try_element_at(sims, F.lit(1)).alias("max_sim"),
        (V.total(sims) / F.nullif(F.size(sims), F.lit(0))).alias("topk_mean"),
    )
