"""Linear models on vectors: probes, regressions, classes, erasure.

Penalties follow the usual C of L2 logistic regression and alpha of ridge regression. Only fitted weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions import vectors as V
from recordmill.functions.nullsafe import attach
from recordmill.operators import manyfits, vectors
from recordmill.operators.splits import kfold_grouped, kfold_stratified
from recordmill.session import materialize


@dataclass
class Probe:
    """Fitted standardiser and linear weights; ``score`` is a plain column expression."""

    mean: list[float]
    sd: list[float]
    weights: list[float]
    intercept: float
    c: float

    def score(self, vector: str) -> Column:
        # w . (x - mean) / sd + b, folded into one dot product.
        w = np.array(self.weights) / np.array(self.sd)
        b = self.intercept - float(w @ np.array(self.mean))
        return V.dot(F.col(vector), V.literal(w)) + b


def fit_standardizer(train: DataFrame, vector: str) -> tuple[list[float], list[float], int]:
    row = vectors.moments(train, [], vector).first()
    sd = [v**0.5 if v > 0 else 1.0 for v in row["var"]]
    return list(row["mean"]), sd, row["n"]


def _features(df: DataFrame, vector: str, mean, sd) -> Column:
    centred = V.subtract(F.col(vector), V.literal(mean))
    return array_to_vector(F.zip_with(centred, V.literal(sd), lambda x, s: x / s))


def probe_of(fitted: manyfits.Fitted) -> Probe:
    beta = fitted.standard.tolist()
    return Probe(fitted.mean.tolist(), fitted.sd.tolist(), beta[:-1], beta[-1], fitted.fit.c)


def fit_probe(
    train: DataFrame, vector: str, label: str, key: Sequence[str], grid: Sequence[float] = (0.01, 0.1, 1.0),
    folds: int = 3, seed: int = 42, group: Sequence[str] | None = None, weight: str | None = None,
) -> Probe:
    """L2 logistic probe; C is chosen by the mean AUC over stratified or grouped folds, all fits of which share their passes."""
    cols = [*key, label, *([weight] if weight else []), *[g for g in (group or []) if g not in key]]
    data = train.select(*cols, vector)
    if len(grid) == 1:
        data = data.withColumn("fold", F.lit(0))
    elif group:
        data = attach(data, kfold_grouped(data, group, folds).drop("group_size"), list(group))
    else:
        data = kfold_stratified(data, [label], key, folds, seed)
    w = F.array(F.col(weight).cast("double") if weight else F.lit(1.0))
    rows = materialize(data.select(F.col(vector).alias("x"), "fold", F.array(label).alias("y"), w.alias("w")), "fit-rows")
    return probe_of(manyfits.fit_chosen(rows, "x", [(0, 0)], grid, folds)[0])


def fit_multiclass(
    train: DataFrame, vector: str, label: str, c: float = 1.0, elastic_net: float = 0.5, weight: str | None = None
):
    """Multinomial elastic-net logistic regression; returns a function adding ``predicted``."""
    mean, sd, n = fit_standardizer(train, vector)
    lr = LogisticRegression(
        featuresCol="__x", labelCol=label, family="multinomial", regParam=1.0 / (c * n),
        elasticNetParam=elastic_net, standardization=False, maxIter=500, tol=1e-10,
        **({"weightCol": weight} if weight else {}),
    )
    model = lr.fit(train.withColumn("__x", _features(train, vector, mean, sd)))
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def predict(df: DataFrame) -> DataFrame:
        """Adds ``predicted`` and ``probabilities``, by linear expressions of the fitted weights."""
        x = vector_to_array("__x")
        scores = F.array(*[V.dot(x, V.literal(w)) + float(b) for w, b in zip(weights, intercepts)])
        out = df.withColumn("__x", _features(df, vector, mean, sd)).withColumn("__s", scores).drop("__x")
        powers = F.transform("__s", lambda s: F.exp(s - F.array_max("__s")))
        out = out.withColumn("probabilities", V.scale(powers, 1 / V.total(powers)))
        return out.withColumn("predicted", (F.array_position("__s", F.array_max("__s")) - 1).cast("int")).drop("__s")

    predict.weights, predict.mean, predict.sd, predict.n = weights, mean, sd, n
    return predict


def fit_regression(train: DataFrame, vector: str, target: str, form: str, alpha: float = 1.0):
    """Ridge regression of a non-negative target as it is, as log1p, or as a hurdle product.

    Returns a function that adds predictions; its ``model`` is the linear part. The hurdle's linear part is fitted on positive
    targets, its chance on all rows; both see vectors standardised on all rows.
    """
    if form not in ("raw", "log1p", "hurdle"):
        raise ValueError(form)
    y = F.col(target).cast("double")
    positive = (y > 0).cast("double")
    rows = train.where(y.isNotNull()).select(
        F.col(vector).alias("x"), F.array(y, F.log1p(y), positive).alias("y"), F.array(F.lit(1.0), positive).alias("w")
    )
    rows = materialize(rows, "fit-rows")
    where, what = {"raw": (0, 0), "log1p": (0, 1), "hurdle": (1, 1)}[form]
    model = manyfits.fit_ridge(rows, "x", [(where, what, alpha)])[0]
    chance = manyfits.fit_many(rows, "x", [manyfits.Fit(0, 2, 1.0)])[0] if form == "hurdle" else None

    def predict(df: DataFrame, out: str = "predicted") -> DataFrame:
        p = model.score(vector)
        if form != "raw":
            p = F.expm1(p)
        if chance is not None:
            p = p / (1 + F.exp(-chance.score(vector)))
        return df.withColumn(out, p if form == "raw" else F.greatest(p, F.lit(0.0)))

    predict.model = model
    return predict


def erase_label(
    df: DataFrame, vector: str, label: str, rounds: int, c: float = 1.0, fit_on: Column | None = None
) -> tuple[list[DataFrame], list[manyfits.Fitted]]:
    """Iteratively fit the nuisance label and project its direction out.

    Returns the table after 0, 1, ... rounds and the fits. Rows that meet ``fit_on`` (default: all)
    are fitted; every row is projected. A fit's weights are a sum of vectors, so its direction is
    orthogonal to those erased before.
    """
    weight = F.lit(1.0) if fit_on is None else F.coalesce(fit_on, F.lit(False)).cast("double")
    df = df.withColumns({"__w": F.array(weight), "__y": F.array(label)})
    states, fits = [df], []
    for _ in range(rounds):
        fitted = manyfits.fit_many(df, vector, [manyfits.Fit(0, 0, c)], "__w", "__y", standardize=False)[0]
        u = fitted.weights / (np.linalg.norm(fitted.weights) + 1e-12)
        fits.append(fitted)
        # Each round is written, so that the plan does not grow with the number of rounds.
        df = materialize(df.withColumn(vector, V.erase(F.col(vector), V.literal(u))), "erased")
        states.append(df)
    return [s.drop("__w", "__y") for s in states], fits


def axis_shares(axes: Sequence[Sequence[float]], w: Sequence[float]) -> list[float]:
    """Energy of a unit weight vector along orthogonalised axes, and the rest.

    The axes are centroid differences: a handful of vectors, so this is plain linear algebra.
    """
    q, _ = np.linalg.qr(np.array(axes, float).T)
    u = np.array(w, float)
    u = u / np.linalg.norm(u)
    shares = (q.T @ u) ** 2
    return [*map(float, shares), float(max(0.0, 1.0 - shares.sum()))]
