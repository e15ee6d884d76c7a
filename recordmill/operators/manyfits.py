"""Many L2 logistic fits at once: every pass over the rows serves all of them.

A fit is a set of weights, a label, a fold left out and a C. Rows carry the weights of all sets and the labels as
arrays. In a pass each task adds up loss, gradient and Hessian of every fit that has not settled; the sums of a
fit are added by one task, which also makes its Newton step. The number of passes does not depend on the number
of fits. The driver sees weights and losses, nothing that grows with the rows.

The objective of a fit is ``sum w loss + |b|^2 / (2 C)`` on vectors standardised by the weighted
mean and population sd of its set; the intercept is free. It is strictly convex, so a gradient of zero marks
the one solution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.functions import vectors as V
from recordmill.operators import metrics

#: Passes of a fit, and the gradient per unit of weight at which it has settled.
MOST_PASSES, SETTLED = 60, 1e-10


@dataclass(frozen=True)
class Fit:
    """Row weights ``w[set]``, labels ``y[label]``, rows of ``fold`` left out (-1: none)."""

    set: int
    label: int
    c: float
    fold: int = -1


@dataclass
class Fitted:
    """A fit's weights on raw vectors, those on standardised ones, and its gradient per unit of weight."""

    fit: Fit
    weights: np.ndarray
    intercept: float
    standard: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    gradient: float

    def score(self, vector: str) -> Column:
        return V.dot(F.col(vector), V.literal(self.weights)) + F.lit(float(self.intercept))


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Vectors with a 1 at the end, weights, labels and folds of each batch."""
    for batch in batches:
        if batch.num_rows:
            x, w, y = (np.array(batch.column(k).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) for k in range(3))
            yield np.hstack([x, np.ones((len(x), 1))]), w, y, batch.column(3).to_numpy(zero_copy_only=False)


def _selected(rows: DataFrame, vector: str, weights: str, labels: str, fold: str | None) -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).select(
        F.col(vector).cast("array<double>"), F.col(weights).cast("array<double>"), F.col(labels).cast("array<double>"),
        (F.lit(-2) if fold is None else F.coalesce(F.col(fold).cast("int"), F.lit(-2))).alias("fold"),
    )


def _sum_by(rows: DataFrame, finish, schema: str, n: int) -> DataFrame:
    """Add up the arrays of every ``id`` batch by batch, then ``finish(id, sum)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(raw.as_buffer(), float)
                sums[i] = sums[i] + part if i in sums else part.copy()
        for i, total in sums.items():
            yield from pa.Table.from_pylist([finish(i, total)]).to_batches()

    parts = min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(max(1, parts), "id").mapInArrow(run, schema)


def _parts(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["id", "sums"])


def set_moments(rows: DataFrame, vector: str, weights: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Total weight, weighted mean and population sd (1 where it is 0) of every set, in one pass."""
    picked = _selected(rows.withColumn("__none", F.array(F.lit(0.0))), vector, weights, "__none", None)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for a, w, _, _ in _blocks(batches):
            part = np.hstack([w.T @ a, w.T @ (a * a)])
            total = part if total is None else total + part
        if total is not None:
            yield _parts(dict(enumerate(total)))

    def finish(i: int, total: np.ndarray) -> dict:
        return {"id": i, "sums": total.tobytes()}

    out = {}
    for r in _sum_by(picked.mapInArrow(partial, "id bigint, sums binary"), finish, "id bigint, sums binary", 64).collect():
        one, two = np.split(np.frombuffer(r.sums, float), 2)
        n = one[-1]
        if n > 0:
            mean = one[:-1] / n
            var = np.maximum(two[:-1] / n - mean**2, 0)
            # a variance that is rounding noise beside the mean is none
            out[r.id] = (n, mean, np.sqrt(np.where(var > 1e-13 * (mean**2 + 1e-300), var, 1.0)))
    return out


def fit_many(
    rows: DataFrame, vector: str, fits: Sequence[Fit], weights: str = "w", labels: str = "y", fold: str | None = None,
    standardize: bool = True, passes: int = MOST_PASSES,
) -> list[Fitted]:
    """All ``fits`` on ``rows``, which should be a written table; rows without a vector take no part.

    Sets without weight give zero weights. Without ``standardize`` the vectors are taken as they are.
    """
    spark = rows.sparkSession
    moments = set_moments(rows, vector, weights)
    if not standardize:
        moments = {s: (n, np.zeros(len(m)), np.ones(len(m))) for s, (n, m, _) in moments.items()}
    picked = _selected(rows, vector, weights, labels, fold)
    width = len(next(iter(moments.values()))[1]) if moments else 0
    none = (0.0, np.zeros(width), np.ones(width))
    zero = np.zeros(width + 1)
    state = [{"beta": zero, "loss": np.inf, "step": None, "base": zero, "length": 1.0, "gradient": np.inf} for _ in fits]
    active = [p for p, f in enumerate(fits) if f.set in moments]
    for _ in range(passes):
        if not active:
            break
        task = []
        for p in active:
            f = fits[p]
            _, mean, sd = moments.get(f.set, none)
            beta = state[p]["beta"]
            raw = beta[:-1] / sd
            task.append((p, f, np.append(raw, beta[-1] - raw @ mean), beta, mean, sd))
        shared = spark.sparkContext.broadcast(task)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            fitting = shared.value
            for a, w, y, folds in _blocks(batches):
                z = a @ np.stack([t[2] for t in fitting]).T
                for k, (p, f, *_) in enumerate(fitting):
                    own = w[:, f.set] * (folds != f.fold)
                    live = own > 0
                    if not live.any():
                        continue
                    b, s, own, t = a[live], z[live, k], own[live], y[live, f.label]
                    # both forms keep their digits for large scores
                    share = 1 / (1 + np.exp(-np.abs(s)))
                    prob = np.where(s >= 0, share, 1 - share)
                    loss = own @ (np.maximum(s, 0) - s * t + np.log1p(np.exp(-np.abs(s))))
                    gradient = b.T @ (own * (prob - t))
                    hessian = b.T @ (b * (own * prob * (1 - prob))[:, None])
                    part = np.concatenate([[loss, own.sum()], gradient, hessian.ravel()])
                    sums[p] = sums[p] + part if p in sums else part
            if sums:
                yield _parts(sums)

        def finish(p: int, total: np.ndarray) -> dict:
            _, f, _, beta, mean, sd = next(t for t in shared.value if t[0] == p)
            d = len(beta)
            loss, n, gradient, hessian = total[0], total[1], total[2 : 2 + d], total[2 + d :].reshape(d, d)
            # from raw to standardised vectors
            change = np.eye(d)
            change[: d - 1, : d - 1] = np.diag(1 / sd)
            change[d - 1, : d - 1] = -mean / sd
            ridge = np.append(np.full(d - 1, 1 / f.c), 0.0)
            gradient = change.T @ gradient + ridge * beta
            hessian = change.T @ hessian @ change + np.diag(ridge + 1e-12 * n)
            step = -np.linalg.solve(hessian, gradient)
            return {"id": p, "loss": float(loss + beta @ (ridge * beta) / 2), "slope": float(gradient @ step), "gradient": float(np.abs(gradient).max() / n), "step": step.tolist()}

        found = picked.mapInArrow(partial, "id bigint, sums binary")
        schema = "id bigint, loss double, slope double, gradient double, step array<double>"
        met = {r.id: r for r in _sum_by(found, finish, schema, len(active)).collect()}
        shared.unpersist()
        left = []
        for p in active:
            s, r = state[p], met.get(p)
            if r is None:  # no row has weight
                s["gradient"] = 0.0
                continue
            if r.loss > s["loss"] + 1e-9 * abs(s["loss"]) and s["length"] > 1e-6:
                s["length"] /= 2
            else:
                s.update(base=s["beta"], loss=r.loss, step=np.array(r.step), length=1.0, gradient=r.gradient)
                if r.gradient < SETTLED:
                    continue
            s["beta"] = s["base"] + s["length"] * s["step"]
            left.append(p)
        active = left
    out = []
    for f, s in zip(fits, state):
        _, mean, sd = moments.get(f.set, none)
        beta = s["base"]
        raw = beta[:-1] / sd
        out.append(Fitted(f, raw, float(beta[-1] - raw @ mean), beta, mean, sd, s["gradient"]))
    return out


def fit_ridge(
    rows: DataFrame, vector: str, fits: Sequence[tuple[int, int, float]], weights: str = "w", labels: str = "y", scale_set: int = 0
) -> list[Fitted]:
    """Ridge fits (set, target, alpha) by their normal equations: ``sum w (z.b + b0 - y)^2 + alpha |b|^2``, all in one pass.

    Vectors are standardised by the moments of ``scale_set``. Spark ML divides its penalty by the deviation of the
    target, so it solves another problem.
    """
    moments = set_moments(rows, vector, weights)
    if scale_set not in moments:
        return []
    _, mean, sd = moments[scale_set]
    d = len(mean) + 1
    picked = _selected(rows, vector, weights, labels, None)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for a, w, y, _ in _blocks(batches):
            z = np.hstack([(a[:, :-1] - mean) / sd, a[:, -1:]])
            for i, (s, target, _) in enumerate(fits):
                part = np.concatenate([(z.T @ (z * w[:, s : s + 1])).ravel(), z.T @ (w[:, s] * y[:, target])])
                sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield _parts(sums)

    def finish(i: int, total: np.ndarray) -> dict:
        left, right = total[: d * d].reshape(d, d), total[d * d :]
        left = left + np.diag(np.append(np.full(d - 1, fits[i][2]), 1e-12))
        return {"id": i, "beta": np.linalg.solve(left, right).tolist()}

    found = {r.id: np.array(r.beta) for r in _sum_by(picked.mapInArrow(partial, "id bigint, sums binary"), finish, "id bigint, beta array<double>", len(fits)).collect()}
    out = []
    for i, (s, target, alpha) in enumerate(fits):
        beta = found.get(i, np.zeros(d))
        raw = beta[:-1] / sd
        out.append(Fitted(Fit(s, target, 1 / alpha if alpha else np.inf), raw, float(beta[-1] - raw @ mean), beta, mean, sd, 0.0))
    return out


def scores_of(rows: DataFrame, vector: str, fitted: Sequence[Fitted], out: str = "scores") -> DataFrame:
    """``rows`` with the decision values of all fits, as one array; null for a null vector."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((np.stack([f.weights for f in fitted]), np.array([f.intercept for f in fitted])))

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        w, b = shared.value
        out = np.empty(len(vectors), object)
        held = np.flatnonzero(vectors.notna())
        if len(held):
            for k, s in zip(held, np.stack(vectors.to_numpy()[held]).astype(float) @ w.T + b):
                out[k] = s
        return pd.Series(out)

    return rows.withColumn(out, run(F.col(vector).cast("array<double>")))


def choose_c(
    rows: DataFrame, vector: str, sets: Sequence[tuple[int, int]], grid: Sequence[float], folds: int,
    weights: str = "w", labels: str = "y", fold: str = "fold",
) -> dict[int, float]:
    """For every (set, label) the C with the best mean AUC over the left-out folds; of equal ones the smallest."""
    fits = [Fit(s, lab, float(c), k) for s, lab in sets for c in grid for k in range(folds)]
    fitted = fit_many(rows, vector, fits, weights, labels, fold)
    scored = scores_of(rows.where(F.col(fold).isNotNull()), vector, fitted)
    cells = F.array(*[F.struct(F.lit(i).alias("fit"), F.lit(f.set).alias("set"), F.lit(f.label).alias("label"), F.lit(f.fold).alias("left")) for i, f in enumerate(fits)])
    long = scored.select(
        F.col(weights).alias("__w"), F.col(labels).alias("__y"), F.col(fold).alias("__f"), F.posexplode("scores").alias("fit", "s")
    ).withColumn("__cell", F.element_at(cells, F.col("fit") + 1)).where(F.col("__cell.left") == F.col("__f"))
    long = long.select("fit", "s", F.element_at("__w", F.col("__cell.set") + 1).alias("w"), F.element_at("__y", F.col("__cell.label") + 1).cast("int").alias("label"))
    counts = long.where("w > 0").groupBy("fit", F.col("s").alias("score")).agg(
        F.sum(F.col("w") * F.col("label")).alias("p"), F.sum(F.col("w") * (1 - F.col("label"))).alias("n")
    )
    auc = {r.fit: r.auc for r in metrics.auc_from_counts(counts, ["fit"]).select("fit", "auc").collect()}
    best = {}
    for s, lab in sets:
        means = []
        for c in sorted(float(c) for c in grid):
            found = [auc.get(i) for i, f in enumerate(fits) if (f.set, f.label, f.c) == (s, lab, c)]
            found = [a for a in found if a is not None]
            means.append((round(sum(found) / len(found), 9) if found else 0.0, -c))
        best[s] = -max(means)[1]
    return best


def fit_chosen(
    rows: DataFrame, vector: str, sets: Sequence[tuple[int, int]], grid: Sequence[float], folds: int,
    weights: str = "w", labels: str = "y", fold: str = "fold",
) -> list[Fitted]:
    """One fit for every (set, label) on all its rows, with the C that cross-validation chooses."""
    best = choose_c(rows, vector, sets, grid, folds, weights, labels, fold) if len(grid) > 1 else {s: float(grid[0]) for s, _ in sets}
    return fit_many(rows, vector, [Fit(s, lab, best[s]) for s, lab in sets], weights, labels, None)


def evidence(rows: DataFrame, vector: str, fitted: Sequence[Fitted], weights: str = "w", labels: str = "y") -> DataFrame:
    """What optimality says about the data: ``(fit, dim, value)`` with ``value = sum w p z + b / C``.

    At the optimum, and only there, this equals ``sum w y z`` for every dimension of the standardised vectors ``z``, and
    for the intercept (dimension -1) ``sum w p`` equals ``sum w y``.
    """
    picked = _selected(rows, vector, weights, labels, None)
    shared = rows.sparkSession.sparkContext.broadcast(list(enumerate(fitted)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for a, w, _, _ in _blocks(batches):
            for i, f in shared.value:
                z = np.hstack([(a[:, :-1] - f.mean) / f.sd, a[:, -1:]])
                s = z @ f.standard
                part = z.T @ (w[:, f.fit.set] / (1 + np.exp(-s)))
                sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield _parts(sums)

    def finish(i: int, total: np.ndarray) -> dict:
        f = fitted[i]
        return {"id": i, "value": (total + np.append(f.standard[:-1] / f.fit.c, 0.0)).tolist()}

    found = _sum_by(picked.mapInArrow(partial, "id bigint, sums binary"), finish, "id bigint, value array<double>", len(fitted))
    rows = found.select(F.col("id").cast("int").alias("fit"), F.posexplode("value").alias("dim", "value"))
    d = len(fitted[0].standard) - 1
    return rows.withColumn("dim", F.when(F.col("dim") == d, -1).otherwise(F.col("dim")))
