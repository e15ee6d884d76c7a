"""Many fits in one pass against plain numpy, and replicates by arrays and by selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.functions.hashing import hash_key
from recordmill.operators import manyfits, resample
from recordmill.operators.manyfits import Fit
from recordmill.session import materialize


def sample(n=400, d=5, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 1, 0][:d] + y[:, None] * [1, 5, 0, -1, 0][:d] + 3
    w = np.stack([np.ones(n), rng.poisson(1, n), (np.arange(n) % 3 > 0).astype(float), np.zeros(n)], axis=1)
    fold = np.arange(n) % 3
    return x, np.stack([y, rng.permutation(y)], axis=1), w, fold


@pytest.fixture(scope="module")
def rows(spark):
    x, y, w, fold = sample()
    data = [(a.tolist(), b.tolist(), c.tolist(), int(f)) for a, b, c, f in zip(x, y, w, fold)] + [(None, [1, 0], [1.0] * 4, 0)]
    return materialize(spark.createDataFrame(data, "x array<double>, y array<int>, w array<double>, fold int").repartition(5), "rows")


def newton(x, y, w, c, mean, sd):
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    ridge = np.append(np.full(x.shape[1], 1 / c), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) + ridge * b
        b = b - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), g)
    return b


def test_every_fit_is_the_optimum(rows):
    x, y, w, fold = sample()
    fits = [Fit(s, k, c, f) for s in range(4) for k in range(2) for c in (0.01, 1.0, 100.0) for f in (-1, 1)]
    got = manyfits.fit_many(rows, "x", fits, fold="fold")
    for f, g in zip(fits, got):
        own = w[:, f.set] * (fold != f.fold)
        if not w[:, f.set].any():
            assert not g.weights.any()
            continue
        mean = (w[:, f.set] @ x) / w[:, f.set].sum()
        sd = np.sqrt((w[:, f.set] @ (x - mean) ** 2) / w[:, f.set].sum())
        sd = np.where(sd > 1e-9, sd, 1)
        assert np.allclose(g.sd, sd) and g.gradient < 1e-8
        assert np.allclose(g.standard, newton(x, y[:, f.label], own, f.c, mean, sd), atol=1e-5)
        assert np.allclose(x @ g.weights + g.intercept, (x - g.mean) / g.sd @ g.standard[:-1] + g.standard[-1])


def test_separable_and_one_class(spark):
    data = [([float(i), 1.0], [int(i > 20), 0, 1], [1.0], i % 2) for i in range(40)]
    rows = spark.createDataFrame(data, "x array<double>, y array<int>, w array<double>, fold int")
    for g in manyfits.fit_many(rows, "x", [Fit(0, 0, 1e6), Fit(0, 1, 1.0), Fit(0, 2, 1.0)]):
        assert np.isfinite(g.weights).all() and np.isfinite(g.intercept)
    assert manyfits.fit_many(rows.limit(0), "x", [Fit(0, 0, 1.0)])[0].weights.size == 0


def test_evidence_needs_no_fit(rows):
    x, y, w, _ = sample()
    fitted = manyfits.fit_many(rows, "x", [Fit(1, 0, 0.1), Fit(2, 1, 1.0)])
    got = {(r.fit, r.dim): r.value for r in manyfits.evidence(rows, "x", fitted).collect()}
    for i, f in enumerate(fitted):
        own, t = w[:, f.fit.set], y[:, f.fit.label]
        assert abs(got[i, -1] - own @ t) < 1e-4
        assert np.allclose([got[i, j] for j in range(5)], ((x - f.mean) / f.sd).T @ (own * t), atol=1e-4)


def test_c_by_cross_validation(rows):
    best = manyfits.choose_c(rows, "x", [(0, 0), (1, 1)], (0.001, 1.0), 3)
    x, y, w, fold = sample()
    for (s, k), c in zip([(0, 0), (1, 1)], (best[0], best[1])):
        means = {}
        for value in (0.001, 1.0):
            fitted = manyfits.fit_many(rows, "x", [Fit(s, k, value, f) for f in range(3)], fold="fold")
            aucs = []
            for f, g in enumerate(fitted):
                held = (fold == f) & (w[:, s] > 0)
                sc, t, ww = x[held] @ g.weights + g.intercept, y[held, k], w[held, s]
                won = ((sc[:, None] > sc[None, :]) + 0.5 * (sc[:, None] == sc[None, :])) * (ww * t)[:, None] * (ww * (1 - t))[None, :]
                aucs.append(won.sum() / ((ww * t).sum() * (ww * (1 - t)).sum()))
            means[value] = round(float(np.mean(aucs)), 9)
        assert c == max(means, key=lambda v: (means[v], -v))


def test_ridge_by_normal_equations(rows):
    x, y, w, _ = sample()
    for s, alpha in ((0, 1.0), (1, 10.0)):
        g = manyfits.fit_ridge(rows, "x", [(s, 0, alpha)])[0]
        z = np.hstack([(x - g.mean) / g.sd, np.ones((len(x), 1))])
        own = w[:, s]
        want = np.linalg.solve(z.T @ (z * own[:, None]) + np.diag([alpha] * 5 + [1e-12]), z.T @ (own * y[:, 0]))
        assert np.allclose(g.standard, want)


# Replicates


def units(spark):
    rng = np.random.default_rng(4)
    data = [(c, i, float(s), int(s + rng.normal() > 1)) for c, n in (("a", 60), ("b", 7), (None, 20), ("one", 1)) for i in range(n) for s in [rng.integers(0, 9)]]
    return spark.createDataFrame(data, "cell string, g int, s double, y int").repartition(4)


def test_weight_arrays_are_the_draws(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_CELLS", 40)
    df = units(spark)
    for cells in (["cell"], []):
        base = df if cells else df.where("cell = 'a'")
        arrays = resample.weight_arrays(base.select("cell", "g"), cells, ["cell", "g"], 9, 5).collect()
        got = {(r.cell, r.g, b): w for r in arrays for b, w in enumerate(r.ws) if w}
        want = {(r.cell, r.g, r.b): r.w for r in resample.draw_weights(base.select("cell", "g"), cells, ["cell", "g"], 9, 5).collect()}
        assert got == want


@pytest.mark.parametrize("held", [1, 1 << 26])
def test_bootstrap_auc_against_weights(spark, monkeypatch, held):
    monkeypatch.setattr(resample, "HELD_BYTES", held)
    df = materialize(units(spark).unionByName(units(spark).withColumn("s", F.col("s") + 1)), "members")
    weights = {}
    for r in resample.draw_weights(df.select("cell", "g").distinct(), ["cell"], ["g"], 6, 3).collect():
        weights[r.cell, r.g, r.b] = r.w
    rows = df.collect()
    want = {}
    for cell in {r.cell for r in rows}:
        for b in range(6):
            own = [(r.s, r.y, weights.get((cell, r.g, b), 0)) for r in rows if r.cell == cell]
            p, n = sum(w for _, y, w in own if y), sum(w for _, y, w in own if not y)
            if p and n:
                won = sum(w * v * ((s > t) + 0.5 * (s == t)) for s, y, w in own if y for t, z, v in own if not z)
                want[cell, b] = won / (p * n)
    got = {(r.cell, r.b): r.auc for r in resample.bootstrap_auc(df, ["cell"], ["g"], "s", "y", 6, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("share", [64, 1])
def test_selection_is_the_hash_order(spark, share):
    n, take, reps = 1500, 400, 5
    df = spark.range(n).select(F.col("id").alias("g"), (F.col("id") % 97).cast("double").alias("v"), F.lit("c").alias("cell"), F.lit(n * 64 // share).alias("n"), F.lit(take).alias("k"))
    hashed = df.select("g", "v", *[hash_key(8, F.lit(b), "g").alias(f"h{b}") for b in range(reps)]).toPandas()
    for cells in (["cell"], []):
        got = {r.b: r.chosen for r in resample.selected_sums(df, cells, ["g"], "v", "n", "k", reps, 8).collect()}
        assert got == {b: hashed.sort_values([f"h{b}", "g"]).v.head(take).sum() for b in range(reps)}
