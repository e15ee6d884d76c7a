from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordmill.operators import calibrate, metrics


def brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    d = pos[:, None] - neg[None, :]
    return float(((d > 0) + 0.5 * (d == 0)).mean())


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    frames = {
        "tied": ([1.0] * 6, [0, 1, 0, 1, 1, 0]), "one_class": ([1.0, 2.0], [1, 1]),
        "perfect": ([1.0, 2.0, 3.0, 4.0], [0, 0, 1, 1]), "inverted": ([4.0, 3.0, 2.0, 1.0], [0, 0, 1, 1]),
    }
    for i in range(6):
        frames[f"random{i}"] = (rng.integers(0, 8, 40).astype(float).tolist(), rng.integers(0, 2, 40).tolist())
    pdf = pd.DataFrame([(c, s, y) for c, (ss, ys) in frames.items() for s, y in zip(ss, ys)], columns=["c", "s", "y"])
    return pdf, spark.createDataFrame(pdf)


def test_auc_by_cell(cells):
    pdf, df = cells
    got = {r.c: r.auc for r in metrics.auc(df, ["c"], "s", "y").collect()}
    for c, g in pdf.groupby("c"):
        want = brute_auc(g.s.to_numpy(), g.y.to_numpy())
        assert got[c] == pytest.approx(want) if want is not None else got[c] is None


def test_flipped_auc_sums_to_one(cells):
    _, df = cells
    a = metrics.auc(df, ["c"], "s", "y").select("c", "auc")
    b = metrics.auc(df.withColumn("s", -F.col("s")), ["c"], "s", "y").select("c", F.col("auc").alias("neg"))
    for r in a.join(b, "c").where("auc is not null").collect():
        assert r.auc + r.neg == pytest.approx(1)


def test_null_scores_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1), (1.0, 1), (0.0, 0)], "s double, y int")
    assert metrics.auc(df, [], "s", "y").first().auc == 1.0
    assert metrics.auc(df.where("y > 5"), ["y"], "s", "y").collect() == []


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "s double, y int")
    # recall 1/2 at precision 1, recall 1 at precision 2/4
    assert metrics.average_precision(df, [], "s", "y").first().average_precision == pytest.approx(0.75)


def test_kendall_and_spearman(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 12, 150), "y": rng.integers(0, 9, 150)})
    df = spark.createDataFrame(pdf)
    sx, sy = [np.sign(pdf[c].to_numpy()[:, None] - pdf[c].to_numpy()[None, :]) for c in "xy"]
    tau = (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())
    assert metrics.kendall_tau(df, [], "x", "y").first().tau_b == pytest.approx(tau)
    rho = np.corrcoef(pdf.x.rank(), pdf.y.rank())[0, 1]
    assert metrics.spearman(df, [], "x", "y").first().spearman == pytest.approx(rho)


def test_sign_and_fisher_tests(spark):
    df = spark.createDataFrame([(3, 31), (0, 5), (15, 30), (480, 1000)], "k long, n long")
    for r in df.withColumn("p", metrics.sign_test_p(F.col("k"), F.col("n"))).collect():
        want = min(1.0, 2 * sum(comb(r.n, i) for i in range(min(r.k, r.n - r.k) + 1)) / 2**r.n)
        assert r.p == pytest.approx(want, rel=1e-9)
    tables = spark.createDataFrame([(3, 1, 1, 3), (0, 7, 9, 2), (10, 10, 10, 10), (1, 0, 0, 1)], "a long, b long, c long, d long")
    cols = [F.col(x) for x in "abcd"]
    for r in tables.withColumn("p", metrics.fisher_p(*cols)).collect():
        row, col, n = r.a + r.b, r.a + r.c, r.a + r.b + r.c + r.d
        w = {k: comb(row, k) * comb(n - row, col - k) / comb(n, col) for k in range(max(0, row + col - n), min(row, col) + 1)}
        assert r.p == pytest.approx(sum(x for x in w.values() if x <= w[r.a] * (1 + 1e-7)), rel=1e-9)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "k long, p double")
    got = [r.q for r in metrics.bh_adjust(df, [], "p", ["k"]).orderBy("k").collect()]
    assert got == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.9])


def test_confusion_counts_by_hand(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4, "p int, y int")
    r = metrics.binary_metrics(df, [], F.col("p") == 1, "y").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 2, 4)
    assert r.mcc == pytest.approx((12 - 2) / np.sqrt(4 * 5 * 5 * 6))
    # class 2 is only predicted: it counts for macro F1, not for balanced accuracy
    m = spark.createDataFrame([(0, 0), (1, 2), (1, 1), (0, 0)], "y int, q int")
    r = metrics.multiclass_metrics(m, [], "y", "q").first()
    assert (r.accuracy, r.balanced_accuracy) == (0.75, 0.75)
    assert r.macro_f1 == pytest.approx((1 + 2 / 3 + 0) / 3)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (2 / 15, 1), (0.5, 0)], "p double, y int")
    bins = {r.bin: r for r in calibrate.reliability_bins(df, [], F.col("p"), F.col("y")).collect()}
    assert len(bins) == 15 and bins[14].n == 1 and bins[2].n == 1 and bins[5].n == 0 and bins[5].mean_conf is None
    ece = calibrate.ece_from_bins(calibrate.reliability_bins(df, [], F.col("p"), F.col("y")), []).first().ece
    assert ece == pytest.approx((0 + 0 + 13 / 15 + 0.5) / 4)
    assert np.isfinite(calibrate.nll_brier(df, [], F.col("p"), F.col("y")).first().nll)


def test_temperature_recovers_scale(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"z": z * 3, "y": y}))
    assert calibrate.fit_temperature(df, [], "z", "y").first().temperature == pytest.approx(3, rel=0.1)
