from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordmill.functions import dates, text
from recordmill.operators import gates, joins, probes, protocols, resample, splits, timeline, vectors
from recordmill.session import new_path
from recordmill.sources import delimited, versions


def column(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_partial_dates(spark):
    raw = ["05-Mar-2013", "Mar-2013", "2013-03-05", "2013/03/05", "2013-03", "2013", "2013/2014", "", None, "n/a", " 2013 ", "05-Foo-2013", "2013-13-45", "2013-02-30"]
    got = [tuple(x) for x in column(spark, raw, dates.parse_partial_date)]
    assert got == [
        (2013, 3, 5, "day"), (2013, 3, None, "month"), (2013, 3, 5, "day"), (2013, 3, 5, "day"), (2013, 3, None, "month"),
        (2013, None, None, "year"), (None, None, None, "none"), (None, None, None, "none"), (None, None, None, "none"),
        (None, None, None, "none"), (2013, None, None, "year"), (2013, None, 5, "year"),
        (None, None, None, "none"), (None, None, None, "none"),
    ]


def test_keyword_rules(spark):
    rules = [("animal", ["pig", "duck"]), ("tool", ["wrench"])]
    raw = ["a pigeon", "Pigs fly", "DUCK", "épig", "wrench and pig", "none", None]
    assert column(spark, raw, lambda c: text.keyword_class(c, rules)) == [
        None, "animal", "animal", "animal", "animal", None, None
    ]
    assert column(spark, ["pigs", "pig"], lambda c: text.keyword_class(c, rules, plural=False)) == [None, "animal"]


def test_intervals(spark):
    days = [-400, -1, 0, 365, 366, 1095, 1096, 1826, 1827, None]
    signed = column(spark, days, lambda c: dates.interval_bin(c, True), "x int")
    assert signed == ["negative", "negative", "<1yr", "<1yr", "1-3yr", "1-3yr", "3-5yr", "3-5yr", "5yr+", None]
    assert column(spark, [364, 365, 1094, 1095], lambda c: dates.digitize(c, [365, 1095]), "x int") == [0, 1, 1, 2]


def test_group_labels_edge_cases(spark):
    rows = [
        ("d", 1, "t", "2000-01-01"), ("d", 1, "o", "2001-03-01"), ("e", 1, "t", "2000-01-01"), ("d", 2, "t", None),
        ("d", 3, "unknown", "2000-01-01"), ("d", 3, "t", "2001-01-01"), ("d", 4, "a", "2000-01-01"), ("d", 4, "b", "2000-01-01"), ("d", 4, "t", "1999-01-01"),
    ]
    m = spark.createDataFrame(rows, "d string, g int, c string, ym string").withColumn("ym", F.to_date("ym"))
    first = timeline.first_seen(m, ["d", "g"], "c", "ym")
    got = {(r.d, r.g): (r.multi_category, r.target_plus_other, r.signed_days, r.source_category) for r in timeline.group_intervals(first, ["d", "g"], "c", "t").collect()}
    assert got == {
        ("d", 1): (1, 1, -425, "o"), ("e", 1): (0, 0, None, None), ("d", 3): (0, 0, None, None), ("d", 4): (1, 1, -365, "a"),
    }
    sizes = {(r.d, r.g): r.group_size for r in timeline.group_size(m, ["d", "g"]).collect()}
    assert sizes["d", 2] == 1
    at = {(r.g, r.cutoff): r.multi_category for r in timeline.labels_as_of(first.where("d = 'd'"), ["d", "g"], "c", "t", {2000: "2000-12-31"}).collect()}
    assert at[1, 2000] == 0 and at[4, 2000] == 1


def test_join_gate(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, w double")
    with pytest.raises(ValueError):
        joins.join_validated(a, b, ["k"])
    r = joins.drop_report(a, b, ["k"]).first()
    assert (r.n_kept, r.n_dropped) == (1, 2)
    with pytest.raises(ValueError):
        gates.require_same_keys(a, b, ["k"])
    table = spark.createDataFrame([("auc", 0.7)], "metric string, value double")
    gates.require_band(table, "auc", 0.6, 0.8)
    with pytest.raises(ValueError):
        gates.require_band(table, "auc", 0.8, 0.9)
    bands = {(r.metric, r.inside) for r in gates.in_band(table, {"auc": (0.6, 0.8), "none": (0, 1)}).collect()}
    assert ("auc", True) in bands and ("none", False) in bands


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 90, 900))
    pdf = pd.DataFrame({"domain": np.where(g % 2 == 0, "a", "b"), "g": g, "k": np.arange(900), "y": (g % 3 == 0).astype(int), "cls": g % 3})
    return spark.createDataFrame(pdf)


def test_splits(records):
    out = splits.split_stratified(records, "domain", "y", ["k"], ["b"])
    assert out.count() == records.count() == out.select("k").distinct().count()
    again = splits.split_stratified(records, "domain", "y", ["k"], ["b"])
    assert out.exceptAll(again).count() == 0
    grouped = splits.split_grouped(records, ["domain", "g"], ["domain", "y"], [1, 2])
    assert splits.leaking_groups(grouped, ["seed", "domain", "g"]).count() == 0
    assert grouped.count() == 2 * records.count()
    folds = splits.kfold_grouped(records, ["domain", "g"], 5)
    assert folds.select("fold").distinct().count() == 5
    shuffled = splits.shuffle_values(records, ["domain"], ["k"], "y", 3, "s").toPandas()
    assert (shuffled.groupby("domain").y.sum() == shuffled.groupby("domain").s.sum()).all() and (shuffled.y != shuffled.s).any()


def test_single_row_stratum(spark):
    df = spark.createDataFrame([("a", 1, 1)], "domain string, y int, k int")
    assert splits.split_stratified(df, "domain", "y", ["k"], []).first().split == "train"


def test_balanced_search(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 300, 3000)
    df = spark.createDataFrame(pd.DataFrame({"domain": np.where(g % 2 == 0, "a", "b"), "g": g, "cls": rng.integers(0, 3, 3000)}))
    chosen, dev = splits.balanced_search(df, ["domain", "g"], "domain", "cls", [0, 1, 2], {"train": 0.6, "val": 0.2, "test": 0.2}, [3, 3, 3], 64)
    assert chosen.count() == df.select("domain", "g").distinct().count() and dev < 2
    share = df.join(chosen, ["domain", "g"]).groupBy("split").count().toPandas().set_index("split")["count"] / df.count()
    assert set(share.index) == {"train", "val", "test"}


def test_draws(records):
    units = records.select("domain", "g").distinct()
    w = resample.draw_weights(units, ["domain"], ["g"], 7, 5)
    sizes = {r.domain: r["count"] for r in units.groupBy("domain").count().collect()}
    for r in w.groupBy("domain", "b").agg(F.sum("w").alias("n")).collect():
        assert r.n == sizes[r.domain]
    again = resample.draw_weights(units, ["domain"], ["g"], 7, 5)
    assert w.exceptAll(again).count() == 0


def test_bootstrap_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.7, 1)], "g int, s double, y int")
    assert resample.bootstrap_auc(df, [], ["g"], "s", "y", 5, 1).count() == 0


def test_permutation_without_cells(spark):
    df = spark.createDataFrame([(i, float(i), int(i > 5)) for i in range(10)], "g int, s double, y int")
    r = resample.permutation_auc(df, [], ["g"], "s", "y", 20, 1).first()
    assert r.auc == 1.0 and r.n_perm == 20 and r.p_value >= 1 / 21


@pytest.mark.parametrize("block_rows", [4096, 16])
@pytest.mark.parametrize("noself", [False, True])
def test_reference_similarity(spark, block_rows, noself):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 6))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "v": list(x)}), "id long, v array<double>")
    got = vectors.reference_similarity(df, df.where("id < 50"), "id", "v", 3, noself, shared_rows=block_rows, block_rows=16, slice_rows=40).toPandas().sort_values("id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u[:50].T
    if noself:
        sims[np.arange(50), np.arange(50)] = -np.inf
    best = -np.sort(-sims, axis=1)[:, :3]
    assert np.allclose(got.max_sim, best[:, 0]) and np.allclose(got.topk_mean, best.mean(1))


def test_probe_separates(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4)) + y[:, None] * [1.5, 0, 0, -1]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "y": y, "v": list(x)}), "id long, y int, v array<double>")
    p = probes.fit_probe(df, "v", "y", ["id"], grid=[0.1, 1.0])
    scored = df.select("y", p.score("v").alias("s")).toPandas()
    assert scored[scored.y == 1].s.mean() > scored[scored.y == 0].s.mean() + 1


def test_selection_ties(spark):
    rows = [("c", "val", "b", 0.7), ("c", "val", "a", 0.7), ("c", "val", "z", 0.6), ("c", "test", "a", 0.5), ("c", "test", "b", 0.9)]
    df = spark.createDataFrame(rows, "cell string, split string, candidate string, auc double")
    r = protocols.select_then_test(df, ["cell"]).first()
    assert (r.selected, r.val_value, r.test_value) == ("a", 0.7, 0.5)


def test_upsert_and_improve(spark):
    stored = spark.createDataFrame([(1, "unknown"), (2, "x"), (3, "unknown")], "k int, c string")
    new = spark.createDataFrame([(1, "y"), (2, "z"), (3, "unknown"), (4, "unknown")], "k int, c string")
    got = {r.k: (r.c, r.action) for r in joins.upsert_fill_missing(stored, new, ["k"], "c").collect()}
    assert got == {1: ("y", "replace"), 2: ("x", "keep"), 3: ("unknown", "keep"), 4: ("unknown", "insert")}


def test_append_resumes_and_versions(spark):
    path = new_path(spark, "append")
    df = spark.range(100).select(F.col("id").alias("k"))
    assert versions.append_pending(df.where("k < 40"), path, ["k"], 3) == 40
    assert versions.append_pending(df, path, ["k"], 3) == 60
    assert versions.append_pending(df, path, ["k"], 3) == 0
    got = versions.read(spark, path)
    assert got.distinct().count() == got.count() == 100
    base = new_path(spark, "versions")
    assert versions.rewrite(df, base) == 0 and versions.rewrite(df.where("k < 3"), base) == 1
    assert versions.update(base, spark, lambda last: last.where("k > 0")) == 2
    assert [versions.read(spark, base, n).count() for n in (0, 1, 2)] == [100, 3, 2] and versions.history(spark, base) == [0, 1, 2]


def test_two_writers_and_a_broken_one(spark):
    base, table = new_path(spark, "versions"), new_path(spark, "append")
    df = spark.range(200).select(F.col("id").alias("k"))
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: versions.rewrite(df.where(F.col("k") < n), base), [10, 20, 30, 40]))
        appended = list(pool.map(lambda n: versions.append_pending(df.where(F.col("k") < n), table, ["k"], 2), [100, 150, 200]))
    assert sorted(numbers) == [0, 1, 2, 3] == versions.history(spark, base)
    assert {n: versions.read(spark, base, v).count() for n, v in zip([10, 20, 30, 40], numbers)} == {n: n for n in (10, 20, 30, 40)}
    got = versions.read(spark, table)
    assert sum(appended) == 200 == got.count() == got.distinct().count()
    before = versions.history(spark, table)
    bad = df.withColumn("k", F.when(F.col("k") < 250, F.col("k") + 300).otherwise(0) / F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        versions.append_pending(bad.select(F.col("k").cast("long")), table, ["k"])
    assert versions.history(spark, table) == before and versions.read(spark, table).count() == 200


def test_listing_group_over_many_blocks(spark):
    rows = [(g, i, i * 3, f"{g}_{i}", i == 2) for g in ("1", "22") for i in range(60)]
    df = spark.createDataFrame(rows, "group string, pos long, size long, member string, is_representative boolean")
    path = new_path(spark, "listing")
    delimited.write_listing(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {tuple(r) for r in delimited.read_listing(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(m, g, s, r) for g, _, s, m, r in rows}


def test_records_with_leading_marks(spark):
    df = spark.createDataFrame([(1, "ab\n>cd\n ef"), (2, "")], "id int, text string")
    path = new_path(spark, "records")
    delimited.write_records(df, path, "id", F.lit("t"), F.col("text"))
    assert {(r.id, r.body) for r in delimited.read_records(spark, path).collect()} == {("1", "ab>cdef"), ("2", "")}


def test_training_sets_of_all_domains(spark):
    from recordmill.plans.fits import training_sets

    sets = [tuple(c) for c in training_sets(spark.createDataFrame([(d,) for d in (3, 0, 4, 1, 2, 2)], "domain long"))]
    assert len(sets) == len(set(sets)) == 25 and {(3,), (4,), (3, 4), (2, 3, 4)} <= set(sets)
