"""Faults that only larger inputs showed, each at a size at which it can be told."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recordmill.operators import grouping, matching, nearest, ordering, resample, splits
from recordmill.plans import resampling
from recordmill.plans.registry import Tables
from recordmill.session import discard, materialize, materialize_only, shared_dir


def folders(spark):
    return {p.name for p in Path(shared_dir(spark)).glob("*")}


def test_tables_written_on_the_way_are_deleted(spark):
    before = folders(spark)

    def build():
        inner = materialize_only(spark, lambda: materialize(spark.range(3), "deep").where("id > 0"), "inner")
        return materialize(inner.where("id > 1"), "way")

    kept = materialize_only(spark, build, "kept")
    assert [r.id for r in kept.collect()] == [2]
    assert [n.split("-")[0] for n in folders(spark) - before] == ["kept"]
    discard(kept, spark.range(1))
    assert folders(spark) == before


def test_shuffles_of_a_written_table_do_not_stay(spark):
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in local.rglob("shuffle_*.data")}
    before = files()
    rows = spark.range(1000).withColumn("h", F.xxhash64("id"))
    # collected without a shuffle, which would leave files of its own
    assert len(materialize(rows.groupBy("h").count(), "counted").collect()) == 1000
    # Spark removes them on another thread
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.3)
    assert files() <= before


def test_shuffled_values_travel_once(spark, tmp_path, monkeypatch):
    rows = [(k, None if k % 4 == 3 else k % 4, None if k % 11 == 0 else k % 7) for k in range(300)]
    spark.createDataFrame(rows, "k long, g long, v long").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    out = splits.shuffle_values(df, ["g"], ["k"], "v", 5, "w")
    assert out.columns == ["k", "g", "v", "w"]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.k: (r.g, r.v, r.w) for r in out.collect()}
    monkeypatch.setattr(ordering, "PLAIN_WINDOW_ROWS", 20)
    assert got == {r.k: (r.g, r.v, r.w) for r in splits.shuffle_values(df, ["g"], ["k"], "v", 5, "w").collect()}

    def order(seed, g):
        return sorted((r for r in rows if r[1] == g), key=lambda r: int(hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()[:15], 16))

    for g in (0, 1, 2, None):
        for to, taken in zip(order(5, g), order(6, g), strict=True):
            assert got[to[0]] == (to[1], to[2], taken[2])


def test_replicates_in_turns(spark, tmp_path, monkeypatch):
    assert [list(r) for r in resample.turns(10, 3)] == [[0, 1, 2]] and list(resample.turns(0, 2)) == [range(2)]
    orders = [(k, ["1-URGENT", "5-LOW", "2-HIGH"][k * 7 % 3], 100.0 + k * 37 % 101, f"{1995 + k % 5}-0{1 + k % 7}-1{k % 9}") for k in range(600)]
    df = spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_totalprice double, o_orderdate string")
    df.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    t = Tables(spark, str(tmp_path))
    whole = resampling.shuffled_null(t).collect()
    monkeypatch.setattr(resample, "TURN_ROWS", 600 * 15)
    assert [list(r)[:1] for r in resample.turns(600, resampling.SHUFFLES)] == [[0], [15], [30]]
    before = folders(spark)
    assert resampling.shuffled_null(t).collect() == whole
    left = [n.split("-")[0] for n in folders(spark) - before]
    assert left.count("aucs") == 3 and left.count("ordered") <= 2, left


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_names_are_matched_band_by_band(spark, monkeypatch):
    """No band lists the pairs of names that a better one has matched, and the pairs are those of the whole list."""
    rnd = random.Random(7)
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma"]
    name = lambda: " ".join([*rnd.sample(words, rnd.randint(1, 4)), str(rnd.randint(0, 9999))])
    sides = [[(i, name()) for i in range(n)] for n in (40, 60)]
    a, b = [spark.createDataFrame([*side, (None, f"alpha bravo delta {len(side)}"), (900, None), (901, "--")], "key long, name string") for side in sides]
    listed = []
    best = matching.mutual_best
    monkeypatch.setattr(matching, "mutual_best", lambda c, order: listed.append(c.count()) or best(c, order))
    got = {(r.l, r.r): (r["round"], round(r.sim, 6)) for r in matching.fuzzy_match(a, b, "key", "key", "name").collect()}

    norm = lambda s: re.sub("[^a-z0-9]", "", s)
    tokens = lambda s: set(re.findall("[a-z0-9]{4,}", s))
    pairs = [(i, j, len(tokens(x) & tokens(y)), 1 - lev(norm(x), norm(y)) / max(len(norm(x)), len(norm(y)))) for i, x in sides[0] for j, y in sides[1]]
    free, want = (set(range(40)), set(range(60))), {}
    for turn, few, least, order in ((1, 0, 0.999999, lambda p: p[:2]), (2, 3, 0.7, lambda p: (-p[2], -p[3], p[0], p[1])), (3, 0, 0.6, lambda p: (-p[3], p[0], p[1]))):
        for l, r, shared, sim in sorted(pairs, key=order):
            if shared >= few and sim > least and l in free[0] and r in free[1]:
                want[l, r] = (turn, round(sim, 6))
                free[0].remove(l)
                free[1].remove(r)
    assert got == want and {t for t, _ in want.values()} >= {2, 3}
    assert sum(listed) < sum(p[3] > 0.6 for p in pairs)
    # the same pairs when no task takes them in order
    monkeypatch.setattr(matching, "FEW_PAIRS", 0)
    assert got == {(r.l, r.r): (r["round"], round(r.sim, 6)) for r in matching.fuzzy_match(a, b, "key", "key", "name").collect()}


def test_marks_never_rule_out_a_similar_name(spark):
    rnd = random.Random(5)
    pairs = []
    for _ in range(400):
        x = "".join(rnd.choice("aab0123456789xyzé") for _ in range(rnd.randint(1, 40)))
        y = list(x)
        for _ in range(rnd.randint(0, 8)):
            at = rnd.randrange(len(y) + 1)
            y[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "1", "\U0001d400"])
        pairs.append((x, "".join(y)))
    df = spark.createDataFrame(pairs, "x string, y string")
    df = matching.marked(df.withColumn("norm", F.col("x"))).withColumnsRenamed({"norm": "norm_x", "marks": "marks_x"})
    df = matching.marked(df.withColumn("norm", F.col("y"))).withColumnsRenamed({"norm": "norm_y", "marks": "marks_y"})
    for above in (0.6, 0.9):
        df = df.withColumns({f"near{above}": matching._near(above), f"sim{above}": matching._similarity(above)})
    for r in df.collect():
        sim = 1 - lev(r.x, r.y) / max(len(r.x), len(r.y))
        for above in (0.6, 0.9):
            assert not sim > above or r[f"near{above}"]
            assert (r[f"sim{above}"] > above) == (sim > above)
            assert not sim > above or abs(r[f"sim{above}"] - sim) < 1e-12


def test_pairs_with_shared_tokens_are_met_once(spark, monkeypatch):
    rnd = random.Random(2)
    side = lambda n: [(i, sorted(rnd.sample("abcdefgh", rnd.randint(2, 6)))) for i in range(n)]
    left, right = side(30), side(50)
    a, b = [spark.createDataFrame(s, "key long, tokens array<string>") for s in (left, right)]
    out = matching.token_candidates(a, b)
    want = sorted((i, j, len({*x} & {*y})) for i, x in left for j, y in right if len({*x} & {*y}) >= 3)
    pairs = want
    assert sorted(map(tuple, out.collect())) == want
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0], "pairs are sent on to be made distinct"
    # many names of one set of tokens
    monkeypatch.setattr(matching, "SET_ROWS", 7)
    same = [(i, ["a", "b", "c", f"only{i}"] if i % 3 else ["a", "b", "d", "e"]) for i in range(90)]
    c = spark.createDataFrame(same, "key long, tokens array<string>")
    want = sorted((i, j, len({*x} & {*y})) for i, x in left for j, y in same if len({*x} & {*y}) >= 3)
    assert sorted(map(tuple, matching.token_candidates(a, c).collect())) == want
    twice = sorted(map(tuple, matching.token_candidates(a, b.unionAll(b.where("key < 3"))).collect()))
    assert len(twice) == len({*twice}) and {p for p in twice if p[1] >= 3} == {(i, j, n) for i, j, n in pairs if j >= 3}


def test_queries_are_written_once_a_turn_not_once_a_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(7, [0.0] * 6), (None, [1.0] * 6), (3, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    written = []
    keep = nearest.materialize
    monkeypatch.setattr(nearest, "materialize", lambda t, name: (lambda w: written.append((name, w.count())) or w)(keep(t, name)))
    monkeypatch.setattr(nearest, "SHARED_CELLS", 150 * 6)
    before = folders(spark)
    got = nearest.nearest_references(df, df, "id", "v", 3, True, shared_rows=0, block_rows=20, slice_rows=30)
    units = nearest.unit_rows(pd.Series([v for _, v in rows]))
    sims = units @ units.T
    want = []
    for i, (name, _) in enumerate(rows):
        mine = [s for j, s in enumerate(sims[i]) if not np.isnan(s) and (name is None or rows[j][0] != name)]
        want.append((repr(name), [round(s, 6) for s in sorted(mine, reverse=True)[:3]]))
    assert sorted((repr(r.id), [round(s, 6) + 0.0 for s in r.sims]) for r in got.collect()) == sorted(want)
    sent = [n for name, n in written if name not in ("placed", "blocks")]
    # 21 blocks of 20 or fewer rows in turns of up to 7
    assert max(sent) <= len(rows) and len(sent) <= 10, written
    assert sorted(n.split("-")[0] for n in folders(spark) - before) == ["best", "queries"]


def test_consumed_tables_of_near_duplicates_are_deleted(spark, monkeypatch):
    rnd = random.Random(9)
    base = [[rnd.choice("abcdefghij") for _ in range(30)] for _ in range(6)]
    texts = [(i, " ".join(w if rnd.random() > 0.05 else "x" for w in base[i % 6])) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(texts, "id long, text string")

    def links():
        out = grouping.greedy_links(df, [], "id", "text", [0.5, 0.8], coverage=0.6)
        return sorted(map(tuple, out.collect()))

    before = folders(spark)
    whole = links()
    left = [n.split("-")[0] for n in folders(spark) - before]
    assert set(left) <= {"exact", "lengths", "settled", "status"} and "settled" in left, left
    assert len({r for _, _, r, _ in whole}) < 60
    # the same links if shingles travel in turns
    turns = []
    keep = grouping.materialize
    monkeypatch.setattr(grouping, "materialize", lambda t, name: turns.append(name) or keep(t, name))
    monkeypatch.setattr(grouping, "TURN_SHINGLES", 100)
    assert links() == whole
    assert turns.count("similarities") > turns.count("wanted")
