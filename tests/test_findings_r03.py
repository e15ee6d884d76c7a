"""Faults that only larger inputs showed, each at a size at which it can be told."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordmill.functions import text
from recordmill.operators import grouping, matching, nearest, resample, splits
from recordmill.plans import splitting, validation
from recordmill.plans.registry import Tables


def test_shuffled_replicates_are_not_sent_through_the_driver(spark, tmp_path):
    """Rows look small before they are multiplied; the join of the two orders must not be a broadcast."""
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    rows.write.parquet(str(tmp_path / "rows"))
    spread = resample.replicates(spark.read.parquet(str(tmp_path / "rows")), 20, ["k"])
    out = splits.shuffle_values(spread, ["b", "g"], ["b", "k"], "v", 5, "w")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    cells = out.groupBy("b", "g").agg(F.sort_array(F.collect_list("v")).alias("v"), F.sort_array(F.collect_list("w")).alias("w"))
    assert cells.where("v = w").count() == 60


def peak_mb(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_blocks_are_compared_in_bounded_steps():
    rng = np.random.default_rng(1)
    x, refs = rng.normal(size=(8000, 8)), rng.normal(size=(4096, 8))
    keys = np.arange(8000)
    for k, exclude_self in ((1, False), (5, True)):
        best, peak = peak_mb(lambda: nearest.compare(x, keys, refs, keys[:4096], k, exclude_self))
        assert best.shape == (8000, k) and peak < 80
        sims = x[::799] @ refs.T
        if exclude_self:
            sims[keys[::799, None] == keys[None, :4096]] = -np.inf
        assert np.allclose(best[::799], -np.sort(-sims, axis=1)[:, :k])


def test_characters_are_counted_in_batches(monkeypatch):
    monkeypatch.setattr(text, "COUNTED", 7)
    rows = [("a", "xyx é\U0001d400"), (None, "zz"), ("a", ""), ("b", "x" * 30), ("a", "xy\n")]
    batch = pa.RecordBatch.from_pylist([{"name": n, "low": s} for n, s in rows])
    got = {}
    for out in text.count_characters(iter([batch, batch.slice(2, 2)])):
        for r in out.to_pylist():
            got[r["lang"], r["ch"]] = got.get((r["lang"], r["ch"]), 0) + r["n"]
    want = Counter((n, c) for n, s in rows + rows[2:4] for c in s)
    assert got == dict(want)


def test_arms_keep_the_scores_of_a_record(spark, tmp_path):
    """Scores travel with the record; rows of an id that repeats meet the scores of all of them, a null id none."""
    orders = [(i if i % 9 else i // 2, i % 30, "OFP"[i % 3], 100.0 + i * 37 % 101, f"{1995 + i % 6}-0{1 + i % 7}-03", f"{1 + i % 5}-X") for i in range(400)]
    orders = [(None if i % 50 == 7 else k, c, s, p, d, "1-URGENT" if o == "1-X" else o) for i, (k, c, s, p, d, o) in enumerate(orders)]
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    df = spark.createDataFrame(orders, ", ".join(f"{c} {k}" for c, k in zip(columns, ["long", "long", "string", "double", "string", "string"])))
    df.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    customers = spark.range(30).select(F.col("id").alias("c_custkey"), F.concat(F.lit("S"), F.col("id") % 2).alias("c_mktsegment"))
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    t = Tables(spark, str(tmp_path))
    rows = splitting.inherited(t)
    assert "price" in splitting.grouped_arm(rows, "price").columns and "yr" in splitting.random_arm(rows, "yr").columns
    got = {(r.arm, r.seed, r.domain, r.split, r.candidate): (r.auc, r.n_pos, r.n_neg) for r in validation.arm_aucs(t).collect()}
    # every row of an arm beside every row of its id, in plain Python
    records = {}
    for r in rows.collect():
        records.setdefault(r.record_id, []).append(r)
    want = {}
    for arm, found in (("grouped", splitting.grouped_arm(rows)), ("random", splitting.random_arm(rows))):
        for r in found.where("record_id is not null").collect():
            for other in records[r.record_id]:
                want.setdefault((arm, r.seed, r.domain, r.split), []).append((other.price, other.target_plus_other))
    assert any(len(v) > 1 for v in records.values()) and None in records
    assert {k[:4] for k in got} == set(want)
    for k, pairs in want.items():
        pos, neg = [p for p, y in pairs if y == 1], [p for p, y in pairs if y == 0]
        auc, n_pos, n_neg = got[(*k, "price")]
        assert (n_pos, n_neg) == (len(pos), len(neg))
        if pos and neg:
            won = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
            assert abs(auc - won / len(pos) / len(neg)) < 1e-6


def test_similar_names_are_found_without_a_written_index(spark, monkeypatch):
    """Segments of similar names are short and common: an index of them held every pair many times over."""
    monkeypatch.setattr(matching, "materialize", lambda *_: pytest.fail("names are written again"))
    names = [f"{w}.example.com/{k}/page" for w in ("alpha", "beta", "gammadelta") for k in (7, 77, 12345)] + ["", "x"]
    left, right = [spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(99, None), (None, names[0])], "key long, norm string") for _ in "ab"]
    found = {(r.l, r.r): round(r.sim, 6) for r in matching.edit_candidates(left, right).collect()}
    ratio = {r.n: {q.m: q.s for q in r.o} for r in _ratios(spark, names)}
    assert found == {(i, j): round(ratio[a][b], 6) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and ratio[a][b] > 0.6}


def _ratios(spark, names):
    n, m = [spark.createDataFrame([(x,) for x in names], f"{c} string") for c in "nm"]
    return n.crossJoin(m).groupBy("n").agg(F.collect_list(F.struct("m", text.levenshtein_ratio(F.col("n"), F.col("m")).alias("s"))).alias("o")).collect()


def test_large_families_do_not_take_a_round_for_every_few_members(spark):
    """Texts that share a bucket but are not similar enough all become representatives."""
    df = spark.createDataFrame([(i, f"p q r s x{i:03d}") for i in range(100)] + [(200, "p q r s x007"), (201, None)], "id long, text string")
    rounds = []
    links = grouping.greedy_links(df, [], "id", "text", [0.6], coverage=0.6, front=2, trace=rounds)
    assert rounds[-1] == 0 and len(rounds) <= 8
    assert {r.id: r.representative for r in links.collect()} == {**{i: i for i in range(100)}, 200: 7, 201: 201}


def test_shingle_sets_by_arrays(monkeypatch):
    monkeypatch.setattr(text, "HASHED", 40)
    texts = ["", " \n", "a", "b a", "a b", "a  b\tc", "a b c a b c", "a\x0bb c d", "é \U0001d400 c d e", "ab c d e f"] * 2
    seeds = np.array([5] * 10 + [9] * 10, np.uint64)
    found, sizes = text.shingle_sets(texts, seeds, 3)
    sets = [set(p.tolist()) for p in np.split(found, np.cumsum(sizes)[:-1])]

    def plain(t, seed):
        words = [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
        return {(seed, *words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {(seed, *words)}

    want = [plain(t, s) for t, s in zip(texts, seeds.tolist())]
    for a, x in zip(sets, want):
        assert len(a) == len(x)
        assert [len(a & b) for b in sets] == [len(x & y) for y in want]


def test_repeated_records_do_not_wait_for_themselves(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e g"), (3, "u v w x")]
    links = grouping.greedy_links(spark.createDataFrame(rows, "id long, text string"), [], "id", "text", [0.6], coverage=0.6)
    assert sorted((r.id, r.representative) for r in links.collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
