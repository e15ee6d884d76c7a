"""No row is lost where a key, a cell or a text is null, nor where an event is late."""

import shutil

from pyspark.sql import functions as F

from recordmill.operators import grouping, metrics, ranks, resample, splits, timeline
from recordmill.session import new_path
from recordmill.streaming import first_seen


def rows_with_nulls(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    return df.select(
        "k", F.when(F.col("k") % 5 != 0, F.concat(F.lit("d"), (F.col("k") % 3).cast("string"))).alias("dom"),
        (F.col("k") % 2).cast("int").alias("y"), ((F.col("k") * 37) % 11).cast("double").alias("s"),
    ).persist()


def test_splits_keep_every_row(spark):
    df = rows_with_nulls(spark)
    split = splits.split_stratified(df, "dom", "y", ["k"], ["d1"])
    assert split.count() == split.select("k").distinct().count() == 100
    assert splits.kfold_stratified(df, ["dom", "y"], ["k"], 5, 1).count() == 100
    assert splits.split_halves(df, ["dom"], ["k"], [1]).count() == 100
    assert splits.split_grouped(df, ["dom"], ["dom"], [1]).count() == 100
    shuffled = splits.shuffle_values(df, ["dom"], ["k"], "y", 3, "z")
    assert shuffled.count() == 100
    sums = shuffled.groupBy("dom").agg(F.sum("y").alias("a"), F.sum("z").alias("b")).collect()
    assert len(sums) == 4 and all(r.a == r.b for r in sums)


def test_cells_agree_on_null(spark):
    df = rows_with_nulls(spark)
    for out in (
        metrics.auc(df, ["dom"], "s", "y"), metrics.spearman(df, ["dom"], "s", "k"),
        ranks.exact_quantiles(df, ["dom"], "s", {"q50": 0.5}),
        resample.bootstrap_auc(df, ["dom"], ["k"], "s", "y", 2, 1).select("dom").distinct(),
    ):
        assert out.count() == 4
    assert ranks.average_ranks(df, ["dom"], "s", "r").where("r is not null").count() == 100
    assert ranks.percent_ranks(df, ["dom"], "s").where("percent_rank is not null").count() == 100
    assert timeline.size_weights(df, ["dom"], "inverse", "w").where("w is null").count() == 0


def test_groups_keep_null_text_and_block(spark):
    rows = [(i, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"one two three four five {i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, lang string, text string")
    links = grouping.greedy_links(df, ["lang"], "k", "text")
    assert links.count() == links.select("k").distinct().count() == 40
    assert links.where("k % 5 = 0 and representative <> k").count() == 0


def test_stream_takes_late_files(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 4:02d} 00:00:00", i % 3, "ab"[i % 2]) for i in range(100)]
    events = spark.createDataFrame(rows, "id long, ts string, g long, c string").withColumn("ts", F.col("ts").cast("timestamp"))
    table = tmp_path / "events.parquet"
    table.mkdir()
    for n, part in enumerate(reversed(range(4))):  # newest first, one repeated
        for again in range(1 + (part == 1)):
            path = new_path(spark, "part")
            events.where((F.col("id") >= part * 25) & (F.col("id") < part * 25 + 25)).coalesce(1).write.parquet(path)
            source = next(f for f in __import__("pathlib").Path(path.removeprefix("file:")).glob("part-*"))
            shutil.copy(source, table / f"{n}-{again}.parquet")
    got = first_seen.run_available(spark, str(table), events.schema, "id", "ts", ["g"], "c", files=1)
    want = events.groupBy("g", "c").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
