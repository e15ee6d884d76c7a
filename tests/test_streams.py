"""The first-seen timeline as state: batches, repeats, restarts."""

import random

from pyspark.sql import functions as F

from recordmill.session import new_path
from recordmill.streaming import first_seen

SCHEMA = "id long, g string, c string, ts timestamp"


def truth(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = df.groupBy("g", "c").agg(F.min("ts").alias("first_ts"), F.count_distinct(F.coalesce("id", F.lit(-1))).alias("n"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_batches_repeats_and_restart(spark):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    table, base = new_path(spark, "events"), new_path(spark, "state")

    def batch(n):
        return [
            (rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), rng.choice(["x", "y"]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(10**6)))
            for _ in range(n)
        ]

    seen, sizes = [], []
    for n in (40, 25, 1, 60):
        rows = batch(n) + rng.sample(seen, min(len(seen), 10))  # ids come back in later batches, also with an earlier time
        seen += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(table)
        # every run is a restart from the checkpoint
        stream = first_seen.sightings(first_seen.read_events(spark, table, SCHEMA, 1), "id", "ts", ["g"], "c")
        queries = first_seen.start(stream, base, ["g"], "c", lambda changed, number: sizes.append((number, changed.count())))
        for q in queries:
            q.awaitTermination()
        progress = [p for p in queries[1].recentProgress if p["numInputRows"]]
        # the work of a batch is its own rows, not all that came before
        assert [p["numInputRows"] for p in progress] == [len(rows)]
        assert all(o["numRowsUpdated"] <= len(rows) for p in progress for o in p["stateOperators"])
        got = first_seen.timeline(spark, base, ["g"], "c").select("g", "c", "first_ts", "n")
        assert sorted(map(tuple, got.collect()), key=repr) == truth(spark, seen)
    assert [number for number, _ in sizes] == sorted({number for number, _ in sizes})
    again = first_seen.run_available(spark, table, spark.read.parquet(table).schema, "id", "ts", ["g"], "c", base=base)
    assert sorted(map(tuple, again.select("g", "c", "first_ts", "n").collect()), key=repr) == truth(spark, seen)
