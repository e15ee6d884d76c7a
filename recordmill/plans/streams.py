"""Streaming query: the first-seen timeline fed from files."""

from pyspark.sql import functions as F

from recordmill.plans.registry import Tables, query
from recordmill.streaming import first_seen


@query(
    "stream_first_seen",
    "select user_id, event_type, min(ts) as first_ts, count(*) as n from events group by all",
)
def stream_first_seen(t: Tables):
    out = first_seen.run_available(
        t.spark, f"{t.folder}/events.parquet", t.events.schema, "event_id", "ts", ["user_id"], "event_type"
    )
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))
