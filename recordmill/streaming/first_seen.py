"""First-seen timeline over a stream of events, kept as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from recordmill.functions.nullsafe import attach
from recordmill.session import new_path


def read_events(spark: SparkSession, table: str, schema: StructType, files: int = 16) -> DataFrame:
    """Stream of the files of a table, a folder of part files or one file, ``files`` per batch."""
    # as a pattern, because a plain path of the file source must be a folder
    pattern = f"{table[:-1]}[{table[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def sightings(events: DataFrame, key: str, ts: str, group: list[str], category: str) -> DataFrame:
    """What the timeline needs of each event."""
    return events.select(*group, category, F.col(key).alias("__key"), F.col(ts).cast("timestamp").alias("__ts"))


def start(
    stream: DataFrame, base: str, group: list[str], category: str, on_change: Callable[[DataFrame, int], None] | None = None
) -> tuple[StreamingQuery, StreamingQuery]:
    """Keep the timeline of all sightings as state below ``base``; starting again there goes on where it stopped.

    One query keeps the earliest time of each (group, category), the other the event ids seen and their number: an
    id counts once, in whichever batch and however late it comes back. A batch touches the state of its own events only. ``on_change`` receives
    the numbers that a batch changed. State is kept in RocksDB, so ids beyond memory lie on disk.
    """
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        cell = [*group, category]
        times = stream.groupBy(*cell).agg(F.min("__ts").alias("first_ts"))
        counts = stream.dropDuplicates([*cell, "__key"]).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))

        def begin(df: DataFrame, part: str, call) -> StreamingQuery:
            writer = df.writeStream.outputMode("update").option("checkpointLocation", f"{base}/{part}").trigger(availableNow=True)
            return (writer.foreachBatch(call) if call else writer.format("noop")).start()

        return begin(times, "times", None), begin(counts, "counts", on_change)
    finally:
        spark.conf.set(name, before)


def timeline(spark: SparkSession, base: str, group: list[str], category: str) -> DataFrame:
    """Earliest time and number of distinct events of each (group, category), read from the state: no sighting is read again."""
    cell = [*group, category]

    def state(part: str, field: str, out: str) -> DataFrame:
        held = spark.read.format("statestore").option("operatorId", 0).load(f"{base}/{part}")
        return held.select(*[F.col(f"key.{c}").alias(c) for c in cell], F.col(f"value.{field}").alias(out))

    return attach(state("times", "min", "first_ts"), state("counts", "count", "n"), cell)


def run_available(
    spark: SparkSession, table: str, schema: StructType, key: str, ts: str, group: list[str], category: str,
    files: int = 16, base: str | None = None,
) -> DataFrame:
    """Process everything that has arrived since the last run at ``base``, in any order, and return the timeline."""
    stream = sightings(read_events(spark, table, schema, files), key, ts, group, category)
    base = base or new_path(spark, "timeline")
    for query in start(stream, base, group, category):
        query.awaitTermination()
    return timeline(spark, base, group, category)
