"""Session settings and written intermediate tables.

Intermediate results that are read more than once, or that end an iteration, are written as
Parquet below the folder named by ``spark.checkpoint.dir``. That folder is shared by all
executors, so a lost executor only means reading the files again.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
#: Folders of written tables, and of all that were written inside each open :func:`materialize_only`.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_inside: list[list[str]] = []
#: Has Spark delete a query's shuffle files when it ends; else they stay until the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options every operator here relies on."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "recordmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, one sub-folder per application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app_id = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_dirs.setdefault(app_id, tempfile.mkdtemp(prefix="recordmill-"))
    return f"{base.rstrip('/')}/recordmill-{app_id}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a scan of the written table (short lineage, columnar)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    if _inside:
        _inside[-1].append(path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that no pending result reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            _delete(table.sparkSession, path)


def materialize_only(spark: SparkSession, build: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """Write the table that ``build`` returns and delete all others that were written on the way to it."""
    _inside.append([])
    try:
        table = materialize(build(), name)
    finally:
        written = _inside.pop()
    for path in written[:-1]:
        _delete(spark, path)
    if _inside:
        _inside[-1].append(written[-1])
    return table


def materialize_counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """The same, and the number of rows, counted while they are written."""
    rows = Observation()
    return materialize(df.observe(rows, F.count(F.lit(1)).alias("n")), name), rows.get["n"]


def spread(scan: DataFrame, *key: str) -> DataFrame:
    """Rehash a plain scan that has fewer tasks than there are cores; leave larger scans alone.

    For text work on a few unsplittable files. A scan of a large table already has many tasks and
    is not shuffled. Only for scans: asking for the partitions of a plan with a shuffle runs it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *key) if scan.rdd.getNumPartitions() < cores else scan


def clear_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call when no result is pending."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
