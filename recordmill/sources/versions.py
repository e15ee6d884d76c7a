"""Tables as numbered versions: staged writes, manifests, publication that only one writer can win.

A version is a manifest ``v=<n>``, a small JSON file that names the data folders it consists of. Data are written to a
folder of their own first and are seen by nobody until a manifest names them, so a broken write leaves
nothing to see. A manifest is created under its number or not at all: of two writers that want
the same number one is told so and goes on from the other's version. Published versions never change.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Attempts to publish before a writer gives up; each lost one means that another writer got on.
ATTEMPTS = 1000


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Make the whole file appear at ``path``; False if there is one already."""
    fs, where = _file_system(spark, path)
    draft = f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    if fs.getScheme() == "file":
        local, target = urlparse(draft).path, urlparse(path).path
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(local, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(local)
        return True
    out = fs.create(jvm.org.apache.hadoop.fs.Path(draft), False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(draft), where, options)
    except Exception as lost:
        fs.delete(jvm.org.apache.hadoop.fs.Path(draft), False)
        if fs.exists(where):
            return False
        raise lost
    return True


def history(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    fs, root = _file_system(spark, base)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def manifest(spark: SparkSession, base: str, version: int) -> dict:
    fs, where = _file_system(spark, f"{base.rstrip('/')}/v={version}")
    source = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.java.util.Scanner(source, "UTF-8").useDelimiter("\\A").next())
    finally:
        source.close()


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version of the table, the latest if none is named."""
    if version is None:
        found = history(spark, base)
        if not found:
            raise FileNotFoundError(f"no version at {base}")
        version = found[-1]
    held = manifest(spark, base, version)
    schema = StructType.fromJson(held["schema"])
    paths = [f"{base.rstrip('/')}/{p}" for p in held["parts"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _stage(df: DataFrame, base: str) -> tuple[str, int]:
    part = f"data/{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(f"{base.rstrip('/')}/{part}")
    return part, rows.get["n"]


def _publish(spark: SparkSession, base: str, number: int, kind: str, parts: list[str], schema: StructType, rows: int) -> bool:
    text = json.dumps({"version": number, "kind": kind, "parts": parts, "rows": rows, "schema": schema.jsonValue()})
    return _create(spark, f"{base.rstrip('/')}/v={number}", text)


def rewrite(df: DataFrame, base: str) -> int:
    """Publish ``df`` as the next version; returns its number. Earlier versions stay as they are."""
    spark = df.sparkSession
    part, rows = _stage(df, base)
    for _ in range(ATTEMPTS):
        number = max(history(spark, base), default=-1) + 1
        if _publish(spark, base, number, "rewrite", [part], df.schema, rows):
            return number
    raise RuntimeError(f"other writers published at {base} all the time")


def update(base: str, spark: SparkSession, change: Callable[[DataFrame], DataFrame]) -> int:
    """Publish ``change(latest)`` as the version that follows it: if another writer comes first, the change is made anew."""
    for _ in range(ATTEMPTS):
        last = history(spark, base)[-1]
        df = change(read(spark, base, last))
        part, rows = _stage(df, base)
        if _publish(spark, base, last + 1, "rewrite", [part], df.schema, rows):
            return last + 1
    raise RuntimeError(f"other writers published at {base} all the time")


def append_pending(todo: DataFrame, base: str, keys: Sequence[str], batches: int = 1) -> int:
    """Append the rows whose key is not in the table yet, a hash range of the keys as one version; returns rows appended.

    An interrupted run loses one batch at most. A batch that another writer overtakes looks again what is pending, so writers with common keys do not
    append a key twice; a key that repeats in ``todo`` is appended as often as it stands there.
    """
    spark = todo.sparkSession
    appended = 0
    for b in range(batches):
        chunk = todo.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == b)
        for _ in range(ATTEMPTS):
            found = history(spark, base)
            before = manifest(spark, base, found[-1])["parts"] if found else []
            fresh = chunk
            if before:
                fresh = chunk.join(read(spark, base, found[-1]).select(*keys).distinct(), list(keys), "left_anti")
            part, rows = _stage(fresh.select(todo.columns), base)
            if not rows and found:
                break
            if _publish(spark, base, found[-1] + 1 if found else 0, "append", [*before, part], todo.schema, rows):
                appended += rows
                break
        else:
            raise RuntimeError(f"other writers published at {base} all the time")
    return appended
