"""Typed scans and sinks for flat tables; appends and rewrites are in :mod:`recordmill.sources.versions`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True
) -> DataFrame:
    """CSV or TSV with a declared schema; blank fields are null."""
    return (
        spark.read.schema(schema)
        .option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
        .csv(path)
    )


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    (
        df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        .csv(path)
    )


def union_tagged(parts: dict[str, DataFrame], tag: str = "domain") -> DataFrame:
    """Union of per-domain tables by column name, each row tagged with its domain."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")
