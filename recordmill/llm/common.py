"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.session import materialize, new_path, tune

__all__ = ["BATCH_ROWS", "bit_filter", "map_batches", "materialize", "maybe_in", "new_path", "prepare", "without"]

#: Rows of one Arrow batch; texts are long, so batches are kept short.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of these operators: short Arrow batches, so a worker holds few texts at once."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def map_batches(df: DataFrame, fn: Callable[..., pa.RecordBatch | None], schema: str, *args) -> DataFrame:
    """Apply ``fn(batch, *args)`` to every Arrow batch of ``df``; ``None`` stands for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch, *args)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Bits of :func:`bit_filter`; its 4 MB are its size at any input.
FILTER_BITS = 1 << 25


def bit_filter(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test for arrays of 64-bit integers: true for every value of the one column, and for some others.

    A bit table of fixed size, made on the executors and shared with the tasks, that saves
    moving rows a join would drop anyway. When there are many keys it lets more rows pass; it
    never decides a result.
    """
    bit = F.pmod(F.col(keys.columns[0]).bitwiseXOR(F.shiftrightunsigned(keys.columns[0], 29)), F.lit(FILTER_BITS))
    # 32 bits to a word: at most FILTER_BITS / 32 rows come to the driver
    words = keys.select(bit.alias("b")).groupBy(F.expr("shiftright(b, 5)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 31))")).alias("v"))
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toPandas()
    table[found["w"].to_numpy()] = found["v"].to_numpy().astype(np.uint32)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def test(values: np.ndarray) -> np.ndarray:
        v = values.view(np.uint64)
        b = ((v ^ (v >> np.uint64(29))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        return (shared.value[b >> 5] >> (b & 31).astype(np.uint32)) & 1 != 0

    return test


def maybe_in(column: str, keys: DataFrame) -> Column:
    """True for every value of ``column`` in the one column of ``keys``, and for some others."""
    name = keys.columns[0]
    test = bit_filter(keys.select(F.xxhash64(name).alias(name)))

    @F.pandas_udf("boolean")
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(test(hashes.to_numpy()))

    return run(F.xxhash64(column))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``; only rows that may be dropped are shuffled."""
    ids = materialize(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct(), "dropped")
    hit = maybe_in(id_col, ids)
    return docs.where(~hit).unionByName(docs.where(hit).join(ids, id_col, "left_anti").select(docs.columns))
