"""Row numbers, running sums and running minima over groups of any size.

A Spark window sorts one group in one task. That is right for groups known to be small; a group
that may hold a third of a very large table needs another way. Both operators below first count
the largest group. Small groups take the plain window. Otherwise the rows are range-partitioned
on (group, order), each range slice is written with its slice number, and the totals of earlier
slices of the same group are added to the running value inside each slice. The result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.nullsafe import attach
from recordmill.session import materialize, materialize_counted

PLAIN_WINDOW_ROWS = 2_000_000


def running(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column],
    *,
    number: str | None = None,
    before: dict[str, str] | None = None,
    upto: dict[str, str] | None = None,
    lowest: dict[str, str] | None = None,
    size: str | None = None,
    total: dict[str, str] | None = None,
    store: bool = False,
    plain_rows: int | None = None,
) -> DataFrame:
    """Add a 1-based row number, exclusive (``before``) or inclusive (``upto``) sums, or minima.

    ``before``/``upto``/``lowest`` map the new column to the source column; ``size`` names a column for the rows of the group, ``total`` maps
    new columns to columns summed over the whole group. ``order`` must be a total order
    inside a group wherever ``number`` is used. ``store`` writes the input first: right for a small
    aggregate over a large scan, which would otherwise be read once to count and once to order.
    """
    before, upto, lowest, total = before or {}, upto or {}, lowest or {}, total or {}
    limit = PLAIN_WINDOW_ROWS if plain_rows is None else plain_rows
    rows = None
    if store:
        df, rows = materialize_counted(df, "ordered")
    if rows is None or rows > limit:
        sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
        largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
        if (largest or 0) > limit:
            out = _sliced(df, list(part), order, number, before, upto, lowest, rows, max(limit, 1))
            return _with_totals(out, df, list(part), size, total)
    out = _within(df, list(part), order, number, before, upto, lowest)
    whole = W.partitionBy(*(part or [F.lit(0)]))
    cols = {o: F.sum(c).over(whole) for o, c in total.items()}
    if size:
        cols[size] = F.count(F.lit(1)).over(whole)
    return out.withColumns(cols) if cols else out


def _with_totals(out: DataFrame, df: DataFrame, part: list[str], size: str | None, total: dict[str, str]) -> DataFrame:
    sums = [F.sum(c).alias(o) for o, c in total.items()] + ([F.count(F.lit(1)).alias(size)] if size else [])
    if not sums:
        return out
    totals = df.groupBy(*part).agg(*sums)
    names = [c for c in totals.columns if c not in part]
    if part:
        return attach(out, totals, part)
    one = totals.select(F.struct(*names)).scalar()
    return out.withColumn("__t", one).withColumns({c: F.col(f"__t.{c}") for c in names}).drop("__t")


def row_numbers(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column],
    out: str = "rn",
    plain_rows: int | None = None,
) -> DataFrame:
    return running(df, part, order, number=out, plain_rows=plain_rows)


def _within(df, part, order, number, before, upto, lowest) -> DataFrame:
    w = W.partitionBy(*(part or [F.lit(0)])).orderBy(*order)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    here = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols = {out: F.coalesce(F.sum(c).over(past), F.lit(0)) for out, c in before.items()}
    cols |= {out: F.sum(c).over(here) for out, c in upto.items()}
    cols |= {out: F.min(c).over(here) for out, c in lowest.items()}
    if number:
        cols[number] = F.row_number().over(w).cast("bigint")
    return df.withColumns(cols)


def _sliced(df, part, order, number, before, upto, lowest, total, limit) -> DataFrame:
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // limit + 1)
    ranged = df.repartitionByRange(min(n, 50_000), *[F.col(p) for p in part], *order)
    # The slice number is stored with the row: later reads cannot see another partitioning.
    sliced = materialize(ranged.withColumn("__slice", F.spark_partition_id()), "slices")

    summed = {c: f"__t_{i}" for i, c in enumerate(dict.fromkeys([*before.values(), *upto.values()]))}
    least = {c: f"__m_{i}" for i, c in enumerate(dict.fromkeys(lowest.values()))}
    totals = sliced.groupBy(*part, "__slice").agg(
        F.count(F.lit(1)).alias("__t_n"),
        *[F.sum(c).alias(t) for c, t in summed.items()],
        *[F.min(c).alias(t) for c, t in least.items()],
    )
    # At most one row per (group, slice).
    earlier = (
        W.partitionBy(*(part or [F.lit(0)])).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = totals.select(
        *[F.col(p).alias(f"__p_{i}") for i, p in enumerate(part)],
        F.col("__slice").alias("__s"),
        *[
            F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(t)
            for t in ["__t_n", *summed.values()]
        ],
        *[F.min(t).over(earlier).alias(t) for t in least.values()],
    )
    on = [F.col("__slice") == F.col("__s")]
    on += [F.col(p).eqNullSafe(F.col(f"__p_{i}")) for i, p in enumerate(part)]
    out = _within(sliced, [*part, "__slice"], order, number, before, upto, lowest)
    out = out.join(starts, reduce(lambda a, b: a & b, on), "left")
    cols = {o: F.col(o) + F.col(summed[c]) for o, c in {**before, **upto}.items()}
    cols |= {o: F.least(F.col(o), F.col(least[c])) for o, c in lowest.items()}
    if number:
        cols[number] = F.col(number) + F.col("__t_n")
    keep = [*df.columns, *before, *upto, *lowest, *([number] if number else [])]
    return out.withColumns(cols).select(*keep)
