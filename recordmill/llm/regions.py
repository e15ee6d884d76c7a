"""Exact similarity joins inside overlapping regions, by pivots and their balls."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import materialize
from recordmill.llm.components import components

#: Rounds of pivots before the pairs that are left, and kinds of regions that choose pivots apart.
STARS = 2
KINDS = 4


def links_in_regions(
    members: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    radius: float,
    window: bool,
    fits: Callable[[str, str], Column],
    extra: tuple[str, ...] = (),
    info: DataFrame | None = None,
    sharper: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """Links that connect exactly what all links within ``radius`` connect: columns ``a, b``.

    ``members`` has distinct ``region, item`` and the columns ``extra`` of the item; an item may be
    in many regions. ``measure`` takes distinct pairs ``a, b`` and returns them with their
    distance ``d``. ``fits(x, y)`` is a cheap necessary condition on columns with these prefixes,
    ``sharper`` another one on the columns of ``info``, a table of all items by ``item``, that
    is joined only to what is left.

    In a round every region measures its members against a pivot. Members of a pivot's ball are
    connected through it, and pairs inside one component need no look, so families of copies
    cost a few pairs each. What is left after the rounds are pairs of a region whose ends are not yet
    connected and, in a metric (``window``), not ruled out by the triangle inequality: their
    distances from the pivot differ by at most ``radius``. Those are measured, all of them.
    """
    cols = ["item", *extra]
    rows = members.select("region", *cols, F.col("item").alias("root"))
    links: list[DataFrame] = []
    every = lambda: reduce(DataFrame.unionByName, links)

    def ordered(pairs: DataFrame, sharpen: bool = False) -> DataFrame:
        if sharpen and info is not None:
            pairs = pairs.select("a_item", "b_item").distinct()
            for x in ("a_", "b_"):
                pairs = pairs.join(info.select(*[F.col(c).alias(x + c) for c in info.columns]), x + "item")
            pairs = pairs.where(sharper("a_", "b_"))
        return pairs.select(F.greatest("a_item", "b_item").alias("a"), F.least("a_item", "b_item").alias("b")).distinct()

    def side(table: DataFrame, name: str, *more: str) -> list[Column]:
        return [F.col(c).alias(f"{name}_{c}") for c in (*cols, "root", *more)]

    for number in range(STARS):
        turn = F.xxhash64(F.col("item"), F.pmod("region", F.lit(KINDS)), F.lit(number))
        pivots = rows.groupBy("region").agg(F.min_by(F.struct(*cols, "root"), turn).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"))
        pivots = pivots.where("lo <> hi" + (" and m > 2" if number else "")).select("region", *[F.col(f"p.{c}").alias("b_" + c) for c in (*cols, "root")])
        held = materialize(rows.drop(*[c for c in rows.columns if c not in ("region", *cols, "root")]).join(pivots, "region"), "regions")
        star = held.where("root <> b_root").select(*side(held, "a"), *[F.col(f"b_{c}") for c in cols])
        tested = materialize(measure(ordered(star.where(fits("a_", "b_")), True)), "measured")
        links.append(tested.where(F.col("d") <= radius).select("a", "b"))
        roots = components(every())
        known = tested.select(F.col("a").alias("x"), F.col("b").alias("y"), "d")
        rows = (
            held.drop("root")
            .withColumn("x", F.greatest("item", "b_item")).withColumn("y", F.least("item", "b_item"))
            .join(known, ["x", "y"], "left")
            .join(roots.select(F.col("node").alias("item"), "root"), "item", "left")
            .select("region", *cols, F.coalesce("root", "item").alias("root"), F.when(F.col("item") == F.col("b_item"), 0.0).otherwise(F.col("d")).alias("d"))
        )
        rows = materialize(rows, "rows")
    split = rows.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"))
    left = rows.join(split.where("lo <> hi and m > 2").select("region"), "region")
    if info is not None:
        left = left.join(info.drop(*extra), "item")
        cols += [c for c in info.columns if c not in cols]
    left = materialize(left, "open")
    cond = (F.col("a_item") > F.col("b_item")) & (F.col("a_root") != F.col("b_root")) & fits("a_", "b_")
    if info is not None:
        cond &= sharper("a_", "b_")
    if window:
        cond &= F.coalesce(F.abs(F.col("a_d") - F.col("b_d")) <= radius + 1e-9, F.lit(True))
    a, b = left.select("region", *side(left, "a", "d")), left.select("region", *side(left, "b", "d"))
    late = materialize(measure(ordered(a.join(b, "region").where(cond))), "measured-rest")
    links.append(late.where(F.col("d") <= radius).select("a", "b"))
    return every()
