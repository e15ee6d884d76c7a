"""Bootstrap and permutation by hashed draws.

A draw is ``hash(seed, b, j) mod n`` for every replicate ``b`` and position ``j``. Draws become
weights per (replicate, unit) before they meet any record, so the cost is replicates times units,
not replicates times records. Units are indexed with ``row_numbers``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.nullsafe import attach
from recordmill.functions.bind import let
from recordmill.functions.hashing import hash_key
from recordmill.operators import metrics
from recordmill.operators.ordering import running
from recordmill.operators.ranks import rank_table
from recordmill.session import materialize


#: Rows times replicates that are worked on at once where replicates go in turns.
TURN_ROWS = 1 << 25


def turns(rows: int, n: int) -> Iterator[range]:
    """The replicates 0 to ``n - 1`` in turns of at most ``TURN_ROWS`` rows, one replicate at least."""
    step = max(1, min(n, TURN_ROWS // max(1, rows)))
    return (range(at, min(at + step, n)) for at in range(0, n, step))


def replicates(df: DataFrame, n: int, key: Sequence[str], out: str = "b", first: int = 0) -> DataFrame:
    """Every row once per replicate, from number ``first`` on. Rows are spread by key first, before they multiply."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(parts, *key)
    return spread.withColumn(out, F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))


def unit_index(units: DataFrame, cells: Sequence[str], key: Sequence[str]) -> DataFrame:
    """0-based ``idx`` in key order inside each cell and the number of units ``n_units``."""
    placed = running(units, cells, [F.asc(k) for k in key], number="idx", size="n_units", store=True)
    return placed.withColumn("idx", F.col("idx") - 1)


def draw_weights(
    units: DataFrame, cells: Sequence[str], key: Sequence[str], n_boot: int, seed: int
) -> DataFrame:
    """``(cells, b, key, w)``: how often each unit is drawn with replacement in each replicate.

    Unit ``j`` of the index also issues draw ``j``, so the draws come from the index table itself.
    Each replicate draws exactly ``n_units`` times.
    """
    indexed = unit_index(units, cells, key)
    drawn = F.pmod(hash_key(seed, "b", "idx"), F.col("n_units"))
    weights = (
        replicates(indexed.select(*cells, "idx", "n_units"), n_boot, [*cells, "idx"])
        .select(*cells, "b", drawn.alias("idx"))
        .groupBy(*cells, "b", "idx")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    return attach(weights, indexed.select(*cells, *key, "idx"), [*cells, "idx"]).select(
        *cells, "b", *key, "w"
    )


#: Cells (units x replicates) of one block of counted draws, and the room a task has for sums of equal scores.
BLOCK_CELLS = 1 << 21
HELD_BYTES = 64 << 20


def _counted_draws(units: DataFrame, cells: Sequence[str], key: Sequence[str], n_boot: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The units with their place among all (``slot``), and ``slot, ws``: draws of a place in every replicate, as 16-bit counts.

    The draws are those of :func:`draw_weights`. They travel as packed numbers to the block of places they fall into.
    """
    indexed = unit_index(units, cells, key)
    if cells:
        sizes = indexed.groupBy(*cells).agg(F.max("n_units").alias("size"))
        offsets = running(sizes, [], [F.asc(c) for c in cells], before={"offset": "size"}, store=True).drop("size")
        indexed = attach(indexed, offsets, cells)
    else:
        indexed = indexed.withColumn("offset", F.lit(0).cast("bigint"))
    indexed = indexed.withColumn("slot", F.col("offset") + F.col("idx"))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: F.col("offset") + F.pmod(hash_key(seed, b, "idx"), F.col("n_units")))
    drawn = indexed.repartition(parts, "slot").select(target.alias("t"))
    width = max(1, BLOCK_CELLS // n_boot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(0).flatten().to_numpy()
            if not len(slots):
                continue
            place = (slots % width) * n_boot + np.arange(len(slots)) % n_boot
            block = slots // width
            order = np.argsort(block, kind="stable")
            names, at = np.unique(block[order], return_index=True)
            packed = place[order].astype(np.uint32)
            blobs = [packed[x:y].tobytes() for x, y in zip(at, [*at[1:], len(packed)])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["block", "draws"])

    def count(key: tuple, held: pa.Table) -> pa.Table:
        counts = np.zeros(width * n_boot, np.int64)
        for blob in held.column(1):
            np.add.at(counts, np.frombuffer(blob.as_buffer(), np.uint32), 1)
        counts = np.minimum(counts, 65_535).astype("<u2").reshape(width, n_boot)
        hit = np.flatnonzero(counts.any(axis=1))
        return pa.table([pa.array(key[0].as_py() * width + hit, pa.int64()), pa.array([counts[k].tobytes() for k in hit], pa.binary())], ["slot", "ws"])

    packed = drawn.mapInArrow(pack, "block bigint, draws binary")
    return indexed, packed.groupBy("block").applyInArrow(count, "slot bigint, ws binary")


def _unit_weights(units: DataFrame, cells: Sequence[str], key: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    indexed, counted = _counted_draws(units, cells, key, n_boot, seed)
    return indexed.select(*cells, *key, "slot").join(counted, "slot").drop("slot")


def weight_arrays(units: DataFrame, cells: Sequence[str], key: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """``(cells, key, ws)``: how often each unit is drawn in replicates 0, 1, ..., as one array.

    The draws are those of :func:`draw_weights`; units drawn in no replicate are left out.
    """

    @F.pandas_udf("array<int>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<u2").astype(np.int32) for b in blobs], dtype=object)

    return _unit_weights(units, cells, key, n_boot, seed).withColumn("ws", unpack("ws"))


def weighted_auc(counts: DataFrame, cells: Sequence[str], n_boot: int) -> DataFrame:
    """AUC per (cells, b) of rows ``(cells, score, p, n, ws)``; cells with one class in a replicate have null.

    Rows are ordered once, by (cell, score), whatever the number of replicates. Each range slice keeps running sums of
    all replicates as arrays and returns one row a cell, and a cell's slices are put together in order.
    """
    spark = counts.sparkSession
    kinds = dict(counts.dtypes)
    names = ", ".join(f"`{c}` {kinds[c]}" for c in cells)
    lead = f"{names}, " if cells else ""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for every (cell, score) that a task meets."""
        for batch in batches:
            types = [f.type for f in batch.schema][: len(cells) + 1]
            sums: dict[tuple, np.ndarray] = {}
            columns = [c.to_pylist() for c in batch.columns]
            for *name, p, n, ws in zip(*columns):
                w = np.frombuffer(ws, "<u2").astype(float)
                part = np.concatenate([w * p, w * n])
                key = tuple(name)
                if key in sums:
                    sums[key] += part
                else:
                    sums[key] = part
                if len(sums) * 16 * n_boot > HELD_BYTES:
                    yield packed(sums, types)
                    sums = {}
            if sums:
                yield packed(sums, types)

    def packed(sums: dict[tuple, np.ndarray], types: list) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*sums), types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in sums.values()], pa.binary())], [*cells, "score", "pn"])

    score = F.col("score").cast("double").alias("score")
    rows = counts.select(*cells, score, F.col("p").cast("double"), F.col("n").cast("double"), "ws").mapInArrow(add_up, f"{lead}score double, pn binary")
    rows = materialize(rows, "weighted")
    order = [*cells, "score"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cell: positives, negatives, and pairs won inside the slice (ties count one half), by replicate."""
        cell = at = None
        same = np.zeros(2 * n_boot)
        total = np.zeros((3, n_boot))

        def settle() -> None:
            p, n = same[:n_boot], same[n_boot:]
            total[2] += p * (total[1] + n / 2)
            total[0] += p
            total[1] += n
            same[:] = 0

        for batch in batches:
            types = [f.type for f in batch.schema][: len(cells)]
            columns = [c.to_pylist() for c in batch.columns]
            done = []
            for *name, s, pn, number in zip(*columns):
                if cell is None or name != cell:
                    if cell is not None:
                        settle()
                        done.append((*cell, number, total.tobytes()))
                        total[:] = 0
                    cell, at = name, s
                elif s != at:
                    settle()
                    at = s
                same += np.frombuffer(pn, float)
                last = number
            if done:
                yield found(done, types)
        if cell is not None:
            settle()
            yield found([(*cell, last, total.tobytes())], types)

    def found(done: list[tuple], types: list) -> pa.RecordBatch:
        kinds_here = [*types, pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds_here)], [*cells, "slice", "sums"])

    def together(key: tuple, held: pa.Table) -> pa.Table:
        total, won = np.zeros((2, n_boot)), np.zeros(n_boot)
        pieces = sorted(zip(held.column("slice").to_pylist(), held.column("sums").to_pylist()))
        for _, raw in pieces:
            p, n, inside = np.frombuffer(raw, float).reshape(3, n_boot)
            won += inside + p * total[1]
            total += [p, n]
        pairs = total[0] * total[1]
        auc = [float(w / x) if x > 0 else None for w, x in zip(won, pairs)]
        columns = [pa.array([k.as_py()] * n_boot, held.schema.field(c).type) for k, c in zip(key, cells)]
        return pa.table([*columns, pa.array(range(n_boot), pa.int32()), pa.array(auc, pa.float64())], [*cells, "b", "auc"])

    summed = ranged.mapInArrow(slices, f"{lead}slice int, sums binary")
    if cells:
        return summed.groupBy(*cells).applyInArrow(together, f"{lead}b int, auc double")
    return summed.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda key, held: together((), held), "b int, auc double")


def bootstrap_auc(
    records: DataFrame, cells: Sequence[str], unit: Sequence[str], score: str, label: str,
    n_boot: int, seed: int,
) -> DataFrame:
    """AUC per (cell, replicate) over resampled units with all of their rows.

    Rows with equal score inside a unit are one row, which carries the weights of its unit in all replicates as an
    array. Replicates with one class are left out.
    """
    compact = metrics.score_counts(records, [*cells, *unit], score, label)
    weights = _unit_weights(records.select(*cells, *unit).distinct(), cells, unit, n_boot, seed)
    joined = attach(compact, weights, [*cells, *unit]).select(*cells, "score", "p", "n", "ws")
    return weighted_auc(joined, cells, n_boot).where(F.col("auc").isNotNull()).select(*cells, "b", "auc")


def interval(
    values: DataFrame, cells: Sequence[str], value: str, low: float = 0.025, high: float = 0.975,
    against: float = 0.5,
) -> DataFrame:
    """Mean, percentile interval and share above a constant; one row per replicate goes in."""
    v = F.col(value)
    return values.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(low)).alias("ci_low"),
        F.percentile(v, F.lit(high)).alias("ci_high"),
        F.avg((v > against).cast("int")).alias("p_above"),
    )


def paired_difference(
    records: DataFrame, cells: Sequence[str], unit: Sequence[str], score_a: str, score_b: str,
    label: str, n_boot: int, seed: int,
) -> DataFrame:
    """AUC(a) - AUC(b) per replicate on the same draws.

    Both scores become rows of one long table, so the draws are made and joined once.
    """
    long = records.select(
        *cells, *unit, label, F.col(score_a).alias("a"), F.col(score_b).alias("b_score")
    ).withColumn(
        "s",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("a").cast("double").alias("v")),
                F.struct(F.lit("b").alias("side"), F.col("b_score").cast("double").alias("v")),
            )
        ),
    ).select(*cells, *unit, label, F.col("s.side").alias("side"), F.col("s.v").alias("v"))
    compact = metrics.score_counts(long, [*cells, *unit, "side"], "v", label)
    weights = _unit_weights(records.select(*cells, *unit).distinct(), cells, unit, n_boot, seed)
    joined = attach(compact, weights, [*cells, *unit]).select(*cells, "side", "score", "p", "n", "ws")
    per = weighted_auc(joined, [*cells, "side"], n_boot).where("auc is not null")
    both = per.groupBy(*cells, "b").agg(
        F.max(F.when(F.col("side") == "a", F.col("auc"))).alias("auc_a"),
        F.max(F.when(F.col("side") == "b", F.col("auc"))).alias("auc_b"),
    )
    return both.where("auc_a is not null and auc_b is not null").withColumn(
        "delta", F.col("auc_a") - F.col("auc_b")
    )


def bootstrap_classes(
    df: DataFrame, key: Sequence[str], truth: str, predicted: str, n_boot: int, seed: int
) -> DataFrame:
    """Confusion counts ``(b, y, q, w)`` of row bootstraps, without joining draws to rows.

    Rows sorted by (true, predicted) class form intervals of the row index. A draw falls into an
    interval, and only the interval matters. Every row issues one draw per replicate, and the
    draws are summed where they are made.
    """
    sizes = df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("q")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # The confusion matrix is bounded by the class vocabulary and travels as one array.
    packed = sizes.agg(F.array_sort(F.collect_list(F.struct("y", "q", "n"))).alias("a")).select(
        F.struct(
            F.transform(
                "a",
                lambda e, i: F.struct(
                    e["y"].alias("y"), e["q"].alias("q"),
                    F.aggregate(F.slice("a", 1, i + 1), F.lit(0).cast("bigint"), lambda s, v: s + v["n"]).alias("upto"),
                ),
            ).alias("cells"),
            F.aggregate("a", F.lit(0).cast("bigint"), lambda s, v: s + v["n"]).alias("total"),
        ).alias("m")
    )
    rows = replicates(df.select(*key), n_boot, key).withColumn("m", packed.scalar())
    idx = F.pmod(hash_key(seed, "b", *key), F.col("m.total"))
    hit = let(lambda v: F.element_at(F.filter("m.cells", lambda e: e["upto"] > v["i"]), 1), i=idx)
    return (
        rows.select("b", hit.alias("c"))
        .groupBy("b", F.col("c.y").alias("y"), F.col("c.q").alias("q"))
        .agg(F.count(F.lit(1)).alias("w"))
    )


#: Bits by which hashes of a large cell are counted before single ones are looked at.
RADIX_BITS = 10
HASH_BITS = 60


def selected_sums(
    rows: DataFrame, cells: Sequence[str], key: Sequence[str], value: str, size: str, take: str, n_perm: int, seed: int
) -> DataFrame:
    """``(cells, b, chosen)``: sum of ``value`` over the ``take`` rows of a cell that come first in the hash order of replicate b.

    ``size`` and ``take`` are the cell's rows and how many of them are chosen. The order is that of ``hash_key(seed, b, key)``, then of
    the key. The hashes of a cell are counted by their leading bits; all rows below the part in which the last
    chosen one lies are added up there, and only the rows of that part are ordered.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # about 64 rows to a part; small cells have one
    bits = F.greatest(F.lit(0), F.least(F.lit(RADIX_BITS), F.floor(F.log2(F.greatest(F.col(size), F.lit(64)) / 64)).cast("int")))
    base = rows.select(*cells, *key, F.col(value).alias("__v"), F.col(take).cast("bigint").alias("__k"), bits.alias("__bits"))
    base = materialize(base.repartition(parts, *key), "selection")
    part = lambda h: F.call_function("shiftrightunsigned", h, HASH_BITS - F.col("__bits"))
    steps = F.sequence(F.lit(0), F.lit(n_perm - 1))
    each = base.select(*cells, *key, "__v", "__k", "__bits", F.explode(steps).alias("b"))
    counted = each.withColumn("__part", part(hash_key(seed, "b", *key))).groupBy(*cells, "b", "__k", "__part").agg(
        F.count(F.lit(1)).alias("m"), F.sum("__v").alias("sv")
    )
    # at most 2 ** RADIX_BITS rows to a window
    before = W.partitionBy(*cells, "b").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumns({"below": F.coalesce(F.sum("m").over(before), F.lit(0)), "sum_below": F.coalesce(F.sum("sv").over(before), F.lit(0))})
    last = materialize(counted.where("below < __k and below + m >= __k").select(*cells, "b", "__part", (F.col("__k") - F.col("below")).alias("need"), "sum_below"), "last-parts")
    # the parts of all replicates of a cell as one array, so that rows meet them once
    by_cell = last.groupBy(*cells).agg(F.map_from_entries(F.collect_list(F.struct("b", "__part"))).alias("__last"))
    near = attach(base, by_cell, cells) if cells else with_row(base, by_cell)
    near = near.select(
        *cells, *key, "__v",
        F.explode(F.filter(
            F.transform(steps, lambda b: F.struct(b.alias("b"), hash_key(seed, b, *key).alias("h"))),
            lambda e: part(e["h"]) == F.element_at("__last", e["b"]),
        )).alias("e"),
    ).select(*cells, *key, "__v", "e.b", "e.h")
    placed = near.withColumn("__at", F.row_number().over(W.partitionBy(*cells, "b").orderBy("h", *key)))
    chosen = attach(placed, last.select(*cells, "b", "need"), [*cells, "b"]).where("__at <= need")
    extra = chosen.groupBy(*cells, "b").agg(F.sum("__v").alias("extra"))
    return attach(last.select(*cells, "b", "sum_below"), extra, [*cells, "b"]).select(*cells, "b", (F.col("sum_below") + F.col("extra")).alias("chosen"))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row."""
    names = one.columns
    row = one.select(F.struct(*names).alias("__one")).scalar()
    return df.withColumn("__one", row).withColumns({c: F.col(f"__one.{c}") for c in names}).drop("__one")


def permutation_auc(
    units: DataFrame, cells: Sequence[str], key: Sequence[str], score: str, label: str,
    n_perm: int, seed: int,
) -> DataFrame:
    """Observed AUC and how often a label permutation reaches it.

    A permutation gives the positives to the units first in hash order. Its AUC follows from the
    sum of their average ranks, and the ranks do not change between permutations, so the units are selected, not sorted.
    """
    clean = units.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranks = rank_table(clean, cells, score).select(*cells, score, F.col("avg_rank").alias("__rank"))
    ranked = materialize(attach(clean.select(*cells, *key, score, label), ranks, [*cells, score]), "ranked")
    totals = ranked.groupBy(*cells).agg(
        F.sum(label).cast("bigint").alias("n_pos"), F.sum(1 - F.col(label)).cast("bigint").alias("n_neg"),
        F.sum(F.when(F.col(label) == 1, F.col("__rank"))).alias("__s"),
    )
    totals = materialize(totals, "totals")

    def auc(rank_sum: Column) -> Column:
        n, m = F.col("n_pos"), F.col("n_neg")
        return F.round((rank_sum - n * (n + 1) / 2) / F.nullif(n * m, F.lit(0)), 12)

    def with_totals(df: DataFrame) -> DataFrame:
        return attach(df, totals, cells) if cells else with_row(df, totals)

    rows = with_totals(ranked.select(*cells, *key, "__rank")).withColumn("__n", F.col("n_pos") + F.col("n_neg"))
    drawn = selected_sums(rows, cells, key, "__rank", "__n", "n_pos", n_perm, seed)
    if cells:
        each = totals.select(*cells, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("b"))
    else:
        each = totals.select(F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("b"))
    # a cell without positives chooses nobody: its permutations count, their AUC is null
    conditions = [F.col("b") == F.col("__b"), *[F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(cells)]]
    renamed = drawn.select(F.col("b").alias("__b"), "chosen", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(cells)])
    drawn = each.join(renamed, conditions, "left").select(*cells, "b", "chosen")
    joined = with_totals(drawn).select(*cells, "n_pos", "n_neg", "b", auc(F.col("__s")).alias("auc"), auc(F.col("chosen")).alias("perm"))
    out = joined.groupBy(*cells, "n_pos", "n_neg", "auc").agg(
        F.count(F.when(F.col("perm") >= F.col("auc"), 1)).alias("n_reached"),
        F.count(F.lit(1)).alias("n_perm"),
    )
    return out.withColumn("p_plain", F.col("n_reached") / F.col("n_perm")).withColumn(
        "p_value", (F.col("n_reached") + 1) / (F.col("n_perm") + 1)
    )


def set_permutation(
    items: DataFrame, key: Sequence[str], in_set: str, value: str, n_perm: int, seed: int
) -> DataFrame:
    """Mean of a set minus mean of the rest against random sets of the same size, selected by hash."""
    base = items.select(*key, F.col(value).cast("double").alias("__v"), F.col(in_set).cast("int").alias("__in"))
    base = materialize(base, "items")
    sums = base.agg(
        F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum("__in"), F.lit(0)).alias("__k"), F.sum("__v").alias("__all"),
        F.sum(F.when(F.col("__in") == 1, F.col("__v"))).alias("__own"),
    )

    def gap(chosen: str) -> Column:
        return F.col(chosen) / F.col("__k") - (F.col("__all") - F.col(chosen)) / F.nullif(F.col("__n") - F.col("__k"), F.lit(0))

    rows = with_row(base, sums)
    drawn = selected_sums(rows, [], key, "__v", "__n", "__k", n_perm, seed)
    drawn = with_row(drawn, sums)
    per = drawn.select(gap("chosen").alias("null_stat"), gap("__own").alias("stat"))
    reached = F.abs(F.round("null_stat", 9)) >= F.abs(F.round("stat", 9))
    return per.agg(
        F.max("stat").alias("stat"), F.avg("null_stat").alias("null_mean"),
        F.count(F.when(reached, 1)).alias("n_reached"), F.count(F.lit(1)).alias("n_perm"),
    ).withColumn("p_value", F.col("n_reached") / F.col("n_perm"))
