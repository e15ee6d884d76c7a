"""Deterministic splits, folds and samples.

Everything is decided by a hash of (seed, key), so a rerun, another cluster or another engine gives
the same split. Positions inside a stratum come from ``row_numbers``, which handles a stratum that
holds a large share of all rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.functions.nullsafe import attach
from recordmill.functions.hashing import hash_key
from recordmill.operators import ordering
from recordmill.operators.ordering import row_numbers, running
from recordmill.operators.ranks import top_k
from recordmill.session import materialize


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def hash_positions(
    df: DataFrame, strata: Sequence[str], seed: int | Column, key: Sequence[str], out: str = "pos"
) -> DataFrame:
    """1-based position in hash order inside each stratum, and the stratum size ``<out>_n``."""
    hashed = df.withColumn("__h", hash_key(seed, *key))
    return running(hashed, strata, [F.asc("__h"), *[F.asc(k) for k in key]], number=out, size=f"{out}_n").drop("__h")


def cut(position: Column, size: Column, parts: Sequence[tuple[str, float]]) -> Column:
    """Name of the part a position falls into; parts take rounded shares in order."""
    out, share = None, 0.0
    for name, fraction in parts[:-1]:
        share += fraction
        cond = position <= half_up(size * F.lit(round(share, 12)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(parts[-1][0]) if out is not None else F.lit(parts[0][0])


def split_stratified(
    df: DataFrame, domain: str, label: str, key: Sequence[str], holdouts: Sequence[str],
    train: float = 0.7, seed: int = 42,
) -> DataFrame:
    """Whole holdout domains; the rest train/val/test.

    Training rows are drawn per (domain, label); what is left is halved per label only. A null
    domain or label is a stratum of its own, so every row is in exactly one side.
    """
    held = F.concat(F.lower(F.col(domain)), F.lit("_holdout"))
    outside = F.coalesce(F.col(domain).isin(*holdouts), F.lit(False))  # a null domain is none of them
    out_rows = df.where(outside).withColumn("split", held)
    rest = df.where(~outside)
    first = hash_positions(rest, [domain, label], seed, key)
    is_train = F.col("pos") <= half_up(F.col("pos_n") * F.lit(train))
    train_rows = first.where(is_train).select(*df.columns).withColumn("split", F.lit("train"))
    second = hash_positions(first.where(~is_train).select(*df.columns), [label], seed + 1, key)
    halves = second.withColumn(
        "split", cut(F.col("pos"), F.col("pos_n"), [("val", 0.5), ("test", 0.5)])
    ).select(*df.columns, "split")
    return out_rows.unionByName(train_rows).unionByName(halves)


def with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def split_halves(
    df: DataFrame, strata: Sequence[str], key: Sequence[str], seeds: Sequence[int],
    test_share: float = 0.5,
) -> DataFrame:
    """val/test halves of the rows, stratified, once per seed (column ``seed``)."""
    placed = hash_positions(with_seeds(df, seeds), ["seed", *strata], F.col("seed"), key)
    parts = [("val", 1 - test_share), ("test", test_share)]
    return placed.withColumn("split", cut(F.col("pos"), F.col("pos_n"), parts)).drop("pos", "pos_n")


def split_grouped(
    records: DataFrame, group: Sequence[str], strata: Sequence[str], seeds: Sequence[int],
    test_share: float = 0.5,
) -> DataFrame:
    """Whole groups go to val or test; ``strata`` must be constant inside a group."""
    own = [s for s in strata if s not in group]
    groups = records.groupBy(*group).agg(*[F.max(s).alias(s) for s in own]) if own else records.select(*group).distinct()
    sides = split_halves(groups, strata, group, seeds, test_share)
    return attach(records, sides.select(*group, "seed", "split"), group)


def kfold_stratified(df: DataFrame, strata: Sequence[str], key: Sequence[str], k: int, seed: int) -> DataFrame:
    placed = hash_positions(df, strata, seed, key)
    return placed.withColumn("fold", F.pmod(F.col("pos") - 1, F.lit(k)).cast("int")).drop("pos", "pos_n")


def kfold_grouped(records: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Fold per group: groups by size descending, dealt to the folds in snake order."""
    sizes = records.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    placed = row_numbers(sizes, [], [F.desc("group_size"), *[F.asc(g) for g in group]], "pos")
    turn = F.pmod(F.col("pos") - 1, F.lit(2 * k))
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int")
    return placed.select(*group, "group_size", fold.alias("fold"))


def leaking_groups(df: DataFrame, group: Sequence[str], split: str = "split") -> DataFrame:
    """Groups found in more than one split."""
    return (
        df.groupBy(*group)
        .agg(F.min(split).alias("low"), F.max(split).alias("high"))
        .where("low <> high")
    )


def sample_per_stratum(df: DataFrame, strata: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per stratum, the first in hash order."""
    hashed = df.withColumn("__h", hash_key(seed, *key))
    return top_k(hashed, strata, n, [F.asc("__h"), *[F.asc(k) for k in key]], "__r").drop("__h", "__r")


#: Columns that a task holds for a whole part have one of these types, so that its rows bound its size.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def shuffle_values(
    df: DataFrame, part: Sequence[str], key: Sequence[str], value: str, seed: int, out: str
) -> DataFrame:
    """Permute a column inside each part: the value at a position of one hash order goes to the row at that position of another.

    Parts that a window may hold are sent to one task each, once, and put in order there. Rows of larger parts, or of unbounded width,
    and their values are numbered apart and merged, as rows that were multiplied before look small to the planner, which
    would send one side to all tasks by way of the driver.
    """
    narrow = all(isinstance(f.dataType, FIXED_WIDTH) for f in df.schema if f.name not in part)
    if part and narrow:
        largest = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= ordering.PLAIN_WINDOW_ROWS:
            hashed = df.withColumns({"__h0": hash_key(seed, *key), "__h1": hash_key(seed + 1, *key)})
            schema = T.StructType([*df.schema.fields, T.StructField(out, df.schema[value].dataType)])
            return hashed.groupBy(*part).applyInArrow(lambda held: _shuffled(held, key, value, out), schema)
    rows = hash_positions(df, part, seed, key, "__to").drop("__to_n")
    values = hash_positions(df, part, seed + 1, key, "__to").select(
        *part, "__to", F.col(value).alias(out)
    )
    return attach(rows, values.hint("merge"), [*part, "__to"]).drop("__to")


def _shuffled(held: pa.Table, key: Sequence[str], value: str, out: str) -> pa.Table:
    """The rows of one part with the value that the second hash order has where the first has the row."""

    def order(h: str) -> np.ndarray:
        hashes = held[h].to_numpy()
        at = np.argsort(hashes, kind="stable")
        if (hashes[at[1:]] == hashes[at[:-1]]).any():
            at = pc.sort_indices(held, [(c, "ascending") for c in (h, *key)], null_placement="at_start").to_numpy()
        return at

    taken = np.empty(held.num_rows, np.int64)
    taken[order("__h0")] = order("__h1")
    return held.drop_columns(["__h0", "__h1"]).append_column(out, held[value].combine_chunks().take(pa.array(taken)))


def domain_combinations(domains: Sequence[str], sizes: Sequence[int]) -> list[tuple[str, ...]]:
    return [c for k in sizes for c in combinations(sorted(domains), k)]


def train_roles(domains_df: DataFrame, domain: str, combos: Sequence[Sequence[str]]) -> DataFrame:
    """Each domain row once per training combination, with its role."""
    sets = F.array(*[F.array(*[F.lit(d) for d in c]) for c in combos])
    out = domains_df.withColumn("train_set", F.explode(sets))
    role = F.when(F.array_contains("train_set", F.col(domain)), "train").otherwise("eval")
    return out.withColumn("role", role).withColumn("train_set", F.array_join("train_set", "+"))


# Balanced grouped split by random search

PRIME = (1 << 31) - 1


def trial_side(trial: Column, group_hash: Column, seed: int, targets: dict[str, float]) -> Column:
    """Name of the side a group takes in a trial, from a linear map of its hash modulo a prime.

    ``group_hash`` is below ``PRIME``; the two coefficients of the map are hashes of the trial.
    """
    scale = F.pmod(hash_key(seed, F.lit("scale"), trial), F.lit(PRIME - 1)) + 1
    shift = F.pmod(hash_key(seed, F.lit("shift"), trial), F.lit(PRIME))
    return cut(F.pmod(group_hash * scale + shift, F.lit(PRIME)), F.lit(PRIME), list(targets.items()))


#: Groups and trials that a task scores at once.
GROUP_STEP, TRIAL_STEP = 4096, 512


def _score_trials(groups: DataFrame, domain: str, counts: list[str], targets: dict[str, float], trials: int, seed: int):
    """Class counts of every (side, trial), whether the side has all domains, and the class counts of all groups.

    A group is never multiplied by the trials: each task keeps arrays of all trials and adds its groups to them. Domains travel as
    one bit a trial.
    """

    def draw(what: str, modulus: int) -> np.ndarray:
        key = lambda t: int(hashlib.md5(f"{seed}:{what}:{t}".encode()).hexdigest()[:15], 16)
        return np.array([key(t) % modulus for t in range(trials)], np.int64)

    scale, shift = draw("scale", PRIME - 1) + 1, draw("shift", PRIME)
    # the upper ends of the sides, as :func:`cut` draws them
    ends, share = [], 0.0
    for fraction in list(targets.values())[:-1]:
        share += fraction
        ends.append(int(np.floor(PRIME * round(share, 12) + 0.5)))
    n_sides, k = len(targets), len(counts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_sides, trials, k))
        present: dict = {}
        for batch in batches:
            where = np.array(batch.column(0).to_pylist(), object)
            hashes = batch.column(1).to_numpy()
            c = np.stack([col.to_numpy() for col in batch.columns[2:]], axis=1).astype(float)
            for g in range(0, len(hashes), GROUP_STEP):
                part = slice(g, g + GROUP_STEP)
                held = [(d, np.flatnonzero([x == d for x in where[part]])) for d in set(where[part].tolist())]
                for t in range(0, trials, TRIAL_STEP):
                    some = slice(t, t + TRIAL_STEP)
                    place = (hashes[part, None] * scale[None, some] + shift[None, some]) % PRIME
                    side = np.searchsorted(ends, place.ravel(), "left").reshape(place.shape)
                    for s in range(n_sides):
                        mask = side == s
                        sums[s, some] += mask.T.astype(float) @ c[part]
                        for d, rows in held:
                            seen = present.setdefault(d, np.zeros((n_sides, trials), bool))
                            seen[s, some] |= mask[rows].any(axis=0)
        if present:
            domains = list(present)
            blobs = [np.packbits(present[d], axis=1).tobytes() for d in domains]
            kind = batch.schema.field(0).type
            columns = [pa.array([None, *domains], kind), pa.array([True, *[False] * len(domains)]), pa.array([sums.tobytes(), *blobs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["domain", "total", "blob"])

    def merge(key: tuple, held: pa.Table) -> pa.Table:
        blobs = held.column("blob").to_pylist()
        if held.column("total")[0].as_py():
            out = sum(np.frombuffer(x, float) for x in blobs).tobytes()
        else:
            out = functools.reduce(np.bitwise_or, [np.frombuffer(x, np.uint8) for x in blobs]).tobytes()
        return pa.table([held.column("domain")[:1], held.column("total")[:1], pa.array([out], pa.binary())], ["domain", "total", "blob"])

    def all_domains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trials and sides that every domain of a task's rows is in."""
        both = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                bits = np.frombuffer(x, np.uint8)
                both = bits if both is None else both & bits
        if both is not None:
            yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], ["blob"])

    kind = dict(groups.dtypes)[domain]
    scored = groups.select(F.col(domain), F.col("__h").cast("bigint"), *[F.col(c).cast("bigint") for c in counts]).mapInArrow(partial, f"domain {kind}, total boolean, blob binary")
    merged = materialize(scored.groupBy("domain", "total").applyInArrow(merge, f"domain {kind}, total boolean, blob binary"), "trials")
    # of fixed size: one row of sums, and at most one row of bits for each partition
    sums = np.frombuffer(merged.where("total").first()["blob"], float).reshape(n_sides, trials, k)
    bits = [np.frombuffer(r.blob, np.uint8) for r in merged.where("not total").select("blob").mapInArrow(all_domains, "blob binary").collect()]
    covered = np.unpackbits(functools.reduce(np.bitwise_and, bits).reshape(n_sides, -1), axis=1)[:, :trials].astype(bool)
    return sums, covered, sums[:, 0].sum(axis=0)


def balanced_search(
    records: DataFrame, group: Sequence[str], domain: str, cls: str, classes: Sequence[int],
    targets: dict[str, float], minimum: Sequence[int], trials: int, seed: int = 42,
) -> tuple[DataFrame, float]:
    """Grouped split with the smallest deviation from the targets over random assignments.

    In each trial every group takes a side by its hash, with the target shares as probabilities.
    The deviation adds the differences between shares and targets of all sides, and between
    class shares of a side and of all rows for every side but the first. Sides but the first must
    have at least ``minimum`` rows of each class and a group of each domain. Trials are scored as
    arrays, so any number of groups works by the same rule; ties go to the smaller trial.
    Returns (group columns, split) and the deviation of the winner.
    """
    counts = [f"c{i}" for i in range(len(classes))]
    groups = records.groupBy(*group).agg(
        *[F.count(F.when(F.col(cls) == c, 1)).alias(n) for c, n in zip(classes, counts)]
    ).withColumn("__h", F.pmod(hash_key(seed, *group), F.lit(PRIME)))
    groups = materialize(groups, "groups")
    names = list(targets)
    sums, covered, totals = _score_trials(groups, domain, counts, targets, trials, seed)
    n = sums.sum(axis=2)
    shares = np.array([targets[x] for x in names])
    with np.errstate(invalid="ignore", divide="ignore"):
        apart = np.abs(n / totals.sum() - shares[:, None])
        classwise = np.abs(sums / n[:, :, None] - totals / totals.sum()).sum(axis=2)
    apart[1:] += classwise[1:]
    fine = ((sums >= np.asarray(minimum, float)).all(axis=2) & covered)[1:].all(axis=0) & (n[1:] > 0).all(axis=0)
    if not fine.any():
        raise ValueError("no trial meets the class and domain minima")
    deviation = np.where(fine, np.round(np.nansum(apart, axis=0), 9), np.inf)
    best = int(deviation.argmin())
    chosen = groups.select(*group, trial_side(F.lit(best), F.col("__h"), seed, targets).alias("split"))
    return chosen, float(deviation[best])
