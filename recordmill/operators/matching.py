"""One-to-one matching of names in three rounds.

Round 1 pairs equal normalised names. Round 2 takes pairs with at least three shared tokens and a
similarity above 0.7, round 3 any remaining pair above 0.6. Similarity is one minus the edit
distance over the longer length. Candidates come from the rarest tokens of each name (round 2) or are all names of
a length that may be similar (round 3); what is kept follows from the round's condition, so no qualifying pair is missed.

Taking the best pair again and again is the same as going down the list of all pairs, so rounds 2 and 3 make the pairs of one
band of the list at a time (the most similar first), and only of names that no earlier band has matched.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.functions.text import levenshtein_ratio, name_tokens, normalize_name
from recordmill.operators.ordering import row_numbers
from recordmill.session import discard, materialize, materialize_counted, new_path

#: Parts to which the names of one length are dealt, so that one common length is no single task's work.
PARTS = 8
#: Similarities down to which the pairs of a band go.
TOKEN_BANDS, EDIT_BANDS = (0.9, 0.8, 0.7), (0.95, 0.9, 0.85, 0.8, 0.7, 0.6)
#: Pairs of which one task takes the best ones in order.
FEW_PAIRS = 1 << 20
#: 64-bit words of the marks of a name, and marks a character has before they fall on those of the next.
MARK_WORDS, MARKS = 3, 5
#: Names with the same set of tokens that a task pairs with others at once.
SET_ROWS = 1024


def _rarest(left: DataFrame, right: DataFrame, keep: Column, *carry: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(key, item, carry, by_rarity)`` of both sides reduced to each key's rarest items; ``by_rarity`` has all of them.

    ``m`` is the number of items of a name and ``keep`` how many of them to keep.
    """
    both = left.select("item").unionAll(right.select("item"))
    df = both.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    # A name is short, so the window per name is bounded.
    w = W.partitionBy("key").orderBy("df", "item")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def prefix(side: DataFrame) -> DataFrame:
        ranked = side.join(df, "item").withColumns({"r": F.row_number().over(w), "by_rarity": F.collect_list("item").over(whole)})
        return ranked.where(F.col("r") <= keep).select("key", "item", *carry, "by_rarity")

    return prefix(left), prefix(right)


def repeats(side: DataFrame) -> bool:
    """Whether a key is null or comes more than once."""
    return not side.groupBy("key").count().where("count > 1 or key is null").isEmpty()


def token_candidates(left: DataFrame, right: DataFrame, min_shared: int = 3, above: float | None = None, repeated: bool | None = None) -> DataFrame:
    """``(l, r, shared)`` for pairs of ``(key, tokens)`` rows with enough tokens in common.

    The test is part of the join, so only pairs that qualify leave it, however common an item is. A pair leaves it where its rarest
    common token is met, and only there; nothing is left to make distinct unless keys repeat. With ``above``, the rows also have ``norm`` and its marks, and
    its similarity must be above it.
    """
    if repeated is None:
        repeated = repeats(left) or repeats(right)
    if above is None and not repeated:
        return _by_sets(left, right, min_shared)
    return _meeting(left, right, min_shared, above, repeated)


def _by_sets(left: DataFrame, right: DataFrame, min_shared: int) -> DataFrame:
    """Names whose tokens are the same, but for those that the other side has not at all, meet others as one; only then pairs are made of them."""
    exploded = [s.where(F.size("tokens") >= min_shared).select("key", F.explode("tokens").alias("item")) for s in (left, right)]
    sides = []
    for side, other in (exploded, exploded[::-1]):
        known = side.join(other.select("item").distinct(), "item", "left_semi")
        known = known.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("tokens")).where(F.size("tokens") >= min_shared)
        known = materialize(known, "known")
        # keys are not null and do not repeat, so the smallest one names the set
        sets = materialize(known.groupBy("tokens").agg(F.min("key").alias("set"), F.count(F.lit(1)).alias("n")), "sets")
        sides.append((sets, known.join(sets, "tokens").select("key", "set", "n")))
    (sets_l, names_l), (sets_r, names_r) = sides
    met = _meeting(*[s.select(F.col("set").alias("key"), "tokens") for s in (sets_l, sets_r)], min_shared, None, False)
    parts = F.ceil(F.col("n") / SET_ROWS)
    met = met.select(F.col("l").alias("set_l"), F.col("r").alias("set_r"), "shared").join(sets_r.select(F.col("set").alias("set_r"), parts.alias("parts")), "set_r")
    met = met.select("set_l", "set_r", "shared", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    a = materialize(met.join(names_l.select(F.col("key").alias("l"), F.col("set").alias("set_l")), "set_l").select("l", "shared", "set_r", "part"), "met")
    b = names_r.select(F.col("key").alias("r"), F.col("set").alias("set_r"), F.pmod(F.xxhash64("key"), parts).alias("part"))
    return a.join(b.hint("merge"), ["set_r", "part"]).select("l", "r", "shared")


def _meeting(left: DataFrame, right: DataFrame, min_shared: int, above: float | None, repeated: bool) -> DataFrame:
    """Candidates from the rarest tokens of each name."""
    named = [] if above is None else ["norm", "marks"]
    sides = [
        s.where(F.size("tokens") >= min_shared).select(
            "key", "tokens", *named, F.size("tokens").alias("m"), F.explode("tokens").alias("item")
        )
        for s in (left, right)
    ]
    carried = "tokens" if repeated else "by_rarity"
    a, b = _rarest(*sides, F.col("m") - (min_shared - 1), *(["tokens"] if repeated else []), *named)
    a = a.select(F.col("key").alias("l"), "item", F.col(carried).alias("x"), *[F.col(c).alias(f"{c}_x") for c in named])
    b = b.select(F.col("key").alias("r"), F.col("item").alias("item_r"), F.col(carried).alias("y"), *[F.col(c).alias(f"{c}_y") for c in named])
    both = F.array_intersect("x", "y")
    shared = F.size(both)
    test = shared >= min_shared
    if not repeated:
        test = test & (F.get(both, F.lit(0)) == F.col("item"))
    if above is not None:
        test = _near(above) & test & (_similarity(above) > above)
    pairs = a.join(b, (F.col("item") == F.col("item_r")) & test).select("l", "r", shared.alias("shared"))
    return pairs.distinct() if repeated else pairs


def marked(side: DataFrame) -> DataFrame:
    """``side`` with the marks of ``norm``: one bit for every n-th occurrence of a character, bits that coincide cancel out.

    An edit changes at most two of them, and one if it also changes the length.
    """

    @F.pandas_udf("array<bigint>")
    def marks(names: pd.Series) -> pd.Series:
        found = np.zeros((len(names), MARK_WORDS), np.uint64)
        for row, name in enumerate(names):
            seen: dict[str, int] = {}
            for c in name or "":
                n = seen[c] = seen.get(c, -1) + 1
                word, bit = divmod((ord(c) * MARKS + n) % (64 * MARK_WORDS), 64)
                found[row, word] ^= np.uint64(1 << bit)
        return pd.Series(list(found.view(np.int64)))

    return side.withColumn("marks", marks("norm"))


def _edits(above: float) -> Column:
    """At least the most edits that names of ``norm_x`` and ``norm_y`` may have."""
    longer = F.greatest(F.length("norm_x"), F.length("norm_y"))
    return F.floor((1 - above) * longer + 1e-9).cast("int")


def _near(above: float) -> Column:
    """No pair with similarity above the threshold fails this test of marks and lengths."""
    changed = sum(F.bit_count(F.get(F.col("marks_x"), F.lit(i)).bitwiseXOR(F.get(F.col("marks_y"), F.lit(i)))) for i in range(MARK_WORDS))
    return changed + F.abs(F.length("norm_x") - F.length("norm_y")) <= 2 * _edits(above)


def _similarity(above: float) -> Column:
    """The similarity of ``norm_x`` and ``norm_y``, or something not above the threshold if it isn't; distances beyond are not computed."""
    longer = F.greatest(F.length("norm_x"), F.length("norm_y"))
    distance = F.call_function("levenshtein", F.col("norm_x"), F.col("norm_y"), _edits(above))
    return F.when(distance < 0, F.lit(-1.0)).when(longer == 0, F.lit(1.0)).otherwise(1 - distance / longer)


def most_edits(length: int, threshold: float) -> int:
    """Most edits between names of which the longer has ``length`` characters, if their similarity is above the threshold."""
    return max(0, math.ceil((1 - threshold) * length - 1e-9) - 1)


@functools.cache
def _partners(length: int, threshold: float) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Lengths of longer (or equal) and of shorter (or equal) names that may be similar."""
    longer = [n for n in range(length, int(length / threshold) + 2) if n - length <= most_edits(n, threshold)]
    shorter = [n for n in range(1, length + 1) if length - n <= most_edits(length, threshold)]
    return tuple(longer), tuple(shorter)


def edit_candidates(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``(l, r, sim)`` for pairs of ``(key, norm)`` rows with similarity above the threshold.

    Names of lengths that may be similar meet once, and the pair is measured where it meets: a similarity this low leaves
    segments of two or three characters, under which a pair of names met many times over.
    """
    lengths = right.where("norm <> ''").select(F.length("norm").alias("n")).distinct()
    partners = F.udf(lambda n: sorted(set().union(*_partners(n, threshold))), "array<int>")
    # the lengths are few; the larger lists of names with one length are dealt to parts
    meets = lengths.select("n", F.explode(partners("n")).alias("length"))
    salt = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    left, right = [side if "marks" in side.columns else marked(side) for side in (left, right)]
    a = left.where("norm <> '' and key is not null").select(
        F.col("key").alias("l"), F.col("norm").alias("norm_x"), F.col("marks").alias("marks_x"), F.length("norm").alias("length"), salt.alias("part")
    )
    b = right.where("norm <> '' and key is not null").select(
        F.col("key").alias("r"), F.col("norm").alias("norm_y"), F.col("marks").alias("marks_y"), F.length("norm").alias("n")
    ).join(meets, "n")
    b = b.select("r", "norm_y", "marks_y", "length", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])).alias("part"))
    sim = _similarity(threshold)
    met = a.join(b.hint("merge"), (a.length == b.length) & (a.part == b.part) & _near(threshold) & (sim > threshold))
    return met.select("l", "r", sim.alias("sim"))


def mutual_best(candidates: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One-to-one pairs: repeatedly take pairs that are the first choice of both sides.

    ``order`` ranks pairs, smallest first; ids break ties. The first pair overall is always taken,
    so the loop ends.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("l").alias("l"), F.col("r").alias("r"))
    rest, rows = materialize_counted(candidates.select("l", "r", rank.alias("rank")), "candidates")
    spark = candidates.sparkSession
    path, schema = new_path(spark, "taken"), rest.select("l", "r").schema
    rest.select("l", "r").limit(0).write.parquet(path)
    while rows > FEW_PAIRS:
        by_l = rest.groupBy("l").agg(F.min("rank").alias("best")).select("l", "best.r")
        by_r = rest.groupBy("r").agg(F.min("rank").alias("best")).select("best.l", "r")
        agreed = materialize(by_l.join(by_r, ["l", "r"]), "agreed")
        # every round is a file of one table, so the plan does not grow
        agreed.write.mode("append").parquet(path)
        left = rest.join(agreed.select("l"), "l", "left_anti").join(agreed.select("r"), "r", "left_anti")
        left, rows = materialize_counted(left, "candidates")
        discard(rest, agreed)
        rest = left
    if rows:
        one = rest.coalesce(1).sortWithinPartitions("rank").select("l", "r")
        one.mapInArrow(_in_order, schema).write.mode("append").parquet(path)
    discard(rest)
    return spark.read.schema(schema).parquet(path)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs that come best first, those of which neither name is taken."""
    taken: tuple[set, set] = (set(), set())
    for batch in batches:
        use = []
        for at, (l, r) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
            if l not in taken[0] and r not in taken[1]:
                taken[0].add(l)
                taken[1].add(r)
                use.append(at)
        yield batch.take(pa.array(use, pa.int64()))


def _down(
    left: DataFrame, right: DataFrame, steps: Sequence, candidates: Callable[..., DataFrame], order: Sequence[Column]
) -> DataFrame:
    """``(l, r)``: the best pairs of ``candidates(left, right, step)``, step by step, each of the names that are left.

    A pair that a step has and an earlier one had not must rank behind all pairs of the earlier one.
    """
    pairs = left.select(F.col("key").alias("l")).limit(0).crossJoin(right.select(F.col("key").alias("r")).limit(0))
    for step in steps:
        found = mutual_best(candidates(left, right, step), order)
        if found.isEmpty():
            continue
        pairs = pairs.unionByName(found)
        rest = [
            materialize_counted(side.join(found.select(F.col(k).alias("key")), "key", "left_anti"), "left-over")
            for side, k in ((left, "l"), (right, "r"))
        ]
        (left, n), (right, m) = rest
        if not n or not m:
            break
    return pairs


def fuzzy_match(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str
) -> DataFrame:
    """``(l, r, round, sim)``; every key occurs at most once on its side."""

    def prepare(df: DataFrame, key: str) -> DataFrame:
        named = df.select(F.col(key).alias("key"), normalize_name(name).alias("norm"), name_tokens(name).alias("tokens"))
        return materialize(marked(named), "names")

    a, b = prepare(left, left_key), prepare(right, right_key)

    # Round 1: the i-th left record of a name takes the i-th right record of that name.
    named = a.where("norm <> ''").select("key", "norm")
    same = b.select("key", "norm").join(named.select("norm").distinct(), "norm", "left_semi")
    na, nb = [row_numbers(x, ["norm"], [F.asc("key")]) for x in (named, same)]
    first = na.select(F.col("key").alias("l"), "norm", "rn").join(
        nb.select(F.col("key").alias("r"), "norm", "rn"), ["norm", "rn"]
    )
    done = materialize(first.select("l", "r", F.lit(1).alias("round"), F.lit(1.0).alias("sim")), "matched")

    def left_over(done: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            a.join(done.select(F.col("l").alias("key")), "key", "left_anti"),
            b.join(done.select(F.col("r").alias("key")), "key", "left_anti"),
        )

    def rows_of(pairs: DataFrame, la: DataFrame, lb: DataFrame) -> DataFrame:
        """Every row of the names of a pair, with what they have in common; keys may repeat."""
        x = la.select(F.col("key").alias("l"), F.col("norm").alias("na"), F.col("tokens").alias("ta"))
        y = lb.select(F.col("key").alias("r"), F.col("norm").alias("nb"), F.col("tokens").alias("tb"))
        sim = levenshtein_ratio(F.col("na"), F.col("nb"))
        return pairs.join(x, "l").join(y, "r").select("l", "r", F.size(F.array_intersect("ta", "tb")).alias("shared"), sim.alias("sim"))

    la, lb = left_over(done)
    repeated = repeats(a) or repeats(b)
    # ranked by shared tokens, then by similarity
    most = [side.agg(F.max(F.size("tokens"))).first()[0] or 0 for side in (la, lb)]
    steps = [(n, band) for n in range(min(most), 2, -1) for band in TOKEN_BANDS]

    def sharing(x: DataFrame, y: DataFrame, step: tuple[int, float]) -> DataFrame:
        found = token_candidates(x, y, step[0], step[1], repeated)
        names = [s.select(F.col("key").alias(k), F.col("norm").alias(f"norm_{n}")) for s, k, n in ((x, "l", "x"), (y, "r", "y"))]
        return found.join(names[0], "l").join(names[1], "r").select("l", "r", "shared", _similarity(step[1]).alias("sim")).where(F.col("sim") > step[1])

    second = materialize(_down(la, lb, steps, sharing, [-F.col("shared"), -F.col("sim")]), "second")
    every = rows_of(second, la, lb)
    tokens = every.where("shared >= 3").select("l", "r", "shared").distinct()
    second = every.where("sim > 0.7").select("l", "r", "sim").join(tokens, ["l", "r"])
    done = materialize(done.unionByName(second.select("l", "r", F.lit(2).alias("round"), "sim")), "matched")

    la, lb = left_over(done)
    third = materialize(_down(la, lb, EDIT_BANDS, edit_candidates, [-F.col("sim")]), "third")
    third = rows_of(third, la, lb).where("sim > 0.6")
    return done.unionByName(third.select("l", "r", F.lit(3).alias("round"), "sim"))
