"""Exact Jaccard join of word n-gram sets in their metric space (operator 8).

The distance is one minus Jaccard similarity, a metric. Texts that have nothing to do with each
other all lie at distance near 1 from any document, so documents chosen as pivots cannot divide
the corpus: a window of twice the radius would copy everything everywhere. The first level
therefore takes as pivots the sets of ``k`` shingles that follow each other in hash order. The
Voronoi cell of such a pivot holds the documents nearest to it, those that have these shingles
next to each other. Two linked sets differ in at most ``D`` shingles, which cut the ordered union
into at most ``D + 1`` runs of common shingles, so some ``k`` of them follow each other among the
first ``k (D + 1)``. Each document is therefore copied to the cells of its first ``k (D + 1)``
shingles, and every linked pair meets in a cell. Cells that stay large, because many documents
share a passage, are divided again with a longer run. Inside the cells, documents are pivots and
the triangle inequality bounds what has to be compared (:mod:`recordmill.llm.regions`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import bit_filter, map_batches, materialize, maybe_in
from recordmill.llm.components import components
from recordmill.llm.regions import links_in_regions
from recordmill.llm.shingles import mix, shingle_set, words

#: Members from which on a cell is divided again.
LARGE_CELL = 64

#: Longs of the parity sketch of a set: bit ``i`` tells whether an odd number of shingles fall to it. Two sets differ
#: in at least as many shingles as their sketches in bits. Unrelated sets differ in about half the bits, so 1,024 bits tell them
#: apart up to some 5,000 shingles at 0.9; larger ones are measured.
SKETCH = 16
_SKETCH = [f"s{i}" for i in range(SKETCH)]

_CLASS = "id bigint, row bigint, n bigint, cls bigint, chk bigint, " + ", ".join(f"{c} bigint" for c in _SKETCH) + ", cells array<bigint>"
_CELL = "region bigint, item bigint, n bigint"


def _identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    return int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _cell_keys(s: np.ndarray, run: int, num: int, den: int) -> np.ndarray:
    """Cells of a set: its runs of ``run`` shingles among the first ``run (D + 1)``; none if it is linked with equal sets only."""
    differ = _differ(len(s), num, den)
    head = s[: run * (differ + 1)]
    if differ == 0 or len(head) < run:
        return np.empty(0, np.int64)
    key = head[: len(head) - run + 1]
    for k in range(1, run):
        key = mix(key) ^ head[k : len(head) - run + 1 + k]
    return mix(key + np.uint64(run)).view(np.int64)


def _classes(batch: pa.RecordBatch, size: int, short: bool, num: int, den: int, run: int) -> pa.RecordBatch:
    """Size, names, sketch and cells of each set; of equal sets of a batch only the first one lists its cells."""
    n, one, two, keys = [], [], [], []
    seen: set[int] = set()
    bits = np.zeros((batch.num_rows, 64 * SKETCH), np.uint8)
    for k, text in enumerate(batch.column(2).to_pylist()):
        s = shingle_set(text, size, short)
        x, y = _identity(s)
        n.append(len(s)), one.append(x), two.append(y)
        keys.append(np.empty(0, np.int64) if x in seen else _cell_keys(s, run, num, den))
        seen.add(x)
        bits[k] = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1, SKETCH)
    cells = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(k) for k in keys]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(_signed(one)), pa.array(_signed(two)), *[pa.array(sketch[:, i].copy()) for i in range(SKETCH)], cells],
        ["id", "row", "n", "cls", "chk", *_SKETCH, "cells"],
    )


def _differ(n: int, num: int, den: int) -> int:
    """Largest symmetric difference of a set of ``n`` with a linked one: (1 - t) |A or B| <= n (1 - t) / t."""
    return n * (den - num) // num


def first_run(num: int, den: int) -> int:
    """2 if two linked sets always have two common shingles next to each other among their first ``2 (D + 1)``, else 1."""
    return 2 if all(2 * (_differ(n, num, den) + 1) <= n for n in range(1, 64 * den) if _differ(n, num, den)) else 1


def longer_run(num: int, den: int) -> tuple[int, int]:
    """The run length of the second level, and the set size from which on it loses no pair."""
    k = 4 if 8 * (den - num) < num else 3
    fails = [n for n in range(1, 64 * den) if _differ(n, num, den) and k * (_differ(n, num, den) + 1) > n]
    return k, max(fails, default=0) + 1


def _kept(batch: pa.RecordBatch, keep) -> pa.RecordBatch | None:
    """Rows ``cls, n, cells`` as one row per cell that passes ``keep``."""
    lists = batch.column(2)
    keys = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    use = keep(keys)
    if not use.any():
        return None
    keys, owner = keys[use], pa.array(owner[use])
    return pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(owner), batch.column(1).take(owner)], ["region", "item", "n"])


def _cells(batch: pa.RecordBatch, size: int, short: bool, num: int, den: int, run: int) -> pa.RecordBatch:
    """Cells of one text of each ``cls``, whose set has this name."""
    sets = [shingle_set(text, size, short) for text in batch.column(1).to_pylist()]
    keys = [_cell_keys(s, run, num, den) for s in sets]
    cells = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(k) for k in keys]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), cells], ["cls", "n", "cells"])


def _distances(batch: pa.RecordBatch, size: int, short: bool, num: int, den: int) -> pa.RecordBatch:
    a, b = batch.column(0), batch.column(1)
    known: dict[int, np.ndarray] = {}

    def of(key: int, text: str) -> np.ndarray:
        if key not in known:
            known[key] = shingle_set(text, size, short)
        return known[key]

    out = []
    for x, y, s, t in zip(a.to_pylist(), b.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        p, q = of(x, s), of(y, t)
        common = len(np.intersect1d(p, q, assume_unique=True))
        union = len(p) + len(q) - common
        d = 1 - common / union
        # the decision is made in integers; the distance follows it
        out.append(min(d, 1 - num / den) if den * common >= num * union else max(d, np.nextafter(1 - num / den, 2)))
    return pa.RecordBatch.from_arrays([a, b, pa.array(out, pa.float64())], ["a", "b", "d"])


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 8, den: int = 10, short: bool = True
) -> DataFrame:
    """Groups of documents linked by ``den * common >= num * union`` of their shingle sets.

    Returns one row per input row: the id, ``n_shingles`` and ``component_id``, the smallest id
    reachable by links. A text with fewer than ``size`` words is one shingle if ``short``, else
    has none; null texts and texts without words have no shingle, are linked with nothing and are
    their own component. Rows with a null id are kept with a null component unless their text
    equals or is linked with a row that has an id. Repeated rows stay. Other columns are ignored.
    """
    # rows are found again by a hash of id and text, so a null id is no loss
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    rule = (size, short, num, den)
    # below about 0.78 runs would lose pairs: single shingles are the cells there, and large ones are not divided
    start = first_run(num, den)
    classes = materialize(map_batches(texts, _classes, _CLASS, *rule, start), "classes")
    reps = classes.where("n > 0").groupBy("cls").agg(F.min("row").alias("row"))

    def held(items: DataFrame) -> DataFrame:
        """Text of one document for each ``cls`` in ``items``."""
        wanted = materialize(reps.join(items, "cls"), "wanted")
        found = texts.where(maybe_in("row", wanted.select("row"))).join(wanted, "row")
        return materialize(found.groupBy("cls").agg(F.min("text").alias("text")), "texts")

    def cells(listed: DataFrame) -> DataFrame:
        """Members of the cells that hold more than one set, from the rows ``cls, n, cells``."""
        each = listed.select(F.explode("cells").alias("region"), F.col("cls").alias("item"))
        shared = each.groupBy("region").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi")
        shared = materialize(shared.select("region"), "shared")
        again = map_batches(listed.where(F.size("cells") > 0), _kept, _CELL, bit_filter(shared))
        return materialize(again.join(shared, "region").distinct(), "members")

    members = cells(classes.select("cls", "n", "cells"))
    large = materialize(members.groupBy("region").count().where(F.col("count") > LARGE_CELL).select("region"), "large")
    if start > 1 and not large.isEmpty():
        run, least = longer_run(num, den)
        crowded = members.join(large, "region")
        again = held(crowded.where(F.col("n") >= least).select(F.col("item").alias("cls")).distinct())
        small = crowded.where(F.col("n") * num <= least * den)
        members = members.join(large, "region", "left_anti").unionByName(small).unionByName(
            cells(materialize(map_batches(again, _cells, "cls bigint, n bigint, cells array<bigint>", *rule, run), "longer"))
        )

    def measure(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        text = held(ends)
        both = pairs.join(text.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(
            text.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b"
        )
        return map_batches(both.select("a", "b", "ta", "tb"), _distances, "a bigint, b bigint, d double", *rule)

    def fits(a: str, b: str) -> Column:
        return F.least(a + "n", b + "n") * den >= F.greatest(a + "n", b + "n") * num

    def sharper(a: str, b: str) -> Column:
        apart = sum(F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in _SKETCH)
        # |A xor B| (num + den) <= (|A| + |B|) (den - num), and it is at least ``apart``
        return apart * (num + den) <= (F.col(a + "n") + F.col(b + "n")) * (den - num)

    info = classes.where("n > 0").groupBy(F.col("cls").alias("item")).agg(F.min("n").alias("n"), *[F.min_by(c, "chk").alias(c) for c in _SKETCH])
    info = materialize(info, "sketches")
    links = links_in_regions(members.distinct(), measure, 1 - num / den, True, fits, ("n",), info, sharper)
    roots = components(links)
    group = classes.where("n > 0").join(roots, F.col("cls") == F.col("node"), "left")
    group = group.select("id", "n", "cls", "chk", F.coalesce("root", "cls").alias("root"), F.when(F.col("root").isNull(), F.col("chk")).alias("own"))
    first = group.groupBy("root", "own").agg(F.min("id").alias("component_id"))
    named = group.join(first, (group.root == first.root) & group.own.eqNullSafe(first.own)).select("id", "n", "component_id")
    alone = classes.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
