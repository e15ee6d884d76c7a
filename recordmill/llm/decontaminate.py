"""Benchmark items inside documents by size-partitioned MinHash containment (operator 5).

Items are partitioned by the size of their shingle set. In a partition a document that holds at
least the share ``num / den`` of an item's ``n`` shingles misses at most ``n - need`` of them, so it holds
one of any ``n - need + 1``. The item's sketch is therefore its ``n - need + 1`` smallest hashes, a
bottom-k MinHash whose length follows the partition: no contained item is missed, whatever the
length of the document, which estimates from whole-document signatures cannot promise. A document
skips partitions that need more shingles than it has. Candidates are verified by
counting the shared shingles.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import map_batches, materialize
from recordmill.llm.shingles import shingle_hashes, words

#: Bytes of item texts that go to the tasks at once; more items are searched in blocks.
BLOCK_BYTES = 8_000_000

_PAIR = "doc bigint, item bigint, n_shared bigint, n_item bigint"


def _need(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


class ItemIndex:
    """Sketches of a block of items by (shingle size, size partition)."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, num: int, den: int):
        grouped = defaultdict(list)
        for key, text in items:
            tokens = words(text)
            if tokens:
                w = min(size, len(tokens))
                full = np.unique(shingle_hashes(tokens, w))
                grouped[w, len(full).bit_length()].append((key, full))
        self.parts = []
        for (w, _), members in sorted(grouped.items(), key=lambda x: x[0]):
            sketch = [full[: len(full) - _need(len(full), num, den) + 1] for _, full in members]
            owner = np.repeat(np.arange(len(members)), [len(s) for s in sketch])
            values = np.concatenate(sketch)
            order = np.argsort(values, kind="stable")
            least = min(_need(len(full), num, den) for _, full in members)
            self.parts.append((w, least, values[order], owner[order], members))
        self.num, self.den = num, den

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """Item, shared shingles and the item's shingles for every item the text contains."""
        tokens, out, sets = words(text), [], {}
        for w, least, values, owner, members in self.parts:
            if w not in sets:
                sets[w] = np.unique(shingle_hashes(tokens, w, False))
            have = sets[w]
            if len(have) < least:
                continue
            low = np.searchsorted(values, have)
            hit = low < len(values)
            hit[hit] = values[low[hit]] == have[hit]
            found = have[hit]
            if not len(found):
                continue
            start, stop = np.searchsorted(values, found), np.searchsorted(values, found, "right")
            for k in sorted({o for a, b in zip(start.tolist(), stop.tolist()) for o in owner[a:b].tolist()}):
                key, full = members[k]
                at = np.searchsorted(have, full)
                shared = int((have[np.minimum(at, len(have) - 1)] == full).sum())
                if shared * self.den >= len(full) * self.num:
                    out.append((key, shared, len(full)))
        return out


_built: dict[str, ItemIndex] = {}


def _search(batch: pa.RecordBatch, shared, args: tuple) -> pa.RecordBatch | None:
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = ItemIndex(pickle.loads(shared.value), *args)
    index = _built[shared.id]
    rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in index.matches(t)]
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "item", "n_shared", "n_item"])


class _Shared:
    """A broadcast value with a name for the worker's cache that no other one ever has."""

    def __init__(self, value):
        self.held, self.id = value, uuid.uuid4().hex

    @property
    def value(self):
        return self.held.value


def contained_items(
    docs: DataFrame, items: DataFrame, size: int = 5, num: int = 8, den: int = 10,
    doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and an item of whose distinct word shingles it has at least ``num / den``.

    Columns: both ids, ``n_shared``, ``n_item``. Items with fewer than ``size`` words are one
    shingle of all their words. Null texts and texts without words take no part. Every row is
    searched with every row of ``items``: repeated rows and null ids give rows of their own. Other columns are
    ignored. Items are searched in blocks of ``BLOCK_BYTES`` of text, each a pass over ``docs``.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES)
    if blocks > 1:
        rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items")
    texts = docs.select(F.col(doc_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    out = None
    for k in range(blocks):
        part = rows.where(F.col("block") == k) if blocks > 1 else rows
        shared = spark.sparkContext.broadcast(pickle.dumps([(r["item"], r["text"]) for r in part.collect()]))
        found = map_batches(texts, _search, _PAIR, _Shared(shared), (size, num, den))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], _PAIR)
    return out.select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "n_shared", "n_item")
