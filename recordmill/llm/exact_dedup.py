"""Exact duplicates by distributed radix partitioning, most significant bytes first (operator 13).

A text stands as its length in bytes, then its bytes. All documents are split by the first ``FIRST`` bytes of
that; whoever is alone in a group is done. Open groups are split again by the next piece of
their texts until they are single or ended, so equality is that of the bytes and needs no digest. Pieces get
longer from round to round: the number of rounds grows with the logarithm of the longest text,
and every byte of an open text is moved once.

In a round every task first splits its own rows and gives each distinct piece of a group a name. Only the names travel
with their piece, once a task, and learn which group they belong to; rows follow by their
name. A group of copies that holds a third of all rows is thus at most one name a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import materialize, maybe_in, new_path

#: Bytes of a text that take part in the first split, beside its length.
FIRST = 56
#: Length of the first piece after that, its growth from piece to piece, and the longest piece.
PIECE, GROWTH, LONGEST = 1024, 16, 1 << 24
#: Bytes of distinct pieces that a task remembers; beyond, it starts with new names.
HELD = 64 << 20

_ROWS = "mid bigint, id bigint, size bigint, task bigint, num bigint, gtask bigint, gnum bigint, piece binary, n bigint, no_id boolean, first_id bigint, first_mid bigint"
_NAMES = _ROWS.replace(" bigint", "").replace(" binary", "").replace(" boolean", "").split(", ")
_TYPES = [pa.int64()] * 7 + [pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]


def _batch(columns: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in zip(_NAMES, _TYPES)], _NAMES)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the name of their piece, and every name with its piece, its rows and the first of them."""
    task, held, start = uuid.uuid4().int >> 65, 0, 0
    known: dict[tuple, int] = {}
    rows: list[int] = []
    first: list[tuple] = []

    def names() -> pa.RecordBatch:
        n = len(rows)
        keys = list(known)
        return _batch(
            {
                "task": [task] * n, "num": list(range(start, start + n)), "gtask": [k[0] for k in keys], "gnum": [k[1] for k in keys],
                "piece": [k[2] for k in keys], "n": rows, "no_id": [f[0] for f in first], "first_id": [None if f[0] else f[1] for f in first],
                "first_mid": [f[2] for f in first],
            },
            n,
        )

    for batch in batches:
        mids, ids, sizes, gtasks, gnums, pieces = (c.to_pylist() for c in batch.columns)
        nums = []
        for mid, i, key in zip(mids, ids, zip(gtasks, gnums, pieces)):
            place = (i is None, i or 0, mid)
            num = known.get(key)
            if num is None:
                num = known[key] = start + len(rows)
                held += len(key[2]) + 200
                rows.append(1), first.append(place)
            else:
                rows[num - start] += 1
                first[num - start] = min(first[num - start], place)
            nums.append(num)
        if nums:
            yield _batch({"mid": mids, "id": ids, "size": sizes, "task": [task] * len(nums), "num": nums}, len(nums))
        if held > HELD:
            yield names()
            start += len(rows)
            known, rows, first, held = {}, [], [], 0
    if rows:
        yield names()


def _round(pieces: DataFrame) -> DataFrame:
    """Rows whose group still has more than one after a split: with their group, its size and its first row."""
    split = materialize(pieces.select("mid", "id", "size", "gtask", "gnum", "piece").mapInArrow(_split, _ROWS), "split")
    names = split.where("mid is null").select("task", "num", "gtask", "gnum", "piece", "n", F.struct("no_id", "first_id", "first_mid").alias("first"))
    key = ["gtask", "gnum", "piece"]
    groups = names.groupBy(*key).agg(F.min(F.struct("task", "num")).alias("g"), F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    joined = names.select("task", "num", *key).join(groups, key).select("task", "num", "g", "n", "first")
    rows = split.where("mid is not null").select("mid", "id", "size", "task", "num").join(joined, ["task", "num"])
    rows = rows.select(
        "mid", "id", "size", F.col("g.task").alias("gtask"), F.col("g.num").alias("gnum"), "n",
        F.col("first.first_id").alias("keep_id"), F.col("first.first_mid").alias("keep_mid"),
    )
    return materialize(rows, "open")


def pieces_of(length: int) -> list[tuple[int, int]]:
    """Start and width of the pieces that cover ``length`` bytes after the first ``FIRST``."""
    out, at, width = [], 0, PIECE
    while at < length:
        out.append((at, width))
        at, width = at + width, min(width * GROWTH, LONGEST)
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str, rows: bool) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), norm.alias("norm"), *([F.struct("*").alias("doc")] if rows else []))
    raw = F.col("norm").cast("binary")
    return materialize(
        slim.select(
            F.monotonically_increasing_id().alias("mid"), "id", F.octet_length("norm").cast("bigint").alias("size"), F.sha2("norm", 256).alias("sha"),
            F.substring(raw, 1, FIRST).alias("head"), F.substring(raw, FIRST + 1, (1 << 31) - 1).alias("rest"), *(["doc"] if rows else []),
        ),
        "texts",
    )


def _groups(texts: DataFrame) -> DataFrame:
    """``mid, n, keep_id, keep_mid`` of every row that has an equal."""
    spark = texts.sparkSession
    whole = F.concat(F.unhex(F.lpad(F.hex("size"), 16, "0")), "head")
    opened = _round(texts.select("mid", "id", "size", F.lit(0).cast("bigint").alias("gtask"), F.lit(0).cast("bigint").alias("gnum"), whole.alias("piece")))
    done = opened.where(F.col("size") <= FIRST)
    longest = opened.agg(F.max("size")).first()[0] or 0
    cuts = pieces_of(longest - FIRST)
    if not cuts:
        return done.select("mid", "n", "keep_id", "keep_mid")
    wanted = opened.where(F.col("size") > FIRST).select("mid")
    cut = [F.struct(F.lit(k).alias("depth"), F.substring("rest", at + 1, width).alias("piece")) for k, (at, width) in enumerate(cuts)]
    # the few other rows that the test lets through have no group and go in the first join
    rest = texts.select("mid", "rest").where(maybe_in("mid", wanted))
    rest = rest.select("mid", F.explode(F.filter(F.array(*cut), lambda p: F.octet_length(p["piece"]) > 0)).alias("p")).select("mid", "p.depth", "p.piece")
    path = new_path(spark, "pieces")
    rest.write.partitionBy("depth").parquet(path)
    pieces = spark.read.schema("mid bigint, piece binary, depth int").parquet(path)
    end = FIRST
    for k, (at, width) in enumerate(cuts):
        going = opened.where(F.col("size") > end)
        if going.isEmpty():
            break
        end = FIRST + at + width
        opened = _round(pieces.where(F.col("depth") == k).select("mid", "piece").hint("merge").join(going, "mid"))
        done = done.unionByName(opened.where(F.col("size") <= end))
    return done.select("mid", "n", "keep_id", "keep_mid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The group of every row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if they are after each run of ASCII white space is one space; a null text is
    an empty one. Of a group the row with the smallest id is kept (rows without an id come last, of rows with the same id
    one is kept). One row per input row, repeated rows too; other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col, False)
    rows = texts.select("mid", "id", "sha").join(_groups(texts), "mid", "left")
    alone = F.col("n").isNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("mid") == F.col("keep_mid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns."""
    texts = _texts(docs, id_col, text_col, True)
    drop = _groups(texts).where("mid <> keep_mid").select("mid")
    return texts.join(drop, "mid", "left_anti").select("doc.*")
