"""Exact top-k inner products by pivot-table elimination (operator 10).

Components become ``floor(scale * x)``. For whole vectors ``2 q.x = |q|^2 + |x|^2 - |q - x|^2``, and for any
pivot ``p`` the distance ``|q - x|`` is at least ``| |q - p| - |x - p| |``. The distances of all vectors to
``PIVOTS`` pivots are computed once; their largest lower bound gives each candidate an upper bound of its
score. Candidates are evaluated in the order of that bound until the k-th best score is above the next one.
Queries and candidates meet in packed blocks; every block pair gives at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import materialize

PIVOTS = 32
#: Vectors from which pivots are chosen, far apart; results do not depend on them.
PIVOT_SAMPLE = 1024
SLICE = 4096
QUERIES = 512
_STEP = 256


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = np.asarray(v.values, np.float64)
            if np.isfinite(x).all():
                ids.append(i), out.append(np.floor(scale * x).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros."""
    out = np.zeros((len(blobs), width), np.int64)
    for k, b in enumerate(blobs):
        out[k, : len(b) // 8] = np.frombuffer(b, "<i8")
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float64), y.astype(np.float64)
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Rows chosen greedily, each as far as possible from those before."""
    chosen, near = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _blocks(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """Packs of ids, vectors and distances to the pivots."""
    ids: list[int] = []
    blobs: list[bytes] = []

    def pack() -> pa.RecordBatch:
        x = _matrix(blobs, pivots.shape[1])
        parts = [[np.array(ids, "<i8").tobytes()], [x.astype("<i8").tobytes()], [_distances(x, pivots).astype("<f8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.binary()) for p in parts], ["ids", "x", "far"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i), blobs.append(v)
            if len(ids) == rows:
                yield pack()
                ids.clear(), blobs.clear()
    if ids:
        yield pack()


def search_block(q_ids, q, q_far, c_ids, c, c_far, k: int):
    """Best ``k`` candidates of every query: lists of (query, candidate, score), and candidates evaluated."""
    found, evaluated = [], 0
    q_norm, c_norm = (q.astype(np.float64) ** 2).sum(1), (c.astype(np.float64) ** 2).sum(1)
    for i in range(len(q_ids)):
        lower = np.abs(c_far - q_far[i]).max(axis=1)
        # distances are rounded; the slack is far above their error
        total = q_norm[i] + c_norm
        lower = np.maximum(lower - 1e-6 * np.sqrt(total) - 1e-3, 0)
        upper = (total - lower**2) / 2 + 1e-9 * total + 1e-3
        upper[c_ids == q_ids[i]] = -np.inf
        order = np.argsort(-upper, kind="stable")
        best_s, best_c = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(order), _STEP):
            part = order[at : at + _STEP]
            part = part[np.isfinite(upper[part])]
            if not len(part) or (len(best_s) == k and upper[part[0]] < best_s[-1]):
                break
            evaluated += len(part)
            s, ids = np.concatenate([best_s, c[part] @ q[i]]), np.concatenate([best_c, c_ids[part]])
            top = np.lexsort((ids, -s))[:k]
            best_s, best_c = s[top], ids[top]
        found += [(int(q_ids[i]), int(c_), int(s)) for c_, s in zip(best_c, best_s)]
    return found, evaluated


def _search(batches: Iterator[pa.RecordBatch], k: int, n_pivots: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = []
            for side in ("q", "c"):
                ids = np.frombuffer(row[f"{side}_ids"], "<i8")
                parts += [ids, np.frombuffer(row[f"{side}_x"], "<i8").reshape(len(ids), width), np.frombuffer(row[f"{side}_far"], "<f8").reshape(len(ids), n_pivots)]
            found, _ = search_block(*parts, k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query's ``k`` largest integer inner products.

    ``is_query`` is a condition on ``id``. Ties go to the smaller id. Rows with a null id, and vectors that are null
    or hold null or non-finite components, take no part; rows that repeat an id count once (the
    smallest vector). Vectors of different length are compared on common components. Scores are 64-bit.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    rows = raw.mapInArrow(lambda it: _integers(it, scale), "id bigint, v binary").groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows, "vectors")
    width = (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8
    sample = rows.orderBy(F.xxhash64("id")).limit(PIVOT_SAMPLE).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = _far_apart(_matrix([r["v"] for r in sample], width), PIVOTS)
    kind = "ids binary, x binary, far binary"
    candidates = rows.mapInArrow(lambda it: _blocks(it, pivots, SLICE), kind)
    queries = rows.where(is_query)
    count = queries.count()
    groups = max(1, -(-count // QUERIES))
    queries = queries.repartition(groups).mapInArrow(lambda it: _blocks(it, pivots, QUERIES), kind)
    queries = materialize(queries.select(F.expr("uuid()").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "x", "far")]), "queries")
    names = [r["block"] for r in queries.select("block").toLocalIterator()]
    if not names:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # every block of queries meets every block of candidates once
    numbered = queries.join(spark.createDataFrame([(b, i) for i, b in enumerate(names)], "block string, b int"), "block")
    pairs = candidates.select(*[F.col(c).alias(f"c_{c}") for c in ("ids", "x", "far")], F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("b")).join(numbered.drop("block"), "b")
    n = len(pivots)
    best = pairs.drop("b").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
        lambda it: _search(it, k, n, width), "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
