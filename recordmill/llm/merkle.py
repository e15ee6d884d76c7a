"""Merkle manifest of a table, and what one changed row does to it, by path copying (operator 12).

A row is a leaf; the leaves of a group, by id, become nodes over runs of ``RUN``, level by level to the
group's subroot, and the subroots in the same way become the root. ``BLOCK`` consecutive nodes form an aligned
block, which one task lifts by whole levels; the tops of the blocks are the nodes of the next stage, so a
group of any size is spread over tasks and the tables shrink by ``BLOCK`` from stage to stage.
On the way down each block receives the path above it. A changed leaf makes a version of the tree
of its own: it copies the leaf's ancestors, first within the block, then along that path, and
shares every other node with the original.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import map_batches, materialize
from recordmill.operators.ordering import running

RUN, LEVELS = 16, 2
BLOCK = RUN**LEVELS
#: Leaves of a group from which on they are numbered in slices.
PLAIN_ROWS = 10_000

_PATH = "array<struct<left: string, right: string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_LEAF = "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string, copied array<string>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(column: Column | str) -> Column:
    """A value as ``length:value``, or ``-`` if it is null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def levels(nodes: list[str], alone: bool) -> list[list[str]]:
    """Levels above the nodes of a block: to a single node if it is the group's only block, else whole levels."""
    out = [nodes]
    while len(out[-1]) > 1 if alone else len(out) <= LEVELS:
        low = out[-1]
        out.append([digest("".join(low[k : k + RUN])) for k in range(0, len(low), RUN)])
    return out


def path_of(tree: list[list[str]], at: int) -> list[dict[str, str]]:
    """The other nodes of the runs above a node of the block, left and right of it."""
    out = []
    for low in tree[:-1]:
        first, at = at // RUN * RUN, at % RUN
        run = low[first : first + RUN]
        out.append({"left": "".join(run[:at]), "right": "".join(run[at + 1 :])})
        at = first // RUN
    return out


def copy_path(leaf: str, path: list[dict[str, str]]) -> list[str]:
    """The nodes that a version with this leaf does not share, from the leaf to the root."""
    out = [leaf]
    for p in path:
        out.append(digest(p["left"] + out[-1] + p["right"]))
    return out


def _tops(batch: pa.RecordBatch) -> pa.RecordBatch:
    full, alone = [], []
    for nodes in batch.column(3).to_pylist():
        full.append(levels(nodes, False)[-1][0])
        alone.append(levels(nodes, True)[-1][0])
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(full), pa.array(alone)], ["part", "block", "n", "whole", "short"])


def _down(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The path above every node of a block."""
    part, pos, subroot, path = [], [], [], []
    for p, b, nodes, alone, s, upper in zip(*(c.to_pylist() for c in batch.columns)):
        tree = levels(nodes, alone)
        for k in range(len(nodes)):
            part.append(p), pos.append(b * BLOCK + k), subroot.append(s), path.append(path_of(tree, k) + upper)
    columns = [pa.array(part, pa.string()), pa.array(pos, pa.int64()), pa.array(subroot, pa.string()), pa.array(path, _PATH_TYPE)]
    return pa.RecordBatch.from_arrays(columns, ["part", "block", "subroot", "path"])


def _leaves(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Proof of every leaf, and the version of the tree that its changed (else its own) leaf makes."""
    rows = []
    for nodes, ids, changed, alone, subroot, upper in zip(*(c.to_pylist() for c in batch.columns)):
        tree = levels(nodes, alone)
        for k, (i, leaf, other) in enumerate(zip(ids, nodes, changed)):
            path = path_of(tree, k) + upper
            copied = copy_path(other or leaf, path)
            proof = digest("".join(p["left"] + p["right"] for p in path))
            rows.append((i, leaf, subroot, proof, copied[-1], copied if other else []))
    names = [c.split(" ")[0] for c in _LEAF.split(", ")]
    types = [pa.int64()] + [pa.string()] * 4 + [pa.list_(pa.string())]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """Blocks of ``part, pos, h`` rows, with the columns ``more`` in the same order."""
    held = nodes.groupBy("part", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "h", *more))).alias("m"))
    return held.select("part", "block", F.size("m").cast("bigint").alias("n"), F.col("m.h").alias("nodes"), *[F.col(f"m.{c}").alias(c) for c in more])


def _up(blocks: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """All stages, each as its blocks and those parts that end in it; and ``part, root`` of all parts."""
    stages, roots = [], None
    while True:
        tops = materialize(map_batches(blocks.select("part", "block", "n", "nodes"), _tops, "part string, block bigint, n bigint, whole string, short string"), "tops")
        # a part ends in this stage if it has one block; only first blocks can tell, so no part is a hot key
        count = tops.groupBy("part").agg(F.max("block").alias("last"))
        first = materialize(tops.where("block = 0").join(count, "part"), "first-blocks")
        ended = first.where("last = 0").select("part", F.col("short").alias("root"))
        stages.append((blocks, ended))
        roots = ended if roots is None else roots.unionByName(ended)
        more = first.where("last > 0").select("part", "block", "whole").unionByName(tops.where("block > 0").select("part", "block", "whole"))
        if more.isEmpty():
            return stages, roots
        blocks = materialize(_blocks(more.select("part", F.col("block").alias("pos"), F.col("whole").alias("h"))), "blocks")


def _placed(stages: list[tuple[DataFrame, DataFrame]], above: DataFrame) -> DataFrame:
    """The blocks of the first stage with ``alone``, ``subroot`` and the ``path`` above them; ``above`` has these for each part."""
    paths = None
    for k in range(len(stages) - 1, -1, -1):
        blocks, ended = stages[k]
        here = ended.join(above, "part").select("part", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("alone"), "subroot", "path")
        if paths is not None:
            here = here.unionByName(paths.withColumn("alone", F.lit(False)))
        placed = blocks.join(here, ["part", "block"])
        if k:
            lower = placed.select("part", "block", "nodes", "alone", "subroot", "path")
            paths = materialize(map_batches(lower, _down, f"part string, block bigint, subroot string, path {_PATH}"), "paths")
    return placed


def manifest(
    docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source",
    tampered: Column | None = None, changes: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its place in the tree, and the version of the tree if it is changed.

    Columns: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (all of the original tree), ``folded_root`` (the
    root of the version in which the row has ``changes``, for rows where ``tampered``, else the root folded anew from its
    leaf), ``verified`` and ``copied``, the digests of the nodes that the version does not share.
    Leaves ascend by id, null ids first, then by leaf; groups ascend bytewise, the null group first.
    Repeated rows are leaves of their own. An empty table gives no rows. Only named columns matter.
    """
    changes = changes or {}
    leaf = F.sha2(F.concat(*[field(c) for c in columns]), 256)
    other = F.sha2(F.concat(*[field(changes.get(c, F.col(c))) for c in columns]), 256)
    part = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(
        part.alias("part"), F.col(id_col).cast("bigint").alias("id"), leaf.alias("h"),
        (F.lit(None).cast("string") if tampered is None else F.when(tampered, other)).alias("changed"),
    )
    numbered = running(leaves, ["part"], [F.col("id").asc(), F.col("h").asc()], number="pos", store=True, plain_rows=PLAIN_ROWS)
    stages, subroots = _up(materialize(_blocks(numbered.withColumn("pos", F.col("pos") - 1), "id", "changed"), "blocks"))
    groups = running(subroots, [], [F.col("part").asc()], number="pos", store=True, plain_rows=PLAIN_ROWS)
    groups = materialize(groups.select("part", F.col("root").alias("h"), (F.col("pos") - 1).alias("pos")), "groups")
    top, roots = _up(materialize(_blocks(groups.select(F.lit("").alias("part"), "pos", "h", F.col("part").alias("name")), "name"), "blocks"))
    found = roots.first()
    root = found["root"] if found else None
    start = roots.select("part", F.col("root").alias("subroot"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    high = _placed(top, start).select("part", "block", "nodes", "alone", "subroot", "path")
    high = map_batches(high, _down, f"part string, block bigint, subroot string, path {_PATH}")
    above = materialize(groups.join(high.select(F.col("block").alias("pos"), "path"), "pos").select("part", F.col("h").alias("subroot"), "path"), "above")
    placed = _placed(stages, above).select("nodes", "id", "changed", "alone", "subroot", "path")
    rows = map_batches(placed, _leaves, _LEAF)
    return rows.select(
        F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"), "copied",
    )
