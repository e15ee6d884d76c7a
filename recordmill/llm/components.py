"""Connected components of a table of links, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordmill.llm.common import new_path


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Write the edges; also their number and a sum of hashes, which tell whether a round changed them."""
    seen = Observation()
    path = new_path(edges.sparkSession, "edges")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).write.parquet(path)
    return edges.sparkSession.read.schema("u bigint, v bigint").parquet(path), tuple(seen.get.values())


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of every linked node: columns ``node, root``, both integers.

    Large-star and small-star rounds: the larger neighbours of every node move to its smallest
    neighbour, then the smaller ones and the node itself do, until only stars are left. The
    number of rounds grows with the logarithm of the longest path. The smallest neighbour is an aggregate
    joined back, never a list, so a node may have any number of links. Rows with a null end
    and self links are dropped.
    """
    pair = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges, before = _write(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small = large.join(low, "u").select(moved.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges, now = _write(small)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
