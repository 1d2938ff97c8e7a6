"""Connected components of an edge table by alternating stars; nothing but a row count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored


def _nearest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and its neighbours. Aggregated before the join, so a hub is no hot group."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (u, v) of comparable ids: root is the component's least node.

    Rows may repeat and run either way; loops and nulls are left out. Each round is written to the shared folder.
    """
    now = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "edges")
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
