"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm._common import key_join, materialize, remove


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in ``edges`` (u, v: long); root is the least node reachable.

    Large-star then small-star in each round, until the edge table no longer changes; rounds grow with the
    logarithm of the longest path. Minima are combined before each shuffle, hubs are joined by broadcast (``key_join``), and every round is written to the
    shared folder, so a lost executor costs at most one round. Null ends and loops are ignored; an empty table
    gives an empty table. Raises when ``most_rounds`` don't suffice.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "cc")
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("k")), "low")
        large = key_join(both, low, ["u"], "k", every=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        floor = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "floor")
        small = key_join(large, floor, ["u"], "k", every=True)
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(floor.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(after, "cc")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(now, low, large, floor)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not converge in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
