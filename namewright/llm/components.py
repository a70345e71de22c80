"""Connected components by alternating large-star and small-star steps over an edge table.

Every step is a grouped minimum and a join; nothing meets on the driver but counts. Each round's edges
are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import drop_path, drop_scratch, new_path, stored


def _stars(edges: DataFrame, large: bool, scratch: list[str]) -> DataFrame:
    """edges (u, v) with u > v. large: each node's larger neighbours move to its least neighbour; small: its smaller ones and itself do."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # stored before it is joined back: then a hub's edges are split over tasks (skewed join)
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least", scratch)
    met = both.join(least, "u")
    out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 100) -> DataFrame:
    """(node, root): the least node that each node with an edge to another one reaches. Null ends and loops are left out."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    before, path = None, None
    for _ in range(most):
        now, scratch = new_path(spark, "components"), []
        _stars(_stars(e, True, scratch), False, scratch).write.parquet(now)
        drop_scratch(spark, scratch)
        e = spark.read.parquet(now)
        if path:
            drop_path(spark, path)
        path = now
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct()).toDF("node", "root")
