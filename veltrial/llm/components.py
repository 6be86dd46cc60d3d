"""Connected components by alternating large and small stars.

Every round maps each edge to the least neighbour known at its ends; a round is
two grouped minima and two joins, with no group ever gathered in one place.  The
edges stay in Spark, and each round is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltrial.llm.common import shared_checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (node, component): the least id reachable, for every node of an edge."""
    now = shared_checkpoint(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        now = shared_checkpoint(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(heads.join(now.select(F.col("u").alias("node")).distinct(), "node", "left_anti"))
