"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum per node and a join; a hub's edges are not gathered in one task (the join side is
split by AQE when a node is hot).  Every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges hold u < v: each v keeps its least neighbour, its other smaller neighbours are linked to that one."""
    low = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(low.withColumnRenamed("v", "n"), F.col("v") == F.col("n")).where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(low.select(F.col("m").alias("u"), "v")).where("u < v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least reachable node of every node that has an edge.  Null ends and self-edges are left out."""
    now = cut_lineage(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                      .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] == 0 or (found["n"], found["h"]) == mark:
            break
        mark = (found["n"], found["h"])
        now = cut_lineage(_small_star(_large_star(now)), "edges")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
