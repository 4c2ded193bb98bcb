"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each id in edges (a, b): component is the smallest id that edges
    reach. Loops and repeated edges do no harm, null ends are left out.

    Alternates large-star and small-star steps until each component is one star; each round
    is written to the shared folder. Only a count goes to the driver.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ends = settle(ends, "edges")
    while True:
        more = ends.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        inner = ends.select(F.col("v").alias("u")).join(ends, "u", "left_semi").limit(1)
        if more.select("u").unionAll(inner).isEmpty():
            break
        ends = settle(_small_star(_large_star(ends)), "edges")
    roots = ends.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return ends.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
