"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tables, written


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node; written, so that a node with very many neighbours can be split where the two are joined."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of"), "least")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the smallest node reachable.

    Minima are aggregated per node before they meet the node's edges. Each round is written to the shared folder; the driver gets
    one count and one sum a round, after which the round's other tables are deleted. Edges with a null end are left out, loops give a component of one, an empty table an empty one.
    """
    spark, at_first = edges.sparkSession, tables()
    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = _least(both)
        large = both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "large")
        # small star: neighbours below a node, and the node, go to the smallest of them; every edge has u > v here
        least = _least(large)
        small = large.join(least, F.col("u") == F.col("of"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, "small")
        discard(spark, at_first, edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
