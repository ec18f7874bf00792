"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round every node points its larger neighbours, then its smaller ones, to the least node it knows. Rounds cut
their lineage in the shared folder; their number grows with the logarithm of the graph's size. Nothing but a count comes to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, distinct."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    if large:
        found = met.where("b > a").select(F.col("b").alias("x"), "m")
    else:
        found = met.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    return found.where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for every node of an edge between different nodes the least node it is connected with.

    Repeated edges count once, edges with a null end or from a node to itself not at all; no edges, no rows. Each round's
    table goes when the next one is written.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    now = common.written(now, "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first()
        # every node points to one least node, and no such node points on: done
        if before == state or not state[0]:
            break
        before = state
        later = common.written(_star(_star(now, True), False), "edges")
        common.discard(now)
        now = later
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
