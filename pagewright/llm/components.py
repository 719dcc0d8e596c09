"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round writes its edges to the shared folder; nothing but two figures a round reaches the driver. A hub's
neighbours are never gathered: its smallest neighbour is a partial aggregate, joined back to the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another node; root is the least node of the component.

    edges: columns a and b of one sortable type. Loops, repeated edges and either direction are allowed; edges with a
    null end are none. An empty table gives an empty table.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
