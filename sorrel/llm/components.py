"""Connected components of an edge table, by alternating star steps.

Each round first hangs every neighbour that is larger than a node on the node's
smallest neighbour, then every smaller one.  Rounds are staged tables; the
driver reads one sum a round.  A hub is never collected: the smallest
neighbour of a node is a partial aggregate, and the join back to its
neighbours is split by AQE where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sorrel.plans.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(a, b)``, each held once with ``a > b``."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; root: its smallest reachable node.

    ``edges(a, b)`` are links between nodes of one sortable type.  Loops,
    repeated and reversed edges and nulls are allowed: loops and edges with a
    null end link nothing.  An empty table has no components.
    """
    now = stage(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        now = stage(_star(_star(now, large=True), large=False), "star")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
