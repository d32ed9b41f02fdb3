"""Connected components by contraction, as joins over edges that shrink each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame) -> DataFrame:
    """node, root (the same for all nodes of a component) of the nodes of edges (a, b: long).

    Each round every node joins its least neighbour, and edges between what the nodes joined stay:
    at least half of the nodes that have an edge go.  The maps of the rounds are composed at the end.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), free=False)
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("to")), free=False)
        maps.append(joined)
        left, right = (joined.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        edges = save(edges.join(left, "a").join(right, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), drop=[edges], free=False)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop().withColumnRenamed("to", "root")
    while maps:
        then = out.select(F.col("node").alias("to"), "root")
        out = maps.pop().join(then, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return save(out)
