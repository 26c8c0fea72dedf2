"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges(a, b); component is the smallest node of it.

    Alternates large-star and small-star steps, each of which is two aggregations
    and a join on the edges; the number of rounds is logarithmic in practice. The
    aggregations sum a node's edges where they are first. In the joins all edges of a node
    meet its one row of the other side, so a node with very many edges is a skewed
    partition, which adaptive execution splits. Every round is written to shared storage,
    and the one before it is deleted then. Null ids are no nodes; loops and repeated
    edges change nothing; a table without edges has no components.
    """
    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        stars, done = materialize(small.where("a <> b").distinct(), "edges"), stars
        discard(done)
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
