"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node that each node of the edges ``u, v`` reaches, as ``node, label``.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest
    node around it; rounds go on until no edge changes, a number that grows with the
    logarithm of the nodes.  A node of very many edges is a sum before the shuffle and a
    skewed join that Spark splits.  Nodes that are their own label are not returned;
    neither are loops or edges with a null end.
    """
    edges = edges.select("u", "v").filter("u != v")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = state
