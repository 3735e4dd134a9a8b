"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b) of one orderable type: label is the component's least node.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components
    in MapReduce and beyond"): nodes link to the least node of their neighbourhood
    until all edges lead to labels.  Each step is written to the shared folder,
    and the side with a row per node is a written table, so a join on a hot node splits.
    """
    def least_of(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "cc_least")

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct(), "cc_edges")
    seen = mark(edges)
    while seen[0]:
        both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc_both")
        large = both.join(least_of(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc_large")
        small = large.join(least_of(large), "a").select(F.explode(F.array(
            F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "cc_edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
