"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with the least m of u and its v's. The pairs of one u may be very many; the join's skewed side is split."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(low, "u")


def _stars(state: DataFrame) -> bool:
    """Whether each node hangs on one node that hangs on none."""
    ends = state.select(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(state.select(F.col("v").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    return ends.groupBy("n").agg(F.sum("c").alias("c"), F.sum("p").alias("p")).where("c > 1 OR (c > 0 AND p > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): the least node that it is connected with.

    A large star links the neighbours above a node to the least of its neighbourhood, a small star those below it; the number of rounds
    grows with the logarithm of the largest component. Each round is written to the shared folder.
    """
    few = 4 * edges.sparkSession.sparkContext.defaultParallelism
    keep = lambda df: common.saved(df.distinct().coalesce(few), "edges")
    state = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(ROUNDS):
        if _stars(state):
            break
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = _lowest(large)
        new = keep(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v"))
        common.drop_saved(state)
        state = new
    else:
        raise RuntimeError(f"components are not complete after {ROUNDS} rounds")
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return common.saved(state.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots).coalesce(few), "labels")


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of the nodes of ``labels`` (node, label) when ``edges`` (a, b) join."""
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(edges.select("a", "b")))
