"""Connected components by rounds of joins over written tables."""

from pyspark.sql import functions as F

from postloom.llm.scratch import Scratch


def _both_ways(edges):
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(ends))


def _tie_larger(edges):
    """Tie each node's larger neighbours to the least node it knows."""
    spread = _both_ways(edges)
    least = spread.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = spread.where("v > u").join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _tie_smaller(edges):
    """Tie each node and its smaller neighbours to the least of them; edges point down."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    ends = F.array(
        F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return tied.select(F.inline(ends)).where("u <> v").distinct()


def _is_settled(edges):
    """Every node hangs on one root, and no root hangs on anything."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node")
    nodes = nodes.agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where("hangs + holds > 1").isEmpty()


def components(links, label="components"):
    """``node, root`` for every node of ``links (a, b)`` that is not the least of its component.

    The number of edges never grows and the rounds grow with the logarithm of the graph.  A
    node with very many edges is joined with one row, so Spark can split its part of the join.
    """
    scratch, step = Scratch(links.sparkSession, label), 0
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = scratch.save(down.where("u <> v").distinct(), "0")
    while not _is_settled(edges):
        larger = scratch.save(_tie_larger(edges), f"{step}-larger")
        edges = scratch.save(_tie_smaller(larger), f"{step + 1}")
        scratch.drop(f"{step}", f"{step}-larger")
        step += 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
