"""Connected components of a link table, all in Spark.

Nodes are relabelled by a bijective 64-bit hash, so that chains of ascending ids do not make long paths.  A round points
every node at its least neighbour (or itself), follows that pointer once more, and replaces both ends of every link by
where they point; links within one node fall away.  Each round leaves a fraction of the nodes, so rounds grow with
the logarithm of the longest chain.  Every table is written before it is joined: joins then read both sides through
exchanges of their own, and Spark can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: a, b (long, not null).  A row per linked node: node, component_id (the smallest node of its component)."""
    links = links.where("a <> b").select("a", "b")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = scratch.table(ends.withColumn("label", F.xxhash64("node")), "nodes")
    left, right = F.xxhash64("a"), F.xxhash64("b")
    current = scratch.table(links.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).distinct(), "links")
    where = nodes.select("label", F.col("label").alias("root"))
    while not current.isEmpty():
        both = current.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        near = scratch.table(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), "near")
        far = near.select(F.col("u").alias("to"), F.col("to").alias("far"))
        step = scratch.table(near.join(far, "to").select("u", F.col("far").alias("to")), "step")
        a, b = step.select("u", F.col("to").alias("a")), step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = current.join(a, "u").select("v", "a").join(b, "v").where("a <> b")
        current = scratch.table(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        where = scratch.table(where.join(step, where["root"] == step["u"], "left").select("label", F.coalesce("to", "root").alias("root")), "where")
    named = scratch.table(nodes.join(where, "label").select("node", "root"), "named")
    least = scratch.table(named.groupBy("root").agg(F.min("node").alias("component_id")), "least")
    return scratch.table(named.join(least, "root").select("node", "component_id"), "components")
