"""Connected components by hooking and pointer jumping on DataFrames.

Every round joins the edges with the current labels, lowers the label of
each node and of the root it hangs on to the smallest label next to it, and
then halves the paths, so that chains need about log(n) rounds. All keys are
aggregated with map-side partial minima and joined with joins that adaptive
execution can split, so a hub that a third of the edges share is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of edges (a, b); label is the smallest node reachable."""
    both = scratch.write(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).where("u <> v"), f"{name}-edges"
    )
    labels = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        low = labels.join(near, "node").withColumn("low", F.least("label", "near"))
        lowered = (
            low.select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("label").alias("node"), "low"))).alias("x"))
            .groupBy(F.col("x.node").alias("node"))
            .agg(F.min("x.low").alias("label"))
        )
        k += 1
        hooked = scratch.write(lowered, f"{name}-{k}-hooked")
        jumped = hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.least("label", "far").alias("label"))
        after = scratch.write(jumped, f"{name}-{k}")
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        scratch.drop(f"{name}-{k}-hooked", f"{name}-{k - 1}")
        labels = after
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) after more links (a, b): components found before count as one node each, so old edges are not walked again."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    edges = ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct()
    over = connected(edges, scratch, name).select(F.col("node").alias("label"), F.col("label").alias("top"))
    every = labels.union(over.select("label", F.col("label").alias("own"))).distinct()  # a component's label is one of its nodes
    return scratch.write(every.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")), f"{name}-merged")
