"""Connected components of an edge table by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from finrecon.llm.frames import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the least node reachable.

    Each round takes the least label among a node and its neighbours (a partial aggregate, so a hub's neighbours are combined
    before the shuffle), then the label of that label, which halves the way to go. The table is written after each round and the one before it deleted; rounds grow with the
    logarithm of the longest path."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = scratch.kept(both.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"))
    labels = scratch.kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"), F.lit(-1).cast("long").alias("was")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        least = heard.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = scratch.kept(least.join(up, "label").select("node", F.least("label", "above").alias("label"), "was"))
        same = after.where("label <> was").isEmpty()
        scratch.done(labels)
        labels = after
        if same:
            scratch.done(both)
            return labels.select("node", "label")
