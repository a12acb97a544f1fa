"""Connected components of an edge table: smallest label by neighbours, then by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.session import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) of longs. Returns (node, component), the smallest node of each component, for
    every node of an edge. Each round takes the smallest label among a node's neighbours (aggregated in
    part before the shuffle, so a node with very many edges is split) and then that label's own label,
    which halves the remaining paths. Every round is written, so lineage stays short, and the
    round before is removed then."""
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = materialize(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node != other").distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    written = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("changed"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        out = materialize(lower.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "changed"), "labels")
        discard(written)
        written = out
        if out.where("changed").isEmpty():
            discard(both)
            return out.select("node", "component")
        labels = out.select("node", "component")
