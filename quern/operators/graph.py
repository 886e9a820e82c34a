"""Connected components without driver-side data: alternating star contractions, cut at each round by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ensure_checkpoint_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node's neighbours are linked to the smallest of them.

    large: neighbours greater than the node; otherwise the node and those smaller than it.
    """
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = near.join(least, "u")
    out = met.where("v > u") if large else met
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (out if large else out.union(least.select("u", F.col("m").alias("v")))).where("u <> v").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): every node of the edges (u, v) that isn't its component's smallest, with that smallest node.

    Each round at least squares what a node reaches, so that the rounds grow with the logarithm of the longest path.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges, seen = edges.select("u", "v").where("u <> v"), None
    while True:
        edges = _star(_star(edges, True), False).checkpoint()
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return edges
        seen = now


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): nodes (id) under edges (i, j); a component is named by its smallest id."""
    found = contracted(edges.select(F.col("i").alias("u"), F.col("j").alias("v")))
    return nodes.select("id").join(found.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


#: Edges into one node that one task may hold; a node with more is dealt to several.
SPLIT_ROWS = 100_000


def label_propagation(edges: DataFrame, rounds: int = 5, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(node, label) of weighted edges (u, v, w): communities by synchronous label propagation.

    Edges count both ways; equal ones add up, loops and rows with nulls are left out. Every node begins with its own label;
    each round it takes the label with the largest weight among its neighbours and itself (weight 1), the smallest of
    equals. It ends after `rounds` rounds or when no label changes. Votes are summed by (node, label) before they meet; the
    edges of a node with many neighbours lie in several parts, each of which gets its label.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    known = edges.where("u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL AND u <> v").select("u", "v", "w")
    both = known.union(known.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))
    parts = both.groupBy("v").agg((F.floor(F.count("*") / split_rows) + 1).cast("int").alias("parts"))
    dealt = both.join(parts.where("parts > 1"), "v", "left").withColumn("part", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int")).select("u", "v", "w", "part").checkpoint()
    labels = parts.select(F.col("v").alias("node"), "parts", F.col("v").alias("label")).checkpoint()
    for _ in range(rounds):
        sent = labels.select(F.col("node").alias("v"), "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        votes = dealt.join(sent, ["v", "part"]).select(F.col("u").alias("node"), "label", "w").union(labels.select("node", "label", F.lit(1).alias("w")))
        sums = votes.groupBy("node", "label").agg(F.sum("w").alias("w"))
        best = sums.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best")).select("node", F.col("best.label").alias("now"))
        moved = labels.join(best, "node").select("node", "parts", F.col("now").alias("label"), (F.col("now") != F.col("label")).alias("moved")).checkpoint()
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return labels.select("node", "label")
