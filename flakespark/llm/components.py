"""Connected components by smallest-label exchange with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unsized


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the smallest node that it reaches.

    Each round takes the smallest label among a node and its neighbours and then the
    label of that label, so a chain of n nodes needs about log n rounds.  Nothing is
    collected but one checksum a round; labels only fall, so an equal sum means done.
    Edges may repeat and may be self-links; an empty table gives an empty table.
    """
    thin = _thinned(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = unsized(cut(thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    labels = unsized(cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))))
    total = _checksum(labels)
    while total is not None:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        lower = labels.join(around, "node").select("node", F.least("label", "around").alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = unsized(cut(lower.join(onward, "label", "left").select("node", F.least("label", "further").alias("label"))))
        now = _checksum(labels)
        if now == total:
            break
        total = now
    return labels


def _thinned(edges: DataFrame) -> DataFrame:
    """Each node's links to smaller ones replaced by one to the smallest of them, and by links from that to the others.

    Nodes that share many neighbours keep about one link each, so later rounds, which
    join all links, have few.
    """
    edges = cut(edges)
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    kept = low.select(F.col("low").alias("a"), "b")
    moved = edges.join(low, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return kept.unionByName(moved).distinct()


def _checksum(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
