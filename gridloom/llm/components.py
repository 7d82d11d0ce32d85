"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, tidy


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a node to the least node about it. ``both``: directed pairs (u, v)."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if large:
        pairs = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        pairs = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return pairs.where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and the sum of their hashes."""
    with tidy(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u long, v long): label is the least node that it reaches.

    Each round is written to the shared folder. An empty input gives an empty result.
    """
    now = Scratch(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now.df)
    while mark[0]:
        turned = now.df.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _star(now.df.unionByName(turned), True)
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        new = Scratch(small, "edges")
        now.drop()
        now = new
        seen = _mark(now.df)
        if seen == mark:
            break
        mark = seen
    stars = now.df.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    hubs = now.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.unionByName(hubs.join(stars.select("node"), "node", "left_anti"))


def extended(label: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of label(node, label) with more ``edges`` (u, v): only the latter, between labels, are worked on."""
    of_u, of_v = (label.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in ("u", "v"))
    ends = edges.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    over = components(ends)
    moved = label.join(over.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return moved.unionByName(over.join(label.select("node"), "node", "left_anti"))
