"""Connected components of links between numbered nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them. a > b holds for all edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 30)), F.lit(0))).first())


def roots(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has a smaller one; links has a and b."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = written(_small(_large(edges)), "edges")
        mark, before = _mark(edges), mark
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, root of nodes under another root) after links between nodes are added."""
    ends = links.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    moved = roots(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    step = moved.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    kept = labels.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    new = moved.join(labels.select("node"), "node", "left_anti")
    return written(kept.unionByName(new), "labels")
