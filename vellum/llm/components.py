"""Connected components of distributed links by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, materialize, tidy


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every end of links(a, b): label is the smallest vertex of its component.

    Minima are partial aggregates, so a vertex with very many links is no hot key. Rounds grow with the logarithm of the longest path.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while not is_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # As many rows as edges at most, so those that repeat are dropped once, at the round's end.
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = materialize(small, "cc")
        discard(edges)
        edges = after
        tidy(links.sparkSession)
    stars = edges.select(F.col("u").alias("v"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("v"), "label").distinct())


def is_stars(edges: DataFrame) -> bool:
    """Whether every vertex of distinct edges(u, v) is a centre or has one: then a round would change nothing, and only then."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out > 0 and into > 0").isEmpty()


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of components() over the links that gave labels and these ones, too: only links between different components count, and they join labels."""
    end = lambda x: labels.select(F.col("v").alias(x), F.col("label").alias(f"{x}_label"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    between = materialize(ends.where("a <> b").distinct(), "cc")
    if between.isEmpty():
        return labels
    # A label is the smallest vertex of its component, so the smallest of joined ones is theirs.
    top = materialize(components(between), "cc").select(F.col("v").alias("label"), F.col("label").alias("least"))
    old = labels.join(top, "label", "left").select("v", F.coalesce("least", "label").alias("label"))
    alone = top.select(F.col("label").alias("v"), F.col("least").alias("label")).join(labels, "v", "left_anti")
    return materialize(old.union(alone), "cc")
