"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup


def _weighted(df: DataFrame, table: DataFrame, key: str, to: str) -> DataFrame:
    """df with to, table's value for its key (unique in table); unmatched keys keep null. Any key may be hot."""
    counted = df.groupBy(key).agg(F.count("*").alias("__w")).join(table.select(key, to), key)
    return lookup(df, counted, [key], [to], "__w", df.count())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b), component being the smallest node it reaches.

    Each round moves every node to the least of itself and its neighbours and keeps the links between different nodes, so
    components shrink until no link is left. The first two rounds go by number, which ends stars at once; later ones by a
    hash of node and round, which halves any component in expectation, chains too. Nothing is collected; each round
    is written to the shared folder.
    """
    spark = links.sparkSession
    steps, edges, round_ = [], cut(links.select("a", "b").filter("a <> b").distinct()), 0
    while edges.limit(1).count():
        rank = (lambda c: c) if round_ < 2 else (lambda c, k=round_: F.xxhash64(F.lit(k), c))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min(F.struct(rank(F.col("other")).alias("k"), F.col("other").alias("v"))).alias("m"))
        own = F.struct(rank(F.col("node")).alias("k"), F.col("node").alias("v"))
        step = cut(least.select("node", F.least("m", own)["v"].alias("to")))
        steps.append(step)
        half = cut(_weighted(edges.withColumnRenamed("a", "node"), step, "node", "to").select(F.col("to").alias("a"), F.col("b").alias("node")))
        edges = cut(_weighted(half, step, "node", "to").select("a", F.col("to").alias("b")).filter("a <> b").distinct())
        round_ += 1
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    label = steps[0]
    for step in steps[1:]:
        moved = _weighted(label.withColumnRenamed("node", "__n").withColumnRenamed("to", "node"), step.withColumnRenamed("to", "next"), "node", "next")
        label = cut(moved.select(F.col("__n").alias("node"), F.coalesce("next", "node").alias("to")))
    smallest = label.groupBy("to").agg(F.min("node").alias("component"))
    return _weighted(label, smallest, "to", "component").select("node", "component")
