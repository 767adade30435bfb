"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (two long columns); the label is the least node.

    Every round hangs the larger neighbours of a node, then the smaller ones, on the least of them, so
    no node gathers its neighbours in memory and paths shrink fast. A round is written out, so that a
    lost executor costs one round at most.
    """
    a, b = edges.columns
    now = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if seen == state:
            break
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = _least_neighbour(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = least.select("u", F.col("m").alias("v"))
        now = materialise(small.unionByName(hung).where("u <> v").distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
