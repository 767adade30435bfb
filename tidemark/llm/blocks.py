"""Counts over all documents without a row per word.

Documents are dealt into blocks: ranges of their ids of about :data:`BLOCK_BYTES` of text. A block
sends each *different* hash it holds once, packed by hash range (a shard); the shard answers to the
block about each of them. So a word or passage that stands in every document costs a shard one entry
per block, not one per document, and what travels is a few bytes per different hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
#: Hashes per shard on average, were every word of the input different.
SHARD_HASHES = 1 << 20


def id_range(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``column``, by binary search in the JVM."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])

    def step(low: Column, width: Column) -> Column:
        up = low + width
        inside = (up <= len(bounds)) & (F.get(table, F.least(up, F.lit(len(bounds))) - 1) <= column)
        return F.when(inside, up).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def deal(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int, int]:
    """``docs`` with a column ``block``, ascending with ``doc_id``; the numbers of blocks and shards.

    Rows with one id are in one block. Null ids are not for this function.
    """
    rows, total = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    blocks = max(1, math.ceil((total or 0) / BLOCK_BYTES))
    bounds: list[int] = []
    if blocks > 1:
        points = [i / blocks for i in range(1, blocks)]
        found = docs.agg(F.percentile_approx(doc_id, points, 20 * blocks + 10_000)).first()[0]
        bounds = sorted({int(x) + 1 for x in found})
    shards = 1 << max(3, math.ceil(math.log2(max(1, (total or 0) / 6 / SHARD_HASHES))))
    return docs.withColumn("block", id_range(F.col(doc_id), bounds)), len(bounds) + 1, shards


def shard_bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in ascending ``hashes``: the shard is the top bits."""
    tops = np.arange(shards, dtype=np.uint64) << np.uint64(64 - shards.bit_length() + 1)
    return np.append(np.searchsorted(hashes, tops), len(hashes))
