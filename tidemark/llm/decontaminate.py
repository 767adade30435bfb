"""Find benchmark items inside documents: size-partitioned MinHash containment, checked exactly.

The signature of an item is its bottom-k MinHash: its k smallest shingle hashes. Items are partitioned
by size, and k follows from the size: an item of n shingles of which at most m may be missing has
k = m + 1, so a document that holds enough of it holds one of the k for certain. (Random bands would
miss some.) Documents probe the partitions whose items their own size can hold; every hit is verified
on the full sets.

Defined results: texts without words hold nothing and items without words are in nothing; under five
words the whole sequence is one shingle. So an item of one to four words is found only in a document of
these words alone, not in longer ones, even where it stands there verbatim. Repeated rows give repeated results. Null ids are carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.rows import add_columns

#: Bytes of benchmark text that go to all tasks at once; more items take several passes.
ITEM_BYTES = 32 << 20

SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _signatures(shingles: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple]:
    """For each size class: (least document size, keys, items of the keys), keys ascending."""
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if n := int(b - a):
            k = n - (percent * n + 99) // 100 + 1
            classes.setdefault(n.bit_length(), []).append((item, shingles[a : a + k]))
    out = []
    for size, members in sorted(classes.items()):
        keys = np.concatenate([x for _, x in members])
        items = np.repeat([i for i, _ in members], [len(x) for _, x in members])
        order = np.argsort(keys, kind="stable")
        least = (percent * (1 << (size - 1)) + 99) // 100
        out.append((least, keys[order], items[order]))
    return out


def _candidates(
    shingles: np.ndarray, bounds: np.ndarray, signatures: list[tuple]
) -> np.ndarray:
    """Different (row, item) pairs that share a signature hash."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pairs = [np.zeros((0, 2), np.int64)]
    for least, keys, items in signatures:
        tops = np.zeros(1 << 16, bool)
        tops[keys >> np.uint64(48)] = True
        at = np.flatnonzero(tops[shingles >> np.uint64(48)])
        at = at[sizes[row[at]] >= least]
        low = np.searchsorted(keys, shingles[at], "left")
        found = np.searchsorted(keys, shingles[at], "right") - low
        at, low, found = at[found > 0], low[found > 0], found[found > 0]
        ends = np.cumsum(found)
        index = np.repeat(low - ends + found, found) + np.arange(ends[-1] if len(ends) else 0)
        pairs.append(np.stack([np.repeat(row[at], found), items[index]], 1))
    return np.unique(np.concatenate(pairs), axis=0)


Search = Callable[[np.ndarray, np.ndarray], list[tuple]]


def _searches(benchmark: DataFrame, percent: int, k: int) -> Iterator[Callable[[], Search]]:
    """For each block of items of at most about :data:`ITEM_BYTES`: what makes a search in a task.

    A search gives (row, item_id, n_shared, n_item) for texts as (bytes, offsets).
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / ITEM_BYTES))
    for number in range(passes):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        part = some.toArrow()
        item_sets, item_bounds = tx.shingle_sets(*tx.text_bytes(part.column("text")), k)
        ids = part.column("item_id").to_pylist()
        shared = benchmark.sparkSession.sparkContext.broadcast(
            (ids, item_sets, item_bounds, _signatures(item_sets, item_bounds, percent))
        )

        def start(shared=shared) -> Search:
            ids, item_sets, item_bounds, signatures = shared.value

            def search(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
                sets, bounds = tx.shingle_sets(data, offsets, k)
                hits = []
                for r, i in _candidates(sets, bounds, signatures).tolist():
                    item = item_sets[item_bounds[i] : item_bounds[i + 1]]
                    mine = sets[bounds[r] : bounds[r + 1]]
                    at = np.minimum(np.searchsorted(mine, item), len(mine) - 1)
                    both = int((mine[at] == item).sum())
                    if 100 * both >= percent * len(item):
                        hits.append((r, ids[i], both, len(item)))
                return hits

            return search

        yield start


def find_items(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for items held to at least ``percent``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for start in _searches(benchmark, percent, k):

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            search = start()
            for batch, data, offsets in tx.batch_pieces(batches, "text"):
                hits = search(data, offsets)
                r, *columns = zip(*hits, strict=True) if hits else ([], [], [], [])
                shared, size = (np.array(c, np.int64) for c in columns[1:])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(r, pa.int64())),
                        pa.array(columns[0], pa.int64()),
                        pa.array(shared),
                        pa.array(size),
                        pa.array(shared / size),
                    ],
                    ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

        here = rows.mapInArrow(run, SCHEMA)
        found = here if found is None else found.unionByName(here)
    return found


def count_items(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with ``n_items``, how many items each document holds; without a shuffle."""
    out = docs.withColumn("n_items", F.lit(0).cast("long"))
    for start in _searches(benchmark, percent, k):

        def begin(start=start) -> Callable[[np.ndarray, np.ndarray], list[pa.Array]]:
            search = start()

            def make(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
                held = np.array([h[0] for h in search(data, offsets)], np.int64)
                return [pa.array(np.bincount(held, minlength=len(offsets) - 1))]

            return make

        more = add_columns(out, "text", "more_items long", begin)
        out = more.withColumn("n_items", F.col("n_items") + F.col("more_items")).drop("more_items")
    return out
