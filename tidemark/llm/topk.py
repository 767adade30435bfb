"""Exact top-k search by inner product: histograms of all scores find each query's kth score.

Vectors are whole numbers, so scores are too, and a query's kth score is a number that can be closed in
on: a pass over all candidates counts, per query, scores in 256 bins of equal width; the counts, added
up over all tasks, tell the bin of the kth score; the next pass divides that bin. At width one the score
is known. A last pass keeps what lies above, and of ties with it those of smallest id.

Queries are dealt into groups of bounded size, which are broadcast; candidates are read where they
are and never shuffled per query. A task sends at most ``k`` bins of a query, since a bin below the kth
score of the task's own candidates can't hold that of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import vectors as vec
from tidemark.scratch import materialise, scratch_path

BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Queries in a group: bounds what is broadcast, and a task's table of bins (32 MB).
GROUP_QUERIES, GROUP_BYTES = 1 << 14, 32 << 20
#: Scores of one step within a task, and those a task is given at least.
STEP_SCORES, TASK_SCORES, MOST_TASKS = 1 << 22, 20_000_000, 4096
#: Scores beyond are held here, which leaves room for differences of two.
MOST = (1 << 62) - 1


@dataclass
class _Queries:
    """Queries of one group. The kth score of query ``i`` is in one of ``bins`` bins of width ``1 <<
    shift`` that begin at ``low[i]``, and the ``need[i]``-th greatest of those there."""

    ids: np.ndarray
    x: np.ndarray
    low: np.ndarray
    need: np.ndarray
    bins: int
    shift: int
    bound: int

    def scores(self, block: np.ndarray, at: slice) -> np.ndarray:
        """Scores of some queries with a block of candidates. Floating point is used only where all
        partial sums are exact in it."""
        q = self.x[at]
        if self.bound < 1 << 24:
            return (q.astype(np.float32) @ block.astype(np.float32).T).astype(np.int64)
        if self.bound < 1 << 53:
            return (q.astype(float) @ block.astype(float).T).astype(np.int64)
        exact = q.astype(object) @ block.astype(object).T
        return np.clip(exact, -MOST, MOST).astype(np.int64).reshape(len(q), len(block))

    def steps(self, rows: int) -> Iterator[slice]:
        size = max(1, STEP_SCORES // max(rows, 1))
        return (slice(i, min(i + size, len(self.ids))) for i in range(0, len(self.ids), size))

    def own(self, ids: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) with one id; ``self.ids`` ascend."""
        first, last = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right")
        many = np.where(named, last - first, 0)
        candidate = np.repeat(np.arange(len(ids)), many)
        within = np.arange(len(candidate)) - np.repeat(many.cumsum() - many, many)
        return first[candidate] + within, candidate


def _candidates(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(ids as Arrow, ids, whether there is one, vectors) by ascending id, rows without one last."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column("id")
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy()
            order = np.lexsort((plain, ~named))
            x = vec.matrix(batch.column("x"), width)[order]
            yield ids.take(pa.array(order)), plain[order], named[order], x


def _count_bins(shared: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        table = np.zeros((len(q.ids), BINS + 1), np.int64)
        for _, ids, named, x in _candidates(batches, width):
            same_q, same_c = q.own(ids, named)
            for at in q.steps(len(x)):
                past = (q.scores(x, at) - q.low[at, None]) >> q.shift
                # Scores outside fall into one more bin: below zero is a great unsigned number.
                bins = np.where(past.view(np.uint64) < q.bins, past, BINS)
                mine = (same_q >= at.start) & (same_q < at.stop)
                bins[same_q[mine] - at.start, same_c[mine]] = BINS
                many = at.stop - at.start
                bins += np.arange(many)[:, None] * (BINS + 1)
                table[at] += np.bincount(bins.ravel(), minlength=many * (BINS + 1)).reshape(many, -1)
        counts = table[:, BINS - 1 :: -1]
        above = counts.cumsum(axis=1) - counts
        query, place = np.nonzero((counts > 0) & (above < q.need[:, None]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query.astype(np.int32)),
                pa.array((BINS - 1 - place).astype(np.int32)),
                pa.array(counts[query, place]),
            ],
            names=["query", "bin", "many"],
        )

    return run


def _take(shared: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for names, ids, named, x in _candidates(batches, width):
            same_q, same_c = q.own(ids, named)
            for at in q.steps(len(x)):
                scores = q.scores(x, at)
                low = q.low[at, None]
                ties = scores == low
                wanted = scores > low
                mine = (same_q >= at.start) & (same_q < at.stop)
                own = (same_q[mine] - at.start, same_c[mine])
                wanted[own] = ties[own] = False
                # Candidates ascend by id, so the first ties are those to take.
                if ties.any():
                    row, column = np.nonzero(ties)
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    few = rank < q.need[at][row]
                    wanted[row[few], column[few]] = True
                row, column = np.nonzero(wanted)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((row + at.start).astype(np.int32)),
                            pa.array(q.ids[row + at.start]),
                            names.take(pa.array(column)),
                            pa.array(scores[row, column]),
                        ],
                        names=["query", "query_id", "id", "score"],
                    )

    return run


def _search(candidates: DataFrame, queries: _Queries, width: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of one group of queries."""
    spark = candidates.sparkSession
    done = False
    while not done:
        shared = spark.sparkContext.broadcast(queries)
        bins = candidates.mapInArrow(_count_bins(shared, width), "query int, bin int, many bigint")
        bins = bins.groupBy("query", "bin").agg(F.sum("many").alias("many"))
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        need = spark.createDataFrame(
            pa.table({"query": pa.array(np.arange(len(queries.ids), dtype=np.int32)), "need": pa.array(queries.need)})
        )
        reached = bins.withColumn("reached", F.sum("many").over(down)).join(F.broadcast(need), "query")
        kth = reached.where("reached >= need AND reached - many < need")
        # One row per query of the group, at most GROUP_QUERIES.
        found = kth.select("query", "bin", (F.col("reached") - F.col("many")).alias("above")).toArrow()
        at, chosen = found.column("query").to_numpy(), found.column("bin").to_numpy().astype(np.int64)
        # A query with fewer candidates than k takes all: nothing reaches its count.
        low = np.full(len(queries.ids), -MOST - 1)
        low[at] = queries.low[at] + (chosen << queries.shift)
        required = queries.need.copy()
        required[at] -= found.column("above").to_numpy()
        done = queries.shift == 0
        bits = min(queries.shift, BIN_BITS)
        queries = _Queries(
            queries.ids, queries.x, low, required, 1 << bits, queries.shift - bits, queries.bound
        )
    shared = spark.sparkContext.broadcast(queries)
    schema = "query int, query_id bigint, id bigint, score bigint"
    taken = candidates.mapInArrow(_take(shared, width), schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


def top_k(
    rows: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    queries: Column | None = None,
    scale: float = 64.0,
) -> DataFrame:
    """The ``k`` best candidates of each query as (query_id, rank, vec_id, score).

    A score is the inner product of the vectors ``floor(scale * c)``; the greatest come first, and of
    equal ones the smallest id. Queries are the rows with a key that ``queries`` selects, a key
    divisible by 20 unless given; rows alike in key and vector are one query. Candidates of a query
    are all rows but those with its key, each of them even if rows repeat. Rows without a key are
    candidates, last among ties, and no queries. A null vector, or one with a null, NaN or infinite
    entry, takes no part. A shorter vector has zeros in the places it lacks. Scores beyond 2 ** 62 - 1
    are held there. Other columns are left out, so names in them can't clash. A query without
    candidates, and an empty table, give no rows.
    """
    usable = rows.where(vec.usable(vector))
    numbers = vec.as_integers(vector, scale)
    chosen = F.col(f"`{key}`") % 20 == 0 if queries is None else queries
    usable = usable.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        numbers.alias("x"),
        F.coalesce(chosen & F.col(f"`{key}`").isNotNull(), F.lit(False)).alias("asks"),
    )
    given, asking, width = usable.agg(
        F.count("*"), F.sum(F.col("asks").cast("int")), F.max(F.size("x"))
    ).first()
    spark = rows.sparkSession
    schema = T.StructType().add("query_id", "long").add("rank", "integer").add("vec_id", "long").add("score", "long")
    if not asking:
        return spark.createDataFrame([], schema)
    width = max(width, 0)
    # Rows stand for much work here, so they are dealt to tasks by the number of scores.
    scores = given * min(asking, GROUP_QUERIES)
    tasks = max(1, min(MOST_TASKS, -(-scores // TASK_SCORES)))
    usable = usable.withColumn("x", vec.padded(F.col("x"), width)).repartition(tasks)
    usable = materialise(usable, "candidates")
    candidates = usable.select("id", "x")
    # Every partial sum of a score is at most this: the greatest square of a vector's length.
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    bound = int((candidates.agg(F.max(square)).first()[0] or 0) * (1 + 1e-9)) + 1
    size = max(1, min(GROUP_QUERIES, GROUP_BYTES // (8 * max(width, 1))))
    asked = usable.where("asks").select("id", "x").distinct()
    groups = -(-asking // size)
    asked = asked.withColumn("group", F.pmod(F.xxhash64("id", "x"), F.lit(groups)))
    asked = materialise(asked, "queries", partition_by=("group",))
    span = 2 * min(bound, MOST) + 1
    shift = max(0, span.bit_length() - BIN_BITS)
    path, found = scratch_path(spark, "top-k"), []
    for group in range(groups):
        # A group is about ``size`` queries, by hash.
        table = asked.where(F.col("group") == group).select("id", "x").toArrow()
        if not table.num_rows:
            continue
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = vec.matrix(table.column("x").combine_chunks(), width)[order]
        low = np.full(len(ids), -min(bound, MOST))
        start = _Queries(ids[order], x, low, np.full(len(ids), k), BINS, shift, bound)
        _search(candidates, start, width, k).write.parquet(f"{path}/part={group}")
        found.append(f"{path}/part={group}")
    return spark.read.schema(schema).parquet(*found)
