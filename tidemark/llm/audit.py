"""What a chain of filters removes, in every order of the filters, from one pass over the documents.

A document is known to the audit by its *mask*: the set of filters it fails. In an order of the
filters, a document goes at the first one that its mask holds. All orders that begin with some filters
outside the mask and then one inside it stand together in lexicographic order, so for a mask the orders
in which its documents go at step ``s`` are a few intervals of Lehmer ranks. Each mask adds its counts
where such an interval begins and takes them off where it ends; running sums over the ranks then give
what every order removes at every step. Nothing is evaluated order by order.

Spark counts documents per part and mask, at most ``2 ** filters`` rows a part, so a part that holds
most documents is summed before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import without
from tidemark.scratch import materialise

RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)
#: Orders are listed one by one, so their number has to stay small: 8 filters have 40,320.
MOST_FILTERS = 8


def intervals(filters: int) -> np.ndarray:
    """Rows (mask, step, first rank, end rank): where in lexicographic order documents of a mask go at
    a step. Filter ``i`` is bit ``i``; steps count from 0."""
    found = []

    def extend(prefix: tuple[int, ...], rank: int) -> None:
        rest = [f for f in range(filters) if f not in prefix]
        width = factorial(len(rest) - 1)
        for digit, now in enumerate(rest):
            # The Lehmer digit of a place is how many of the filters left are smaller.
            start = rank + digit * width
            before = sum(1 << f for f in prefix)
            for mask in range(1 << filters):
                if mask >> now & 1 and not mask & before:
                    found.append((mask, len(prefix), start, start + width))
            if len(rest) > 1:
                extend((*prefix, now), start)

    extend((), 0)
    return np.array(found)


def removed_by_order(counts: np.ndarray, filters: int) -> np.ndarray:
    """(parts, steps, ranks): documents removed, from (parts, masks) of documents."""
    mask, step, start, end = intervals(filters).T
    ends = np.zeros((filters, factorial(filters) + 1, len(counts)), np.int64)
    np.add.at(ends, (step, start), counts.T[mask])
    np.subtract.at(ends, (step, end), counts.T[mask])
    return ends.cumsum(axis=1)[:, :-1].transpose(2, 0, 1)


def _audit(letters: str):
    filters = len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    #: The filter that stands at each step of each order.
    at = np.array([[letters.index(c) for c in order] for order in orders]).T
    fails = np.arange(1 << filters) >> np.arange(filters)[:, None] & 1

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part")
            counts = np.zeros((3, len(parts), 1 << filters), np.int64)
            lists = batch.column("masks")
            cells = lists.flatten()
            row = np.repeat(np.arange(len(parts)), lists.value_lengths().to_numpy())
            mask = cells.field("mask").to_numpy()
            for i, name in enumerate(("n", "good", "toxic")):
                counts[i, row, mask] = cells.field(name).to_numpy()
            removed, good, toxic = (removed_by_order(c, filters) for c in counts)
            n = counts[0]
            failing, alone = n @ fails.T, n[:, 1 << np.arange(filters)]
            shapley = np.stack(
                [np.where(at == f, removed, 0).sum(axis=(1, 2)) for f in range(filters)], axis=1
            )
            for i in range(len(parts)):
                table = [
                    (n[i].sum() - removed[i].cumsum(axis=0)),
                    removed[i],
                    failing[i][at] - removed[i],
                    alone[i][at],
                    good[i],
                    toxic[i],
                    shapley[i][at],
                ]
                size = at.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([parts[i].as_py()] * size, pa.string()),
                        pa.array(np.repeat(orders, filters), pa.string()),
                        pa.array(np.tile(np.arange(1, filters + 1, dtype=np.int32), len(orders))),
                        *[pa.array(np.ascontiguousarray(t.T).ravel()) for t in table],
                    ],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return tables


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``masks`` has ``part`` (a null is the empty string), ``mask`` (bit ``i`` for a document that fails
    filter ``letters[i]``) and ``n``, ``good`` and ``toxic``: how many documents, good and toxic ones
    a row stands for. Rows that repeat are added up; other columns are left out. Per row of the result:

    * ``kept`` after this step, ``removed`` at it, ``good_lost`` and ``toxic_lost`` of the removed,
    * ``redundant``: documents that fail the filter of this step but went before it,
    * ``unique_fails``: documents that fail this filter and no other,
    * ``shapley``: documents that this filter removes, at whatever step, summed over all orders.

    An empty table has no parts, so gives no rows.
    """
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters) or sorted(letters) != [*letters]:
        raise ValueError("filters need different letters in ascending order, eight at most")
    part = F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part")
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("n", "good", "toxic")]
    counted = masks.groupBy(part, F.col("mask").cast("int").alias("mask")).agg(*sums)
    # At most 2 ** filters rows are left of a part.
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")
    return counted.groupBy("part").agg(cells).mapInArrow(_audit(letters), RESULT)


#: Filters of :func:`quality_masks`, in the order of their bits.
QUALITY_FILTERS = "ABCDE"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line feed, VT, FF and carriage return."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_mask(text: Column, least_words: int = 200) -> Column:
    """Bits of the filters that see one text alone.

    A: fewer than ``least_words`` words. B: under half of the words are different. C: over 2 % of the
    code points are ``A-Z``. D: holds one of ``#$%&*|``.
    """
    found = F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    # Through an array of one, so that words are split once and used twice.
    size = found[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    a = size["n"] < least_words
    b = 100 * size["d"] < 50 * size["n"]
    c = 100 * capitals > 2 * F.length(text)
    d = text.rlike(r"[#$%&*|]")
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate((a, b, c, d))]
    return sum(bits[1:], bits[0])


def quality_masks(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Counts per part and mask of the filters :data:`QUALITY_FILTERS`, as :func:`audit` wants them.

    A to D are those of :func:`text_mask`; E fails if a document with a smaller id, in whatever part,
    has the same text. A null text is empty. A null id is no smaller than any and none is smaller, so
    such rows neither fail E nor make others fail. Rows that repeat an id count one by one, and do
    not fail E for one another. ``labels`` (doc_id, quality, toxic) may repeat ids: a document is
    good if any of its labels has quality 1, toxic if any has toxic 1. Other columns are not read.

    Texts are not shuffled, their SHA-256 is. The least id of each text is an aggregate, and its rows are
    found by text *and* id, so thousands of copies of one text do not meet in one task.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("same"),
        text_mask(whole).alias("mask"),
    )
    rows = materialise(rows, "audit-rows")
    named = labels.select(
        F.col("doc_id").alias("id"),
        F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("good"),
        F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic"),
    )
    marks = named.where("id IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Rows that are alike in all that counts are one row with a number, so that none is hot.
    alike = rows.where("id IS NOT NULL").groupBy("id", "part", "same", "mask").agg(F.count("*").alias("n"))
    alike = alike.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    first = alike.groupBy("same").agg(F.min("id").alias("id"))
    copies = first.withColumn("first", F.lit(True))
    alike = alike.join(copies, ["same", "id"], "left")
    copy = F.when(F.col("first").isNull(), F.lit(1 << QUALITY_FILTERS.index("E"))).otherwise(F.lit(0))
    alike = alike.select(
        "part",
        (F.col("mask") + copy).alias("mask"),
        "n",
        (F.col("good") * F.col("n")).alias("good"),
        (F.col("toxic") * F.col("n")).alias("toxic"),
    )
    nameless = rows.where("id IS NULL").select(
        "part", "mask", *[F.lit(v).cast("long").alias(c) for c, v in (("n", 1), ("good", 0), ("toxic", 0))]
    )
    return alike.unionByName(nameless)


def audit_quality(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """:func:`audit` of :func:`quality_masks`."""
    return audit(quality_masks(docs, labels, **columns), QUALITY_FILTERS)
