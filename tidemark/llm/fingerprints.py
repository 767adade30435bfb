"""Document fingerprints: one-permutation MinHash of word shingles, densified and packed.

Each shingle is hashed once. The top bits choose a bin, and a bin keeps its smallest hash. Empty bins
copy the bin that a sequence of hashes of their own number first finds filled (optimal densification).
The lowest bits of each bin are stored; chance agreement of so few bits is taken out of the likeness.

Defined results: texts without words (null and empty ones too) have the fingerprint of no bytes, which
is like itself (1) and unlike all others (0). Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, rows
from tidemark.llm import text as tx
from tidemark.scratch import broadcast_if_small, materialise

BINS = 256
BITS = 4


def _sources(bins: int, attempt: int) -> np.ndarray:
    """Which bin each empty bin looks at in this attempt."""
    number = np.arange(bins, dtype=np.uint64) + np.uint64(attempt * bins + 1)
    return (tx.mix(number * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)


def pack_bins(shingles: np.ndarray, bounds: np.ndarray, bins: int, bits: int) -> list[bytes]:
    """The fingerprint of each set; the sets are ascending."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = (shingles >> np.uint64(65 - bins.bit_length())).astype(np.int64) + row * bins
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    table = np.zeros(len(sizes) * bins, np.uint64)
    filled = np.zeros(len(sizes) * bins, bool)
    table[place[first]] = shingles[first]
    filled[place[first]] = True
    empty = np.flatnonzero(~filled & np.repeat(sizes > 0, bins))
    attempt = 0
    while len(empty):
        source = empty // bins * bins + _sources(bins, attempt)[empty % bins]
        found = filled[source]
        table[empty[found]] = table[source[found]]
        empty = empty[~found]
        attempt += 1
    low = (tx.mix(table) & np.uint64((1 << bits) - 1)).astype(np.uint8).reshape(-1, bins)
    digits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(sizes), -1)
    packed = np.packbits(digits, axis=1)
    return [p.tobytes() if n else b"" for p, n in zip(packed, sizes, strict=True)]


def add_fingerprint(
    docs: DataFrame, text: str = "text", name: str = "fingerprint", bins: int = BINS, bits: int = BITS
) -> DataFrame:
    """``docs`` with a binary fingerprint of each whole text. ``bins`` is a power of two."""

    def make(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(pack_bins(*tx.shingle_sets(data, offsets), bins, bits), pa.binary())]

    return rows.add_columns(docs, text, f"{name} binary", lambda: make)


def compare(left: list[bytes], right: list[bytes], bits: int = BITS) -> np.ndarray:
    """The estimated Jaccard similarity of each pair of fingerprints, 0 to 1."""
    size = max(map(len, [*left, *right]), default=0)
    if not size:
        return np.ones(len(left))
    full = [np.array([len(x) == size for x in side]) for side in (left, right)]
    table = [
        np.frombuffer(b"".join(x if len(x) == size else bytes(size) for x in side), np.uint8).reshape(-1, size)
        for side in (left, right)
    ]
    differ = np.unpackbits(table[0] ^ table[1], axis=1).reshape(len(left), -1, bits).any(2).mean(1)
    near = np.maximum(0.0, 1 - differ / (1 - 0.5**bits))
    # A text without words is like another one of them, and like no other text.
    return np.where(full[0] & full[1], near, (full[0] == full[1]).astype(float))


def likeness(a: str, b: str, bits: int = BITS) -> Column:
    """The estimated Jaccard similarity of two binary fingerprints, 0 to 1; null if one is null."""

    @F.arrow_udf("double")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            known = pc.and_(pc.is_valid(left), pc.is_valid(right)).to_numpy(zero_copy_only=False)
            pairs = [side.fill_null(b"").to_pylist() for side in (left, right)]
            yield pa.array(compare(*pairs, bits), pa.float64(), mask=~known)

    return near(F.col(a), F.col(b))


EDITED = (
    "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)


def _edit(texts: list[str], nexts: list[str]) -> list[str]:
    """The last third of each text replaced by as many characters of the next one's beginning."""
    return [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]


def _prints(texts: list[str], bins: int, bits: int) -> list[bytes]:
    data, offsets = tx.text_bytes(pa.array(texts, pa.large_string()))
    found = []
    for a, b in tx.pieces(offsets):
        part = data[offsets[a] : offsets[b]]
        found += pack_bins(*tx.shingle_sets(part, offsets[a : b + 1] - offsets[a]), bins, bits)
    return found


def _edited_rows(ids: list, texts: list[str], nexts: list[str], prints, last_print, bins: int, bits: int) -> pa.Table:
    edited = _edit(texts, nexts)
    mine, theirs = prints[: len(texts)], _prints(edited, bins, bits)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array(edited, pa.string()),
        pa.array(mine, pa.binary()),
        pa.array(theirs, pa.binary()),
        pa.array(compare(mine, theirs, bits)),
        pa.array(compare(mine, last_print, bits)),
    ]
    return pa.table(columns, names=[c.split()[0] for c in EDITED.split(", ")])


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """:data:`EDITED` of each whole text: its last third replaced by the beginning of the next document, the
    fingerprints of both, and how like its fingerprint is to the edited text's and the next document's.

    The next document is the next row in descending (id, text); the last is followed by the first. A row
    without an id has no place in that order: it is followed by the first row, or by itself if no row has an id.
    Rows that repeat follow one another. Null texts count as empty. Columns other than id and text are
    left out, so names in them can't clash.

    Rows are dealt into blocks of ids, and a block holds all it needs: its own rows and, behind them, the
    first row of the block below. So each text is sent once, and read once for all that is wanted of it.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole)
    named = texts.where("doc_id IS NOT NULL")
    dealt, _, _ = blocks.deal(named, "doc_id", "text")
    tops = materialise(dealt.groupBy("block").agg(F.max("doc_id").alias("doc_id")), "tops")
    top = tops.agg(F.max("block")).first()[0]
    heads = dealt.join(broadcast_if_small(tops), ["block", "doc_id"], "left_semi")
    heads = heads.groupBy("block", "doc_id").agg(F.max("text").alias("text"))
    above = F.when(F.col("block") == F.lit(top), 0).otherwise(F.col("block") + 1)
    guests = heads.select("doc_id", "text", above.alias("block"), F.lit(True).alias("guest"))
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests)

    def one_block(key: tuple, table: pa.Table) -> pa.Table:
        ids, texts = table.column("doc_id").to_numpy(), table.column("text").to_pylist()
        guest = table.column("guest").to_numpy()
        order = np.argsort(-ids, kind="stable")
        order = order[np.argsort(guest[order], kind="stable")]
        if len(np.unique(ids)) < len(ids):
            order = sorted(order, key=lambda i: texts[i].encode(), reverse=True)
            order = sorted(order, key=lambda i: (guest[i], -ids[i]))
        ids, texts = ids[order], [texts[i] for i in order]
        prints, n = _prints(texts, bins, bits), int((~guest).sum())
        return _edited_rows(ids[:n], texts[:n], texts[1 : n + 1], prints, prints[1 : n + 1], bins, bits)

    found = both.groupBy("block").applyInArrow(one_block, EDITED)
    nameless = texts.where("doc_id IS NULL")
    if nameless.isEmpty():
        return found
    # One text, that of the first row of all.
    first = heads.where(F.col("block") == F.lit(top)).select("text").first() if top is not None else None

    def without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            nexts = [first.text] * len(texts) if first else texts
            prints = _prints(texts, bins, bits)
            last = _prints([first.text], bins, bits) * len(texts) if first else prints
            yield from _edited_rows([None] * len(texts), texts, nexts, prints, last, bins, bits).to_batches()

    return found.unionByName(nameless.mapInArrow(without_id, EDITED))
