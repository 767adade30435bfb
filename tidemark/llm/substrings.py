"""Remove word runs that an earlier document already has (Rabin-Karp windows, counted in Spark).

Every window of ``width`` consecutive words is hashed with a running polynomial. Blocks of documents
(ascending in id) send their different window hashes to shards; a shard tells each block which of
them an earlier block has too. Inside a block the smallest id is found by sorting. Repeated windows
of a document merge into maximal intervals of words, which are removed.

Defined results: null or empty text has no words, and ``kept`` is empty. A document shorter than the
window keeps everything. Rows with one id don't remove each other's words. A row without an id keeps
everything and takes nothing from others. Other columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks
from tidemark.llm import text as tx

SCHEMA = (
    "doc_id long, n_words long, n_removed long, kept string, "
    "removed array<struct<start: int, end: int>>"
)


def _window_hashes(column: pa.ChunkedArray, width: int):
    data, offsets = tx.text_bytes(column)
    words, firsts = tx.word_hashes(data, offsets, lower=False)
    hashes, at = tx.windows(words, firsts, width)
    return data, offsets, firsts, hashes, at


def _cut(
    ids: pa.Array, data: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, gone: np.ndarray
) -> pa.RecordBatch:
    """The result rows of some documents; ``gone`` marks their removed words."""
    starts, ends, _ = tx.word_spans(data, offsets)
    counts = np.diff(firsts)
    row = np.repeat(np.arange(len(counts)), counts)
    keep = np.flatnonzero(~gone)
    followed = np.zeros(len(keep), bool)
    followed[:-1] = row[keep[:-1]] == row[keep[1:]]
    edges = np.zeros(len(data) + 2, np.int32)
    edges[starts[keep]] += 1
    np.subtract.at(edges, ends[keep] + followed, 1)
    chosen = np.cumsum(edges[: len(data)]) > 0
    spaced = data.copy()
    spaced[ends[keep[followed]]] = 0x20
    sizes = np.concatenate([[0], np.cumsum(chosen)])[offsets]

    before = np.concatenate([[0], np.cumsum(gone)])
    removed = np.diff(before[firsts])
    prior = np.concatenate([[False], gone[:-1]])
    heads = firsts[:-1][counts > 0]
    prior[heads] = False
    opens = np.flatnonzero(gone & ~prior)
    after = np.concatenate([gone[1:], [False]])
    after[firsts[1:][counts > 0] - 1] = False
    closes = np.flatnonzero(gone & ~after) + 1
    first = firsts[row[opens]] if len(opens) else opens
    spans = pa.StructArray.from_arrays(
        [pa.array(opens - first, pa.int32()), pa.array(closes - first, pa.int32())],
        ["start", "end"],
    )
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(opens, firsts), pa.int32()), spans
    )
    return pa.record_batch(
        [ids, pa.array(counts), pa.array(removed), tx.text_array(spaced[chosen], sizes), lists],
        ["doc_id", "n_words", "n_removed", "kept", "removed"],
    )


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 13
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): the text left and the word intervals taken out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    dealt, _, shards = blocks.deal(known, "doc_id", "text")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        hashes = np.unique(_window_hashes(table.column("text"), width)[3])
        bounds = blocks.shard_bounds(hashes, shards)
        full = np.flatnonzero(np.diff(bounds))
        return pa.table(
            {
                "shard": pa.array(full, pa.int32()),
                "block": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "n": pa.array(np.diff(bounds)[full], pa.int32()),
                "packed": pa.array(
                    [tx.pack_sorted(hashes[bounds[s] : bounds[s + 1]]) for s in full], pa.binary()
                ),
            }
        )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        sizes = table.column("n").to_numpy()
        parts = [
            tx.unpack_sorted(p.as_py(), int(n))
            for p, n in zip(table.column("packed"), sizes, strict=True)
        ]
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        earlier = np.zeros(len(hashes), bool)
        earlier[order[1:]] = ordered[1:] == ordered[:-1]
        bits = np.split(earlier, np.cumsum(sizes)[:-1])
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "n": table.column("n"),
                "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
            }
        )

    def resolve(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, answers = docs.sort_by("doc_id"), answers.sort_by("shard")
        data, offsets, firsts, hashes, at = _window_hashes(docs.column("text"), width)
        different, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        earlier = np.concatenate(
            [np.zeros(0, bool)]
            + [
                np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()).astype(bool)
                for b, n in zip(answers.column("bits"), answers.column("n"), strict=True)
            ]
        )
        ids = docs.column("doc_id").to_numpy()
        owner = ids[np.searchsorted(firsts, at, "right") - 1]
        repeated = earlier[inverse] | (owner[first][inverse] < owner)
        edges = np.zeros(firsts[-1] + 1, np.int32)
        edges[at[repeated]] += 1
        edges[at[repeated] + width] -= 1
        gone = np.cumsum(edges[:-1]) > 0
        id_column = docs.column("doc_id").combine_chunks()
        out = []
        for a, b in tx.pieces(offsets):
            out.append(
                _cut(
                    id_column.slice(a, b - a),
                    data[offsets[a] : offsets[b]],
                    offsets[a : b + 1] - offsets[a],
                    firsts[a : b + 1] - firsts[a],
                    gone[firsts[a] : firsts[b]],
                )
            )
        return pa.Table.from_batches(out)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.batch_pieces(batches, "text"):
            firsts = tx.word_spans(data, offsets)[2]
            yield _cut(batch.column("doc_id"), data, offsets, firsts, np.zeros(firsts[-1], bool))

    sent = dealt.groupBy("block").applyInArrow(
        send, "shard int, block int, n int, packed binary"
    )
    answers = sent.groupBy("shard").applyInArrow(
        answer, "block int, shard int, n int, bits binary"
    )
    resolved = (
        dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(resolve, SCHEMA)
    )
    return resolved.unionByName(rows.where("doc_id IS NULL").mapInArrow(untouched, SCHEMA))
