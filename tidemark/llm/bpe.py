"""Byte-level BPE, both ways, for a vocabulary of ranks.

Whole pre-tokens of the vocabulary are found by a minimal perfect hash (hash and displace, checked
against the bytes). All others are merged pair by pair, lowest rank first and leftmost among equals,
with a heap of pairs over linked bytes. Each different pre-token of a task is worked out once.

Defined results: null or empty text has no ids; null ids decode to no bytes; an id outside the
vocabulary fails. Columns of the input named like a result are replaced. The vocabulary is of fixed
size (a file), so it is broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import rows
from tidemark.llm import text as tx
from tidemark.llm.pretokens import character_classes, pretoken_spans

#: Different pre-tokens that a task remembers before it starts anew.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens by rank, from lines of base64 bytes and rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def hash_tokens(tokens: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(t) for t in tokens])
    data = np.frombuffer(b"".join(tokens), np.uint8)
    return tx.hash_spans(data, np.append(0, ends[:-1]), ends)


def _slot(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    moved = tx.mix(hashes + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (moved % np.uint64(n)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement per bucket, rank per slot): each of the n keys gets its own of n slots.

    Large buckets come first and try displacements until all their keys fall on free slots. Buckets
    of one key then take the free slots that are left, written as negative numbers.
    """
    n = len(hashes)
    buckets = (hashes >> np.uint64(32)) % np.uint64(max(1, n // 4))
    order = np.argsort(buckets, kind="stable")
    names, firsts, sizes = np.unique(buckets[order], return_index=True, return_counts=True)
    displacement = np.zeros(max(1, n // 4), np.int64)
    slots = np.full(n, -1, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        keys = order[firsts[b] : firsts[b] + sizes[b]]
        if sizes[b] == 1:
            break
        tries = np.arange(1, 257)
        while True:
            at = _slot(hashes[keys][None, :], tries[:, None], n)
            fits = (slots[at] < 0).all(1)
            if sizes[b] > 1:
                ordered = np.sort(at, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if fits.any():
                break
            tries = tries + 256
        found = int(np.argmax(fits))
        displacement[int(names[b])] = tries[found]
        slots[at[found]] = keys
    free = np.flatnonzero(slots < 0)
    single = np.flatnonzero(sizes == 1)
    displacement[names[single].astype(np.int64)] = -1 - free
    slots[free] = order[firsts[single]]
    return displacement, slots


def look_up(
    hashes: np.ndarray, displacement: np.ndarray, slots: np.ndarray, keys: np.ndarray
) -> np.ndarray:
    """The rank of each hash, or -1."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(len(displacement))).astype(np.int64)
    moved = displacement[bucket]
    at = np.where(moved < 0, -1 - moved, _slot(hashes, np.maximum(moved, 0), len(slots)))
    rank = slots[at]
    return np.where(keys[rank] == hashes, rank, -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token that is no token itself."""
    n = len(piece)
    end = list(range(1, n + 1))
    prior = list(range(-1, n))
    pair = [-1] * n
    heap = []
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2], -1)
        if rank >= 0:
            pair[i] = rank
            heap.append(rank << 32 | i)
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        if pair[i] != top >> 32:
            continue
        middle = end[i]
        stop = end[i] = end[middle]
        pair[middle] = pair[i] = -1
        if stop < n:
            prior[stop] = i
            rank = get(piece[i : end[stop]], -1)
            if rank >= 0:
                pair[i] = rank
                heapq.heappush(heap, rank << 32 | i)
        before = prior[i]
        if before >= 0:
            rank = pair[before] = get(piece[before:stop], -1)
            if rank >= 0:
                heapq.heappush(heap, rank << 32 | before)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Memory:
    """What one task knows about pre-tokens: a list of numbers for each, found by hash."""

    def __init__(self, work: Callable[[list[bytes], np.ndarray], list[list[int]]]):
        self.work = work
        self.clear()

    def clear(self) -> None:
        self.places: dict[int, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def lists(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(place of each span's list, number of entries of it)."""
        hashes = tx.hash_spans(data, starts, ends)
        different, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.places) + len(different) > REMEMBERED:
            self.clear()
        places = self.places
        known = np.array([places.get(h, -1) for h in different.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            made = self.work([raw[a:b] for a, b in spans], different[new])
            base = len(self.offsets) - 1
            known[new] = np.arange(base, base + len(new))
            places.update(zip(different[new].tolist(), range(base, base + len(new)), strict=True))
            sizes = np.array([len(x) for x in made], np.int64)
            self.offsets = np.append(self.offsets, self.offsets[-1] + np.cumsum(sizes))
            more = np.fromiter((y for x in made for y in x), np.int32, int(sizes.sum()))
            self.flat = np.append(self.flat, more)
        place = known[inverse]
        return place, self.offsets[place + 1] - self.offsets[place]

    def gather(self, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.offsets[place] - ends + sizes, sizes) + np.arange(total)]


def speller(tokens: list[bytes]) -> Callable[[np.ndarray, np.ndarray], pa.Array]:
    """What turns (ids, bounds of the rows among them) into the bytes of each row."""
    blob = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    sizes = np.diff(ends, prepend=0)
    begins = ends - sizes

    def spell(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
            raise ValueError("an id is outside the vocabulary")
        length = sizes[ids]
        stop = np.append(0, np.cumsum(length))
        at = np.repeat(begins[ids] - stop[:-1], length) + np.arange(stop[-1])
        offsets = stop[bounds].astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(blob[at])]
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)

    return spell


def encode(
    docs: DataFrame, vocabulary: str, text: str = "text", spelled: bool = False
) -> DataFrame:
    """``docs`` with ``ids``, an array of the ids of the whole text. With ``spelled``, the ids are
    decoded in the same pass, to ``decoded`` as :func:`decode` gives it."""
    tokens = read_ranks(vocabulary)
    keys = hash_tokens(tokens)
    shared = docs.sparkSession.sparkContext.broadcast(
        (tokens, keys, *perfect_hash(keys), character_classes())
    )

    def start() -> rows.Make:
        tokens, keys, displacement, slots, classes = shared.value
        ranks = {token: rank for rank, token in enumerate(tokens)}

        def work(spans: list[bytes], hashes: np.ndarray) -> list[list[int]]:
            found = look_up(hashes, displacement, slots, keys).tolist()
            return [
                [rank] if rank >= 0 and tokens[rank] == span else merge(span, ranks)
                for span, rank in zip(spans, found, strict=True)
            ]

        memory = Memory(work)
        spell = speller(tokens) if spelled else None

        def make(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            starts, ends, firsts = pretoken_spans(data, offsets, classes)
            place, sizes = memory.lists(data, starts, ends)
            bounds = np.append(0, np.cumsum(sizes))[firsts]
            flat = memory.gather(place, sizes)
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
            return [ids, spell(flat, bounds)] if spell else [ids]

        return make

    return rows.add_columns(docs, text, "ids array<int>" + ", decoded binary" * spelled, start)


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the bytes that the ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kept = rows.without(docs, ["decoded"])
    given = kept.columns
    names = [*given, "decoded"]
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(shared.value)
        for whole in batches:
            counts = whole.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in tx.pieces(np.append(0, np.cumsum(counts)), tx.PIECE // 8):
                batch = whole.slice(a, b - a)
                flat = batch.column(ids).flatten().to_numpy(zero_copy_only=False)
                out = spell(flat, np.append(0, np.cumsum(counts[a:b])))
                arrays = [batch.column(batch.schema.names.index(c)) for c in given]
                yield pa.RecordBatch.from_arrays([*arrays, out], names)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, schema)
