"""Whole texts as byte arrays: words, shingles and their 64-bit hashes, vectorised over many rows.

A hash stands for the word or word sequence it was made of. Hashes are 64 bits wide, so among ``n``
different sequences about ``n * n / 2**65`` pairs are mistaken for each other. Words of up to
:data:`LONG_WORD` bytes are hashed by a polynomial modulo 2**64, for which there are words of a thousand
bytes and more that collide by construction; longer ones are hashed one by one with BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is one piece.
PIECE = 2 << 20
#: Bytes that are hashed at once; a running hash takes some 40 bytes of memory for each.
HASH_PIECE = 1 << 20
#: Bytes of a word from which a polynomial is no longer safe.
LONG_WORD = 128

_rng = np.random.default_rng(20240607)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers)


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, rows)
        row = end


def batch_pieces(
    batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of the batches with the bytes and offsets of their text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for a, b in pieces(offsets, size):
            yield (
                batch.slice(a, b - a),
                data[offsets[a] : offsets[b]],
                offsets[a : b + 1] - offsets[a],
            )


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each row its first word's number."""
    inside = ~_SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    edge = offsets[:-1][filled]
    first[edge] = inside[edge]
    edge = offsets[1:][filled] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of one running polynomial if it is short."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + HASH_PIECE, "right")))
        part = _BYTE_VALUE[data[base : ends[j - 1]]]
        running = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers(_ODD, len(part)), out=running[1:])
        lo, hi = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (running[hi] - running[lo]) * _powers(_ODD_INVERSE, len(part) + 1)[lo]
        i = j
    out = mix(out)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        whole = hashlib.blake2b(np.ascontiguousarray(data[starts[k] : ends[k]]), digest_size=8).digest()
        out[k] = int.from_bytes(whole, "little")
    return out


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row its first word's number."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    for a, b in pieces(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, firsts = word_spans(part, offsets[a : b + 1] - offsets[a])
        hashes.append(hash_spans(LOWER[part] if lower else part, starts, ends))
        counts.append(np.diff(firsts))
    joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return joined, np.cumsum(np.concatenate(counts))


def windows(
    words: np.ndarray, firsts: np.ndarray, k: int, short: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the first word) of each run of ``k`` words of one row.

    With ``short``, a row of fewer words (but at least one) has one window of all of them.
    """
    counts = np.diff(firsts)
    left = np.repeat(firsts[1:], counts) - np.arange(len(words))
    at = np.flatnonzero(left >= k)
    few = firsts[:-1][(counts > 0) & (counts < k)] if short else at[:0]
    at = np.sort(np.concatenate([at, few])) if len(few) else at
    total = np.zeros(len(at), np.uint64)
    reach = left[at]
    for j, factor in enumerate(_powers(_STEP, k)):
        value = words[np.minimum(at + j, max(len(words) - 1, 0))] * factor
        total += np.where(reach > j, value, np.uint64(0)) if len(few) else value
    return mix(total), at


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, k: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lower-cased ``k``-word shingles of each row, ascending, and the sets' offsets.

    A row with fewer words has the whole sequence as its one shingle; without words it has none.
    """
    words, firsts = word_hashes(data, offsets, lower=True)
    hashes, at = windows(words, firsts, k, short=True)
    bounds = np.searchsorted(at, firsts)
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([0, *map(len, sets)], np.int64)
    return np.concatenate(sets) if sets else hashes, np.cumsum(sizes)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed byte planes of their differences."""
    deltas = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_sorted(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8)
    deltas = np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1)
    return np.cumsum(deltas, dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int, dtype: type) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), dtype)
