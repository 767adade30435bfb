"""Quality of documents: a byte-level convolutional network, in numpy.

Learned filters of :data:`WIDTH` bytes slide over overlapping chunks that cover the whole text. The
strongest response of each filter in a chunk is kept (max pooling); over the chunks of a document both
the mean and the greatest of these are combined into one probability by a logistic layer.

Defined results: a null or empty text has no response and gets the probability of the bias alone.
Without labelled texts every document gets 0.5. Columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import rows
from tidemark.llm import text as tx
from tidemark.llm.samples import Adam, labelled_sample

WIDTH = 5
FILTERS = 16
CHUNK = 256
STEP = CHUNK - WIDTH + 1
CHUNKS = 64


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of every chunk; neighbours overlap by a filter's width less one."""
    sizes = np.diff(offsets)
    number = np.where(sizes > 0, np.maximum(1, -(-(sizes - WIDTH + 1) // STEP)), 0)
    row = np.repeat(np.arange(len(sizes)), number)
    at = np.arange(len(row)) - (np.cumsum(number) - number)[row]
    return row, offsets[:-1][row] + STEP * at


def respond(p: dict, data: np.ndarray, offsets: np.ndarray, places: bool = False):
    """(row of each chunk, greatest response per chunk and filter, bytes, place of the greatest)."""
    row, begin = chunks(offsets)
    padded = np.append(data, np.zeros(CHUNK, np.uint8))
    best = np.empty((len(row), FILTERS), np.float32)
    where = np.empty((len(row), FILTERS), np.int64) if places else None
    texts = np.empty((len(row), CHUNK), np.uint8) if places else None
    for a in range(0, len(row), CHUNKS):
        at = begin[a : a + CHUNKS, None] + np.arange(CHUNK)
        x = np.where(at < offsets[1:][row[a : a + CHUNKS], None], padded[at], 0)
        total = np.take(p["filters"][0], x[:, : 1 - WIDTH], axis=0)
        for k in range(1, WIDTH):
            total += np.take(p["filters"][k], x[:, k : CHUNK + k + 1 - WIDTH], axis=0)
        best[a : a + CHUNKS] = total.max(1)
        if places:
            where[a : a + CHUNKS] = total.argmax(1)
            texts[a : a + CHUNKS] = x
    return row, best, texts, where


def features(row: np.ndarray, best: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2 * filters): mean and maximum over chunks; chunk of each maximum."""
    on = np.maximum(best, 0)
    count = np.bincount(row, minlength=n)
    out = np.zeros((n, 2 * FILTERS), np.float32)
    top = np.full((n, FILTERS), -1)
    filled = np.flatnonzero(count)
    if len(filled):
        firsts = (np.cumsum(count) - count)[filled]
        out[filled, :FILTERS] = np.add.reduceat(on, firsts) / count[filled, None]
        out[filled, FILTERS:] = np.maximum.reduceat(on, firsts)
        hit = on == out[row, FILTERS:]
        for f in range(FILTERS):
            at = np.flatnonzero(hit[:, f])[::-1]
            top[row[at], f] = at
    return out, top


def probability(p: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ p["w"] + p["b"])))


def fit(sample: list[tuple[str, str]], epochs: int = 12, seed: int = 5) -> dict | None:
    """Parameters from (label 0 or 1, text) pairs."""
    if len({label for label, _ in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    p = {
        "filters": (0.2 * rng.standard_normal((WIDTH, 256, FILTERS))).astype(np.float32),
        "w": (0.2 * rng.standard_normal(2 * FILTERS)).astype(np.float32),
        "b": np.zeros(1, np.float32),
    }
    adam = Adam(p, 0.02)
    y = np.array([int(float(label)) for label, _ in sample], np.float32)
    share = len(y) / (2 * np.bincount(y.astype(int), minlength=2))
    for epoch in range(epochs):
        adam.rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(sample))
        for a in range(0, len(order), 32):
            some = order[a : a + 32]
            data, offsets = tx.text_bytes(pa.array([sample[i][1] for i in some]))
            row, best, texts, where = respond(p, data, offsets, places=True)
            x, top = features(row, best, len(some))
            d = (probability(p, x) - y[some]) * share[y[some].astype(int)] / len(some)
            dx = d[:, None] * p["w"]
            count = np.bincount(row, minlength=len(some))
            dbest = dx[row, :FILTERS] / count[row, None]
            r, f = np.nonzero(top >= 0)
            dbest[top[r, f], f] += dx[r, FILTERS + f]
            dbest[best <= 0] = 0
            g = np.zeros_like(p["filters"])
            c, f = np.nonzero(dbest)
            for k in range(WIDTH):
                np.add.at(g[k], (texts[c, where[c, f] + k], f), dbest[c, f])
            adam.step(
                {
                    "filters": g + 1e-5 * p["filters"],
                    "w": x.T @ d + 1e-3 * p["w"],
                    "b": np.array([d.sum()], np.float32),
                }
            )
    return p


def train(
    docs: DataFrame,
    label: str,
    per_label: int = 600,
    chars: int = 6000,
    labels: DataFrame | None = None,
) -> dict | None:
    """A model from at most ``per_label`` documents of each label (0, 1), ``chars`` of each. The labels
    are a column of ``docs``, or of the table ``labels`` with the same ``doc_id``."""
    return fit(labelled_sample(docs, label, per_label, 1, chars, labels=labels))


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> rows.Make:
        p = shared.value

        def make(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            n = len(offsets) - 1
            if p is None:
                return [pa.array(np.full(n, 0.5))]
            row, best, _, _ = respond(p, data, offsets)
            return [pa.array(probability(p, features(row, best, n)[0]).astype(np.float64))]

        return make

    return rows.add_columns(docs, text, "score double", start)
