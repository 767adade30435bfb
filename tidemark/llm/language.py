"""Language of documents: a bidirectional gated recurrent network over bytes, in numpy.

The network is trained by backpropagation through time on a bounded sample. A text is cut into
windows of :data:`SPAN` bytes, which cover all of it; in each window one gated unit reads forward and
one backward, and every position gets a probability for each language. The probabilities of all
positions that hold letters (or other bytes above 127) are averaged over the document.

Defined results: a null text, or one without a letter, is ``und`` with score 0. With no labelled text
to learn from, every document is ``und``. Columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import rows
from tidemark.llm import text as tx
from tidemark.llm.samples import Adam, labelled_sample

SPAN = 64
UNITS = 8
BATCH = 512

_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function in straight lines: cheap, and exactly 0 or 1 far out."""
    return np.clip(0.2 * x + 0.5, 0, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def read(x: np.ndarray, table: np.ndarray, u: np.ndarray, c: np.ndarray, keep: list | None = None):
    """The states of one gated unit after each step over ``x`` (steps, rows).

    ``table`` has the input weights of each byte (update, reset, candidate), ``u`` the recurrent ones.
    """
    n = u.shape[0]
    h = np.zeros((x.shape[1], n), np.float32)
    for step in x:
        given, back = table[step], h @ u
        gates = _gate(given[:, : 2 * n] + back[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        inner = back[:, 2 * n :] + c
        new = np.tanh(given[:, 2 * n :] + r * inner)
        if keep is not None:
            keep.append((h, z, r, inner, new))
        h = new + z * (h - new)
        yield h


def initial(languages: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {"b": np.zeros(languages, np.float32)}
    for d in "fb":
        out["t" + d] = (0.3 * rng.standard_normal((256, 3 * UNITS))).astype(np.float32)
        out["u" + d] = (rng.standard_normal((UNITS, 3 * UNITS)) / UNITS**0.5).astype(np.float32)
        out["c" + d] = np.zeros(UNITS, np.float32)
        out["v" + d] = (0.3 * rng.standard_normal((UNITS, languages))).astype(np.float32)
    return out


def states(x: np.ndarray, p: dict[str, np.ndarray], name: str):
    """As :func:`read`, for prediction: whole arrays worked on in place."""
    u, n = p["u" + name], UNITS
    parts = [slice(0, n), slice(n, 2 * n), slice(2 * n, 3 * n)]
    slope = [np.float32(0.2), np.float32(0.2), np.float32(1)]
    tables = [np.ascontiguousarray(p["t" + name][:, s] * f) for s, f in zip(parts, slope, strict=True)]
    tables[0] += np.float32(0.5)
    tables[1] += np.float32(0.5)
    us = [np.ascontiguousarray(u[:, s] * f) for s, f in zip(parts, slope, strict=True)]
    size = (x.shape[1], n)
    h, z, r, new, work = (np.zeros(size, np.float32) for _ in range(5))
    for step in x:
        for out, table, weights in ((z, tables[0], us[0]), (r, tables[1], us[1])):
            np.take(table, step, axis=0, out=out, mode="clip")
            np.matmul(h, weights, out=work)
            out += work
            np.clip(out, np.float32(0), np.float32(1), out=out)
        np.matmul(h, us[2], out=work)
        work += p["c" + name]
        work *= r
        np.take(tables[2], step, axis=0, out=new, mode="clip")
        new += work
        np.tanh(new, out=new)
        h -= new
        h *= z
        h += new
        yield h


def scores(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Exponentials of the logits, (steps, rows, languages), for bytes ``x`` (steps, rows)."""
    out = np.empty((*x.shape, len(p["b"])), np.float32)
    for t, h in enumerate(states(x, p, "f")):
        np.matmul(h, p["vf"], out=out[t])
    for t, h in enumerate(states(x[::-1], p, "b")):
        out[len(x) - 1 - t] += h @ p["vb"]
    out += p["b"]
    return np.exp(out, out=out)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """(loss, gradient of every parameter) by backpropagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = {
        "f": list(read(x, p["tf"], p["uf"], p["cf"], kept["f"])),
        "b": list(read(x[::-1], p["tb"], p["ub"], p["cb"], kept["b"])),
    }
    hf, hb = np.stack(states["f"]), np.stack(states["b"])[::-1]
    prob = _softmax(hf @ p["vf"] + hb @ p["vb"] + p["b"])
    truth = prob[:, np.arange(len(y)), y]
    loss = -(np.log(truth + 1e-9) * weight).sum()
    d = prob
    d[:, np.arange(len(y)), y] -= 1
    d *= weight[:, :, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["b"] = d.sum((0, 1))
    for name, h_all in (("f", hf), ("b", hb)):
        g["v" + name] = np.einsum("tbh,tbl->hl", h_all, d, optimize=True)
        outer = d @ p["v" + name].T
        order = range(len(x) - 1, -1, -1) if name == "f" else range(len(x))
        dh = np.zeros_like(outer[0])
        u = p["u" + name]
        for step, t in zip(range(len(x) - 1, -1, -1), order, strict=True):
            h, z, r, inner, new = kept[name][step]
            dh = dh + outer[t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = 0.2 * dh * (h - new) * ((z > 0) & (z < 1))
            dr = 0.2 * dnew * inner * ((r > 0) & (r < 1))
            dinner = dnew * r
            back = np.concatenate([dz, dr, dinner], 1)
            given = np.concatenate([dz, dr, dnew], 1)
            g["u" + name] += h.T @ back
            g["c" + name] += dinner.sum(0)
            np.add.at(g["t" + name], x[t], given)
            dh = dh * z + back @ u.T
    return float(loss), g


def fit(sample: list[tuple[str, str]], epochs: int = 4, seed: int = 7):
    """(languages, parameters) from (language, text) pairs."""
    languages = sorted({label for label, _ in sample})
    xs, ys = [], []
    for label, text in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        for a in range(0, len(raw), SPAN):
            xs.append(np.pad(raw[a : a + SPAN], (0, max(0, a + SPAN - len(raw))), constant_values=32))
            ys.append(languages.index(label))
    p = initial(len(languages), seed)
    if not xs:
        return languages, p
    x, y = np.array(xs, np.uint8), np.array(ys)
    share = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    adam, rng = Adam(p, 0.01), np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(x))
        for a in range(0, len(order), 256):
            some = order[a : a + 256]
            part = np.ascontiguousarray(x[some].T)
            weight = _LETTER[part] * share[y[some]].astype(np.float32)
            _, g = gradients(p, part, y[some], weight / max(weight.sum(), 1e-6))
            adam.step(g)
    return languages, p


def pool(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages): the mean probabilities of the positions of each text."""
    spans = -(-np.diff(offsets) // SPAN)
    row = np.repeat(np.arange(len(spans)), spans)
    firsts = np.cumsum(spans) - spans
    begin = offsets[:-1][row] + SPAN * (np.arange(len(row)) - firsts[row])
    padded = np.append(data, np.full(SPAN, 32, np.uint8))
    total = np.zeros((len(spans), len(p["b"])))
    ones = np.ones(len(p["b"]), np.float32)
    for a in range(0, len(row), BATCH):
        at = begin[a : a + BATCH] + np.arange(SPAN)[:, None]
        x = np.where(at < offsets[1:][row[a : a + BATCH]], padded[at], 32).astype(np.uint8)
        each = scores(p, x)
        each *= (_LETTER[x] / (each @ ones))[:, :, None]
        np.add.at(total, row[a : a + BATCH], each.sum(0))
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def train(docs: DataFrame, label: str = "lang", per_label: int = 300, windows: int = 3):
    """A model from at most ``per_label`` documents of each label, ``windows`` pieces of each."""
    return fit(labelled_sample(docs, label, per_label, windows, 2 * SPAN))


def predict(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language."""
    languages, parameters = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, parameters))

    def start() -> rows.Make:
        languages, p = shared.value

        def make(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            if not languages:
                n = len(offsets) - 1
                return [pa.array(["und"] * n), pa.array([0.0] * n)]
            prob = pool(p, data, offsets)
            best = prob.argmax(1)
            return [pa.array([languages[i] for i in best]), pa.array(prob.max(1).clip(0, 1))]

        return make

    out = rows.add_columns(docs, text, "lang_pred string, score double", start, tx.PIECE // 4)
    lettered = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    return out.withColumns(
        {
            "lang_pred": F.when(lettered, F.col("lang_pred")).otherwise("und"),
            "score": F.when(lettered, F.col("score")).otherwise(0.0),
        }
    )
