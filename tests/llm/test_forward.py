"""The networks against forward passes written out by hand, and queries against the contract, row by row."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import bpe, language, quality  # noqa: E402
from tidemark.llm import text as tx  # noqa: E402
from tidemark.llm.queries import BYTE_BPE, QUERIES  # noqa: E402

TEXTS = ["", "a", "Hello, wörld!", "x" * 64, "y z " * 16 + "e", "ends \n here 123", "q" * 1500, "語 " * 400]


def gate(x):
    return min(1.0, max(0.0, 0.2 * x + 0.5))


def unit(steps, table, u, c):
    """States of one gated unit, value by value."""
    n = len(u)
    h, out = [0.0] * n, []
    for byte in steps:
        back = [sum(h[i] * u[i][j] for i in range(n)) for j in range(3 * n)]
        z = [gate(table[byte][j] + back[j]) for j in range(n)]
        r = [gate(table[byte][n + j] + back[n + j]) for j in range(n)]
        new = [math.tanh(table[byte][2 * n + j] + r[j] * (back[2 * n + j] + c[j])) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
        out.append(h)
    return out


def pooled(p, text):
    raw, total, letters = text.encode(), None, 0
    for a in range(0, len(raw), language.SPAN):
        x = raw[a : a + language.SPAN].ljust(language.SPAN)
        forward = unit(x, p["tf"], p["uf"], p["cf"])
        backward = unit(x[::-1], p["tb"], p["ub"], p["cb"])[::-1]
        for byte, f, b in zip(x, forward, backward, strict=True):
            if byte < 128 and not chr(byte).isalpha():
                continue
            logits = np.array(f) @ p["vf"] + np.array(b) @ p["vb"] + p["b"]
            prob = np.exp(logits - logits.max())
            total = prob / prob.sum() + (0 if total is None else total)
            letters += 1
    return np.zeros(len(p["b"])) if total is None else total / letters


def test_language_probabilities():
    rng = np.random.default_rng(4)
    p = {k: v + (0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in language.initial(3).items()}
    data, offsets = tx.text_bytes(pa.array(TEXTS[:-2] + [TEXTS[-1][:90]]))
    got = language.pool(p, data, offsets)
    plain = {k: v.astype(float).tolist() if k[0] in "tuc" else v for k, v in p.items()}
    for row, text in zip(got, TEXTS[:-2] + [TEXTS[-1][:90]], strict=True):
        assert np.allclose(row, pooled(plain, text), atol=2e-5)


def quality_of(p, text):
    raw = text.encode()
    chunks, start = [], 0
    while raw:
        x = raw[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        best = [
            max(
                sum(float(p["filters"][k][x[i + k]][f]) for k in range(quality.WIDTH))
                for i in range(quality.CHUNK - quality.WIDTH + 1)
            )
            for f in range(quality.FILTERS)
        ]
        chunks.append([max(0.0, b) for b in best])
        # Chunks overlap by less than a filter's width and go on until the text has no new place for one.
        start += quality.STEP
        if start + quality.WIDTH - 1 >= len(raw):
            break
    table = np.array(chunks) if chunks else np.zeros((1, quality.FILTERS))
    x = np.concatenate([table.mean(0), table.max(0)])
    return 1 / (1 + math.exp(-(x @ p["w"] + p["b"][0])))


def test_quality_scores(spark):
    rng = np.random.default_rng(6)
    p = {
        "filters": (0.2 * rng.standard_normal((quality.WIDTH, 256, quality.FILTERS))).astype(np.float32),
        "w": rng.standard_normal(2 * quality.FILTERS).astype(np.float32) / 9,
        "b": np.array([0.1], np.float32),
    }
    edge = ["z" * (quality.CHUNK + d) + "Q" for d in (-2, -1, 0, quality.WIDTH - 2, quality.WIDTH - 1)]
    given = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *edge, None])], "doc_id long, text string")
    for row in quality.predict(given, p).collect():
        assert abs(row.score - quality_of(p, row.text or "")) < 1e-4


def test_byte_bpe_query(spark, folder):
    rng = random.Random(8)
    texts = [None, "", "a", "Été 語 'll", *(" ".join(rng.choices(TEXTS, k=3)) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(BYTE_BPE))},
    )
    rows = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(
        {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }.items()
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_pii_query(spark, folder):
    pieces = ["mail a.b@c.de, ", "1.2.3.4 ", "256.1.1.1 ", "4111 1111 1111 1111 ", "4111-1111-1111-1112 ", "+49 (30) 123-4567 8", "é語😀 "]
    pieces += ["+1 2", "x@y", "00378282246310005", "12.34.56.78.90 ", " ", "DE89 3704 0044 0532 0130 00 ", "\n"]
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op9_pii"](spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        for kind in ("email", "ip", "card", "phone"):
            assert rows[i][f"n_{kind}"] == sum(s.startswith(f"{kind}:") for s in want)
        spans = rows[i].spans.split(",") if rows[i].spans else []
        assert set(want) <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
