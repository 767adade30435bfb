"""Filter audit, whitening and top-k search against brute force, with the hard cases in every column."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tidemark.llm import audit, topk, whitening  # noqa: E402
from tidemark.llm import vectors as vec  # noqa: E402
from tidemark.llm.queries import QUERIES  # noqa: E402
from tidemark.llm.spectrum import Spectrum, rank_one, secular_roots  # noqa: E402


def failing(doc_id, text, first):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(w) < 200 else ""
    out += "B" if 100 * len(set(w)) < 50 * len(w) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and first[text] is not None and first[text] < doc_id else "")


def audit_by_force(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        known = [x for x in (doc_id, first.get(text or "")) if x is not None]
        first[text or ""] = min(known) if known else None
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, text, source in docs:
        parts[source or ""].append((failing(doc_id, text, first), doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        shapley, steps = Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                steps[part, order, step] = (
                    len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                    sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone),
                )
        out |= {k: (*v, shapley[k[1][k[2] - 1]]) for k, v in steps.items()}
    return out


def test_audit(spark):
    rng = random.Random(3)
    plenty = [f"w{i}" for i in range(260)]
    texts = [None, "", " \t\n", "A", "x" * 50_000, "one $ two", "ÄÖÜ É", " ".join(plenty), " ".join(plenty[:199])]
    texts += [" ".join(rng.choices(plenty[:90], k=200)) for _ in range(3)]
    texts += [" ".join(plenty[:200]) + " " + s for s in ("#", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "& " * 300 + "ABC" * 20)]
    texts += ["word " * 300_000, "a\x0bb\x0cc\x1cd\x85e\xa0f"]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, "", "u"])) for i in range(150)]
    docs += [(500 + i, texts[7], "hot") for i in range(100)]
    docs += [(None, t, "s") for t in texts] + [(3, texts[7], "s")] * 4 + [(3, texts[7], "t"), (-5, "A", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.choices(range(700), k=300)]
    labels += [(None, 1, 1), (3, 0, 0), (3, 1, 1)]
    given = spark.createDataFrame(
        [(*d, "x", 1, 2) for d in docs], "doc_id long, text string, source string, id string, mask int, n int"
    ).repartition(4)
    marks = spark.createDataFrame(
        [(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string"
    )
    want = audit_by_force(docs, labels)
    rows = audit.audit_quality(given, marks).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == want and len(rows) == len(want)
    # A row of every part, order and step also where nothing fails, and nothing for no documents.
    fine = given.where("doc_id = 999")
    assert audit.audit_quality(fine, marks).count() == 0
    unmarked = audit.audit_quality(given, marks.where("false")).collect()
    assert {r.good_lost + r.toxic_lost for r in unmarked} == {0}
    assert [r.removed for r in unmarked if r.part == "u"] and Counter(r.part for r in unmarked)["u"] == 600


def test_lehmer_intervals():
    for filters in (1, 2, 3, 4):
        orders = list(itertools.permutations(range(filters)))
        table = defaultdict(int)
        for mask, step, start, end in audit.intervals(filters).tolist():
            for rank in range(start, end):
                table[mask, step, rank] += 1
        for mask in range(1 << filters):
            for rank, order in enumerate(orders):
                steps = [s for s in range(filters) if table[mask, s, rank]]
                assert steps == [s for s, f in enumerate(order) if mask >> f & 1][:1]
        assert max(table.values()) == 1


def test_audit_of_given_masks(spark):
    masks = spark.createDataFrame(
        [("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 3, 1, 0, 0), (None, 2, 1, 0, 1)],
        "part string, mask int, n long, good long, toxic long",
    )
    rows = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit(masks, "AB").collect()}
    assert rows["p", "AB", 1] == (5, 3, 0, 0, 1, 1, 3) and rows["p", "AB", 2] == (5, 0, 3, 0, 0, 0, 3)
    assert rows["", "BA", 1] == (0, 1, 0, 1, 0, 1, 2) and len(rows) == 8
    for wrong in ("", "BA", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError, match="letters"):
            audit.audit(masks, wrong)


def test_rank_one_changes():
    rng = np.random.default_rng(5)
    d, z2 = np.array([0.0, 1e-9, 1.0, 5.0]), np.array([0.1, 1e-12, 0.3, 0.6])
    roots, delta = secular_roots(d, z2, 2.0)
    assert (roots[:-1] > d[:-1]).all() and (roots[:-1] < d[1:]).all()
    assert np.allclose(0.5 + (z2[:, None] / delta).sum(axis=0), 0, atol=1e-9 * (z2[:, None] / abs(delta)).max())
    for width, many, step in ((1, 9, 1), (4, 60, 1), (12, 9, 1), (20, 90, 7)):
        x = np.floor(rng.normal(size=(many, width)) * 9 / step) * step
        x[:, width // 2] = x[:, 0]  # a direction without any spread, and values that coincide
        parts = []
        for some in (x[: many // 3], x[many // 3 :], x[:0]):
            s = Spectrum(width)
            for row in some:
                s.add(row)
            parts.append(s)
        whole = Spectrum(width)
        for s in parts:
            whole.merge(Spectrum.load(s.dump()))
        apart = x - x.mean(axis=0)
        scatter = apart.T @ apart
        size = np.abs(scatter).max()
        assert np.allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, scatter, atol=1e-12 * size)
        assert np.allclose(whole.vectors.T @ whole.vectors, np.eye(width), atol=1e-12)
    same = rank_one(np.zeros(3), np.eye(3), np.zeros(3), 1.0)
    assert (same[0] == 0).all() and (same[1] == np.eye(3)).all()


EMBEDDINGS = "vec_id long, embedding array<float>, component int, x string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    some = (rng.normal(size=(300, 9)) * [1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]).astype(np.float32)
    out = [(i, [float(c) for c in v]) for i, v in enumerate(some)]
    out += [(1000 + i, out[7][1]) for i in range(200)]  # one vector with very many copies
    out += [(7, out[8][1]), (20, out[20][1]), (20, out[21][1]), (None, out[3][1]), (None, out[200][1])]
    out += [(2000, [0.5]), (2020, []), (-40, out[60][1])]
    bad = [(3000, None), (3020, [1.0, None]), (3040, [math.nan]), (3060, [math.inf, 1.0]), (None, None)]
    return out, bad


@pytest.fixture(scope="module")
def embeddings(spark, rows):
    return spark.createDataFrame([(*r, 4, "x") for r in rows[0] + rows[1]], EMBEDDINGS).repartition(5).cache()


def integers(rows, offset=0, width=9):
    x = np.zeros((len(rows), width), np.int64)
    for i, (_, v) in enumerate(rows):
        x[i, : len(v)] = np.floor(64 * np.array(v, np.float32).astype(float)) if v else 0
    return x + offset


def test_whitening(spark, rows, embeddings):
    x = integers(rows[0], 1_000_000)
    listed = np.unique(x, axis=0)
    n, s = len(listed), listed.sum(axis=0)
    y = (n * listed - s) / n
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    for given in (embeddings, embeddings.repartition(1)):
        model = whitening.fit(given, components=6)
        assert model.n == n and model.sums == tuple(s) and model.error < 1e-10
        assert np.allclose(model.values, values[:6], rtol=1e-12)
        got = whitening.whiten(given, model).collect()
        assert len(got) == 6 * len(x)
        sign = np.sign((model.components * axes[:, :6]).sum(axis=0))
        want = Counter()
        white = (n * x - s) / n @ (axes[:, :6] * sign) / np.sqrt(values[:6])
        for (key, _), v, w in zip(rows[0], n * x - s, white, strict=True):
            want.update((key, c + 1, n, int((v * v).sum()), round(float(w[c]), 8) + 0.0) for c in range(6))
        assert Counter((*tuple(r)[:4], round(r.whitened, 8) + 0.0) for r in got) == want
        for r in got:
            assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12
            assert r.identity_error == model.error


def test_whitening_of_little(spark, embeddings):
    assert whitening.fit(embeddings.where("false")) is None
    none = whitening.whiten(embeddings, None)
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert none.count() == 0
    bad = embeddings.where("vec_id >= 3000 OR vec_id = 2020")
    assert whitening.whiten(bad, whitening.fit(bad)).count() == 0
    equal = embeddings.where("vec_id BETWEEN 1000 AND 1100")
    model = whitening.fit(equal)
    assert model.n == 1 and not len(model.values) and whitening.whiten(equal, model).count() == 0
    # Two vectors span one dimension; sums beyond 64 bits stay exact, what can't be held is held at the end.
    wide = spark.createDataFrame([(1, [0.0, 1e17]), (2, [0.0, -1e17]), (2, [0.0, -1e17])], "vec_id int, embedding array<double>")
    model = whitening.fit(wide)
    got = whitening.whiten(wide, model).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and {r.n for r in got} == {2}
    assert {round(abs(r.whitened), 9) for r in got} == {1.0} and {r.deviation for r in got} == {(1 << 63) - 1}


def top_by_force(rows, k):
    x = integers(rows).astype(object)
    asked = {(key, tuple(v)) for (key, _), v in zip(rows, x, strict=True) if key is not None and key % 20 == 0}
    out = []
    for key, q in asked:
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), c is None, c or 0) for (c, _), v in zip(rows, x, strict=True) if c != key]
        best = sorted(scored)[:k]
        out += [(key, i + 1, None if gone else c, -score) for i, (score, gone, c) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("k", [1, 20, 230, 2000])
def test_top_k(rows, embeddings, k):
    got = Counter(tuple(r) for r in topk.top_k(embeddings, k).collect())
    assert got == top_by_force(rows[0], k)


def test_top_k_in_groups_and_steps(monkeypatch, rows, embeddings):
    monkeypatch.setattr(topk, "GROUP_QUERIES", 4)
    monkeypatch.setattr(topk, "TASK_SCORES", 500)
    got = Counter(tuple(r) for r in topk.top_k(embeddings, 20).collect())
    assert got == top_by_force(rows[0], 20)


def test_top_k_of_little(spark, embeddings):
    for given in (embeddings.where("false"), embeddings.where("vec_id = 21"), embeddings.where("vec_id >= 3000")):
        assert topk.top_k(given).count() == 0
    assert topk.top_k(embeddings.where("vec_id = 60")).columns == ["query_id", "rank", "vec_id", "score"]
    few = spark.createDataFrame([(0, [1.5]), (3, [-2.0]), (2, [-2.0])], "vec_id int, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few).orderBy("rank").collect()] == [(0, 1, 2, -96 * 128), (0, 2, 3, -96 * 128)]
    # Scores past 2**24 and 2**53 are exact too; beyond 2**62 they are held.
    big = [(0, [1e3, 3.0]), (1, [1e3, 4.0]), (20, [1e8, 1.0]), (2, [1e8, -1.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])]
    for some in (big[:2], big[:4], big):
        x = [[max(min(math.floor(64 * c), 1 << 62), -(1 << 62)) for c in v] for _, v in some]
        got = topk.top_k(spark.createDataFrame(some, "vec_id int, embedding array<double>"), 3).collect()
        for r in got:
            a, b = (x[[i for i, _ in some].index(key)] for key in (r.query_id, r.vec_id))
            exact = sum(p * q for p, q in zip(a, b, strict=True))
            assert r.score == max(min(exact, topk.MOST), -topk.MOST)


def test_padding(spark):
    shown = spark.createDataFrame([([0.5, -0.01],), ([],)], "v array<double>")
    numbers = shown.select(vec.padded(vec.as_integers("v", 64), 3).alias("x")).collect()
    assert [r.x for r in numbers] == [[32, -1, 0], [0, 0, 0]]


def test_queries_agree_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = integers(given, 1_000_000, len(given[0][1]))
    listed = np.unique(x, axis=0)
    n, s = len(listed), listed.sum(axis=0)
    y = (n * listed - s) / n
    values = np.linalg.eigvalsh(y.T @ y / n)[::-1]
    got = QUERIES["op11_whitening"](spark, sf).collect()
    assert len(got) == 16 * len(given)
    deviation = {key: int(((n * v - s) ** 2).sum()) for (key, _), v in zip(given, x, strict=True)}
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10
