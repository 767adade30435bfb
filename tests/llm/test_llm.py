"""The operators of the llm subpackage against brute force, with the hard cases in every column."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidemark.llm import bpe, language, lm, near, pii, quality, substrings, trie, unigram  # noqa: E402
from tidemark.llm import text as tx  # noqa: E402
from tidemark.llm.decontaminate import count_items, find_items  # noqa: E402
from tidemark.llm.fingerprints import BINS, BITS, add_fingerprint, compare_edited, likeness  # noqa: E402
from tidemark.llm.pretokens import character_classes, pretoken_spans  # noqa: E402
from tidemark.llm.queries import BYTE_BPE, ORACLES, QUERIES  # noqa: E402
from tidemark.llm.samples import labelled_sample  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "语言", "DON'T"]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 90))) for _ in range(30)]
    out = list(base)
    for text in base[:12]:
        for edits in (0, 1, 1, 2, 4, 7):
            w = text.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append("\n".join(w))
    passage = base[0]
    out += [f"{rng.choice(base)}  {passage} {rng.choice(base)}" for _ in range(5)]
    # Words that collide under any polynomial modulo 2**64.
    out += ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(2048)) for flip in (0, 1)]
    out += [None, "", "  \n ", "one", "One", "a b c", "12 ... 34", "x" * 3000, base[0].upper()]
    out.append(" ".join(base) * 20)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", None, "fr"]
    rows = [(i, t, langs[i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", None, None), (None, None, None, None, None)]
    rows += [rows[3], (5, "another text under a number that is taken", "en", "s", 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def test_spans_and_hashes(texts):
    data, offsets = tx.text_bytes(pa.chunked_array([texts[:7], texts[7:]]))
    starts, ends, firsts = tx.word_spans(data, offsets)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        got = [raw[starts[j] : ends[j]].decode() for j in range(firsts[i], firsts[i + 1])]
        assert got == words(text)
    hashes = tx.hash_spans(data, starts, ends)
    spelt = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    assert len(set(hashes.tolist())) == len(set(spelt)) == len(set(zip(spelt, hashes.tolist(), strict=True)))
    sets, bounds = tx.shingle_sets(data, offsets)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]


def test_bpe_equals_tiktoken(spark, docs, nothing):
    tokens = bpe.read_ranks(BYTE_BPE)
    keys = bpe.hash_tokens(tokens)
    displacement, slots = bpe.perfect_hash(keys)
    assert sorted(slots) == list(range(len(tokens)))
    assert (bpe.look_up(keys, displacement, slots, keys) == np.arange(len(tokens))).all()
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={t: i for i, t in enumerate(tokens)},
    )
    rng = random.Random(2)
    signs = [*"aAbst're'vll'dm  \n\t_-!😀", "　", "\x1c", "\x85", "é", "漢", "½", "٣", "'s", "̀"]
    odd = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(500)]
    more = spark.createDataFrame([(i, t, t) for i, t in enumerate(odd)], "doc_id long, text string, IDS string")
    for some in (docs.select("doc_id", "text"), more):
        coded = bpe.decode(bpe.encode(some, BYTE_BPE), BYTE_BPE).collect()
        assert len(coded) == some.count()
        for row in coded:
            assert row["ids"] == library.encode_ordinary(row.text or "")
            assert bytes(row.decoded) == (row.text or "").encode()
    once = bpe.encode(docs, BYTE_BPE, spelled=True).select("doc_id", "ids", "decoded")
    twice = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE).select("doc_id", "ids", "decoded")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert bpe.decode(bpe.encode(nothing, BYTE_BPE), BYTE_BPE).count() == 0
    assert bpe.encode(nothing, BYTE_BPE, spelled=True).count() == 0
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), BYTE_BPE).collect()] == [b""]


def best_count(span, scores, longest=128):
    best = [(0, 0)]
    for end in range(1, len(span) + 1):
        options = [
            (best[s][0] - scores[span[s:end]], best[s][1] + 1)
            for s in range(max(0, end - longest), end)
            if span[s:end] in scores
        ]
        best.append(min(options))
    return best[-1][1]


def test_token_counts(docs, nothing):
    tokens = bpe.read_ranks(BYTE_BPE)
    scores = dict(zip(tokens, unigram.zipf_scores(len(tokens)), strict=True))
    classes = character_classes()
    for row in unigram.count_tokens(docs.select("text"), BYTE_BPE).collect():
        data, offsets = tx.text_bytes(pa.array([row.text], pa.string()))
        starts, ends, _ = pretoken_spans(data, offsets, classes)
        spans = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        if len(spans) < 200:
            assert (row.n_pretokens, row.n_tokens) == (len(spans), sum(best_count(s, scores) for s in spans))
    assert max(map(len, tokens)) <= 128
    children, ends = unigram.token_trie(tokens)
    many = [b"=" * 30_000, b"=" * 30_000 + b"-", b"=" * 29_000 + b"ab", *[b"ab" * n for n in range(1, 90)], b"absolutely"]
    counts = unigram.count_tokens_sorted(sorted(many), children, ends, 128)
    assert counts == [best_count(s, scores) for s in sorted(many)]
    assert unigram.count_tokens(nothing, BYTE_BPE).count() == 0


def test_near_duplicates(docs, nothing, monkeypatch):
    monkeypatch.setattr(near, "ROUNDS", 1)
    rows = near.near_duplicates(docs).collect()
    given = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in given]
    label = list(range(len(sets)))

    def find(i):
        return i if label[i] == i else find(label[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(given):
        if r.doc_id is not None:
            members[find(i)].append(r.doc_id)
    want = Counter(
        (r.doc_id, len(sets[i]), min(members[find(i)], default=None) if sets[i] else r.doc_id)
        for i, r in enumerate(given)
    )
    assert Counter(tuple(r) for r in rows) == want
    assert near.near_duplicates(nothing).count() == 0


def test_substrings(docs, nothing):
    given = [r for r in docs.select("doc_id", "text").collect()]
    first = {}
    for r in given:
        w = words(r.text)
        for i in range(len(w) - 12):
            if r.doc_id is not None:
                run = tuple(w[i : i + 13])
                first[run] = min(first.get(run, r.doc_id), r.doc_id)
    want = Counter()
    for r in given:
        w = words(r.text)
        gone = set()
        for i in range(len(w) - 12):
            if r.doc_id is not None and first[tuple(w[i : i + 13])] < r.doc_id:
                gone.update(range(i, i + 13))
        want[r.doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = substrings.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert all(sum(s["end"] - s["start"] for s in r.removed) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)
    assert substrings.remove_repeats(nothing).count() == 0


def test_language_model(docs, nothing):
    given = docs.select("doc_id", "text").collect()
    part = docs.selectExpr("doc_id", "text", "crc32(cast(doc_id AS string)) % 5 <> 1 AS train")
    tokens = [[*words(lower(r.text)), "</s>"] for r in given]
    train = [t for t, r in zip(tokens, given, strict=True)
             if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    one["<s>"], total = len(train), sum(one.values())
    norm = total + 0.5 * (len(one))
    want = []
    for r, t in zip(given, tokens, strict=True):
        base = [(one[w] + 0.5) / norm for w in t]
        full = [
            two[v, w] / (one[v] + lm.MU) + lm.MU / (one[v] + lm.MU) * b
            for v, w, b in zip(["<s>", *t], t, base, strict=False)
        ]
        want.append((r.doc_id or -1, len(t), sum(one[w] > 0 for w in t), sum(map(math.log10, base)), sum(map(math.log10, full))))
    got = [
        (r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens)
        for r in lm.score_texts(part, "train").collect()
    ]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[5] == total
        assert abs(a[3] - b[3]) < 1e-6 and abs(a[4] - b[4]) < trie.STEP * b[1]
    assert lm.score_texts(nothing.selectExpr("doc_id", "text", "true AS train"), "train").count() == 0


@pytest.mark.parametrize("seen", [100, 50_000_000, 300_000_000, 1 << 50])
def test_rare_successors_of_frequent_contexts(seen):
    column = {"shard": pa.array([0], pa.int32()), "block": pa.array([7], pa.int32()), "n": pa.array([2], pa.int32()), "m": pa.array([1], pa.int32())}
    keys = np.array([3, 9], "<u8").view(np.uint8).reshape(2, 8)[:, : trie.KEY_BITS // 8]
    packed = {
        "contexts": tx.pack_sorted(np.array([5], np.uint64)), "seen": tx.pack(np.array([seen])),
        "runs": tx.pack(np.array([2], np.uint32)), "keys": tx.pack(keys.T), "counts": tx.pack(np.array([1, 40], np.uint32)),
    }
    reply = lm._answer_bigrams((), pa.table(column | {k: pa.array([v], pa.binary()) for k, v in packed.items()}))
    codes = lm._word_counts(reply, 2, getattr(trie, "CODE", np.uint8))
    off = np.log10(trie.LEVELS[codes]) - np.log10(np.array([1, 40]) / (seen + lm.MU))
    assert abs(off).max() <= 0.5001 * trie.STEP


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (900, 3000), (3000, 1 << 62), (2000, 2100), (900, 1 << 63)])
def test_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    asked = np.concatenate([values, rng.integers(0, max(2, top), 500, dtype=np.uint64)])
    place = {v: i for i, v in enumerate(values.tolist())}
    assert trie.Sequence.of(values).find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
    if n and top < 1 << 63:  # the unary part is as long as the greatest upper part
        sequence = trie.Sequence.of(values)
        assert sequence.get(np.arange(len(values))).tolist() == values.tolist()
        some = rng.integers(0, len(values), 300)
        assert sequence.get(some).tolist() == values[some].tolist()


def test_tries():
    rng = np.random.default_rng(11)
    grams = np.unique(
        np.stack([rng.integers(0, 300, 9000) ** 2, rng.integers(0, 500, 9000)], axis=1).astype(np.uint64), axis=0
    )
    codes = rng.integers(1, 900, len(grams)).astype(trie.CODE)
    asked = np.concatenate([grams, rng.integers(0, 90_000, (3000, 2)).astype(np.uint64)])
    asked = asked[np.lexsort((asked[:, 1], asked[:, 0]))]
    known = {tuple(g): c for g, c in zip(grams.tolist(), codes.tolist(), strict=True)}
    for some in (grams, grams[:1], grams[:0]):
        built = trie.Trie.of(some[:, 0], some[:, 1], codes[: len(some)]).mapped()
        got = built.look_up(asked[:, 0], asked[:, 1]).tolist()
        kept = set(map(tuple, some.tolist()))
        assert got == [known[tuple(g)] if tuple(g) in kept else 0 for g in asked.tolist()]
        assert not len(built.look_up(asked[:0, 0], asked[:0, 1]))


def test_fingerprints(docs, nothing):
    rows = add_fingerprint(docs.select("doc_id", "text")).collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", bytes(r.fingerprint)) == bytes(r.fingerprint)
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    named = sorted((r for r in given if r[0] is not None), key=lambda r: (r[0], r[1].encode()), reverse=True)
    follows = list(zip(named, [*named[1:], named[0]], strict=True))
    follows += [(r, named[0]) for r in given if r[0] is None]
    errors, want = [], Counter()
    for (doc_id, text), (_, after) in follows:
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        want[doc_id, len(text), edited, naive_print(text), naive_print(edited)] += 1
    got = compare_edited(docs).collect()
    assert Counter((*tuple(r)[:3], bytes(r.fingerprint), bytes(r.edited_fingerprint)) for r in got) == want
    near = {}
    for (doc_id, text), (_, after) in follows:
        near.setdefault((doc_id, len(text), naive_print(text)), set()).add(after)
    for r in got:
        a = by_text_of(given, r)
        for likeness_of, others in ((r.near_edited, {r.edited}), (r.near_next, near[r.doc_id, r.n_chars, bytes(r.fingerprint)])):
            errors.append(min(abs(likeness_of - jaccard(a, b)) for b in others))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    pairs = add_fingerprint(docs.where("doc_id < 40").select("doc_id", "text")).withColumn("none", F.lit(None).cast("binary"))
    alike = pairs.select("text", likeness("fingerprint", "fingerprint").alias("x"), likeness("fingerprint", "none").alias("y"))
    assert {(r.x, r.y) for r in alike.collect()} == {(1.0, None)}
    assert compare_edited(nothing).count() == 0
    alone = compare_edited(docs.where("doc_id IS NULL")).collect()
    assert len(alone) == 2 and all(r.near_next == 1 for r in alone)


def by_text_of(given, row):
    return next(t for i, t in given if i == row.doc_id and naive_print(t) == bytes(row.fingerprint))


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1


def naive_print(text):
    """The fingerprint bin by bin, from the hash of each shingle alone."""
    data, offsets = tx.text_bytes(pa.chunked_array([[text]]))
    hashes = [int(h) for h in tx.shingle_sets(data, offsets)[0]]
    if not hashes:
        return b""
    least = {}
    for h in hashes:
        place = h >> (65 - BINS.bit_length())
        least[place] = min(h, least.get(place, h))
    filled = dict(least)
    for place in range(BINS):
        attempt = 0
        while place not in filled:
            number = (place + attempt * BINS + 1) * 0x9E3779B97F4A7C15 % 2**64
            source = int(tx.mix(np.array([number], np.uint64))[0]) % BINS
            if source in least:
                filled[place] = least[source]
            attempt += 1
    low = [int(tx.mix(np.array([filled[p]], np.uint64))[0]) % 2**BITS for p in range(BINS)]
    digits = "".join(f"{x:0{BITS}b}" for x in low)
    return int(digits, 2).to_bytes(len(digits) // 8, "big")


def test_decontamination(spark, docs, texts, nothing):
    items = [(1, texts[0]), (2, " ".join(texts[1].split()[:12])), (3, None), (4, "one"), (5, "not here at all my friend"), (None, texts[2])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want, held = Counter(), Counter()
    for r in docs.collect():
        for item, text in items:
            q, d = shingles(text), shingles(r.text)
            if q and 100 * len(q & d) >= 80 * len(q):
                want[r.doc_id, item, len(q & d), len(q)] += 1
                held[r.doc_id, r.text] += 1
    got = find_items(docs, benchmark).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got) == want and want
    counted = count_items(docs.withColumn("more_items", docs.doc_id), benchmark).collect()
    assert sum(r.n_items for r in counted) == sum(held.values())
    assert find_items(nothing, benchmark).count() == 0
    assert find_items(docs, benchmark.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_pii(spark, docs, nothing):
    rng = random.Random(3)
    signs = ["a", "_", "@", ".", "x.y", "1", "25", "300", "é", "😀", "-", " ", "+", "4111 1111 1111 1111", "(", ")",
             "+1 (976) 555-9693", "a@b.c", "c_x@d.e-f", "1.2.3.4", "255.255.255.0", "DE89 3704 0044 0532 0130 00",
             " ssn 123-45-6789", "\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(600)]
    texts += [None, "", "a." * 20000 + "@", "1" * 30000, "1.2.3.4 " * 1000]
    rows = pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        want = sorted(
            (m.start(), i, m.end(), kind)
            for i, (kind, pattern) in enumerate(BASE.items())
            for m in re.finditer(pattern, r.text or "")
            if confirmed(kind, m.group())
        )
        assert [(s.start, s.end, s.kind) for s in r.pii if s.kind in BASE] == [(a, b, k) for a, _, b, k in want]
        assert all(r.text[s.start : s.end] == s.value for s in r.pii)
    assert {s.kind for r in rows for s in r.pii} >= {"iban", "ssn"}
    hidden = "é a@b.cc or 4110879877841615."
    one = spark.createDataFrame([(hidden,), (None,)], "text string")
    assert [r.text for r in pii.mask_pii(pii.find_pii(one)).collect()] == ["é [EMAIL] or [CARD].", None]
    plan = pii.find_pii(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.find_pii(nothing).count() == 0


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in language.initial(3).items()}
    x = rng.integers(97, 105, (6, 4)).astype(np.uint8)
    y, weight = np.array([0, 1, 2, 1]), np.full((6, 4), 1 / 24)
    _, g = language.gradients(p, x, y, weight)
    for name in p:
        at = (int(x[2, 1]), 3) if name[0] == "t" else tuple(rng.integers(0, s) for s in p[name].shape)
        losses = []
        for step in (1e-5, -2e-5):
            p[name][at] += step
            losses.append(language.gradients(p, x, y, weight)[0])
        p[name][at] += 1e-5
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op2_language_id"](spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.9 * len(rows)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op5_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) > 0.9 * len(rows)


def test_labels_in_a_table_of_their_own(spark):
    rows = [(i, "ab" * (i % 7) + str(i)) for i in range(40)] + [(3, "ababab3"), (None, "x"), (41, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(
        [(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (41, 1), (99, 0), (5, None)],
        "doc_id long, quality int",
    )
    apart = labelled_sample(texts, "quality", 100, 1, 50, labels=marks)
    whole = {(str(i % 2), dict(rows[:40])[i]) for i in range(20)} | {("0", "ababab3")}
    assert len(apart) == len(set(apart)) and set(apart) == whole
    assert apart == labelled_sample(texts.join(marks, "doc_id"), "quality", 100, 1, 50)
    few = labelled_sample(texts, "quality", 4, 1, 50, labels=marks)
    assert [sum(a == b for a, _ in few) for b in "01"] == [4, 4] and set(few) <= whole


def test_models_without_labels(spark, docs, nothing):
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang", "1 AS score")
    rows = language.predict(unlabelled, language.train(unlabelled)).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    model = language.train(docs)
    for r in language.predict(docs, model).collect():
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
        assert 0 <= r.score <= 1
    assert language.predict(nothing, model).count() == 0
    assert {r.score for r in quality.predict(docs, quality.train(unlabelled, "lang")).collect()} == {0.5}


def test_fingerprint_query(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    rows = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, sf).collect()}
    for here, after in zip(given, [*given[1:], given[0]], strict=True):
        k = len(here.text) // 3
        edited = here.text[: len(here.text) - k] + after.text[:k]
        assert rows[here.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_pipeline(spark, folder, docs, nothing):
    for given in (docs, nothing):
        place = f"{folder}/{'full' if given is docs else 'empty'}"
        given.write.parquet(f"{place}/documents.parquet")
        items = [(1, r.text) for r in docs.where("doc_id = 2").collect()]
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
        now = spark.read.parquet(f"{place}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, place)
            assert now.columns == given.columns, name
        last = corpus_pipeline.run(spark, place)
        assert last.where("NOT round_trip").count() == 0
        if given is docs:
            ids = {r.doc_id for r in last.collect()}
            assert 0 in ids and 2 not in ids and len(ids) < docs.count()
        else:
            assert last.count() == 0


def test_stages_return_all_columns_as_they_got_them(spark, folder, docs):
    more = ("lang_pred", "SCORE", "n_items", "pii", "text_hash", "_doc_id", "block", "stays")
    given = docs.where("doc_id IS NOT NULL").withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in more})
    spark.createDataFrame([(1, "not in any text of these")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, given, folder)
        assert got.columns == given.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in more), name


def test_rows_of_one_id_are_dropped_by_themselves(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(rng.choices([f"v{i}" for i in range(300)], k=60)) for _ in range(4))
    rows = [(3, b), (5, a), (5, b + " more"), (9, a), (9, a), (7, c), (7, c), (7, d), (8, c + " more"), (6, d + " more")]
    rows += [(4, ""), (4, None), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    for given in (docs, docs.repartition(4)):
        got = corpus_pipeline.drop_near_duplicates(spark, given, "").collect()
        want = [(3, b), (5, a), (7, c), (6, d + " more"), (4, ""), (4, None), (None, a)]
        assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_registered():
    assert sorted(QUERIES, key=lambda n: int(re.findall(r"\d+", n)[0])) == list(dict.fromkeys(
        sorted(QUERIES, key=lambda n: int(re.findall(r"\d+", n)[0]))))
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
