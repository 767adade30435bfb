"""Scores of whole texts under a bigram model of the corpus, kept in Elias-Fano tries.

A token is a lower-cased word; every text ends with one end token, and its first token follows a start
mark. With c for counts over the training texts, N tokens and V different ones,

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v) = c(v w) / (c(v) + MU) + MU / (c(v) + MU) * p(w)

so the probabilities after each context sum to one. The first term is what a trie keeps, in two
bytes, so that no count of a context is too large for it.

Counts come from all documents. Blocks of documents send their different words to shards, which
answer with total counts; then their different bigrams, to the shard of the context. A context with
many occurrences is spread over several shards by successor. Each shard builds a trie of its bigrams,
maps it into memory and answers the blocks' bigrams from it. So the model is never in one place, and
a word that stands everywhere costs a shard one entry per block.

Defined results: null and empty texts are the end token alone. A row without an id is scored, but not
learnt from. Without training texts N and V are 0. Columns of the input other than id, text and the
training flag are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks
from tidemark.llm import text as tx
from tidemark.llm.trie import CODE, KEY_BITS, LEVELS, Trie, quantise
from tidemark.scratch import materialise

MU = 8.0
#: Occurrences of a context for each shard that it is spread over.
SPREAD = 1 << 17

START = np.uint64(0x5EED5EED5EED5EED)
END = np.uint64(0xE0D0E0D0E0D0E0D0)

SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def stream(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a block, and for each document its first token's number."""
    words, firsts = tx.word_hashes(*tx.text_bytes(docs.column("text")), lower=True)
    sizes = np.diff(firsts) + 1
    bounds = np.append(0, np.cumsum(sizes))
    tokens = np.empty(bounds[-1], np.uint64)
    ends = np.zeros(bounds[-1], bool)
    ends[bounds[1:] - 1] = True
    tokens[ends], tokens[~ends] = END, words
    return tokens, bounds


def _learnt(docs: pa.Table, bounds: np.ndarray) -> np.ndarray:
    return np.repeat(docs.column("train").to_numpy(), np.diff(bounds))


def _counted(inverse: np.ndarray, train: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(inverse[train], minlength=n).astype(np.uint32)


def _send_words(shards: int):
    def send(key: tuple, docs: pa.Table) -> pa.Table:
        tokens, bounds = stream(docs)
        words, inverse = np.unique(tokens, return_inverse=True)
        counts = _counted(inverse, _learnt(docs, bounds), len(words))
        cuts = blocks.shard_bounds(words, shards)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "shard": pa.array(full, pa.int32()),
                "block": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "n": pa.array(np.diff(cuts)[full], pa.int32()),
                "words": pa.array([tx.pack_sorted(words[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
                "counts": pa.array([tx.pack(counts[cuts[s] : cuts[s + 1]]) for s in full], pa.binary()),
            }
        )

    return send


def _joined(table: pa.Table, column: str, sizes: np.ndarray, dtype: type) -> np.ndarray:
    parts = [np.zeros(0, dtype)]
    for packed, n in zip(table.column(column), sizes.tolist(), strict=True):
        parts.append(tx.unpack(packed.as_py(), n, dtype))
    return np.concatenate(parts)


def _sorted_parts(table: pa.Table, column: str, sizes: np.ndarray) -> np.ndarray:
    parts = [np.zeros(0, np.uint64)]
    for packed, n in zip(table.column(column), sizes.tolist(), strict=True):
        parts.append(tx.unpack_sorted(packed.as_py(), n))
    return np.concatenate(parts)


def _replies(table: pa.Table, sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.array([tx.pack(x) for x in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())


def _answer_words(key: tuple, table: pa.Table) -> pa.Table:
    sizes = table.column("n").to_numpy()
    words = _sorted_parts(table, "words", sizes)
    counts = _joined(table, "counts", sizes, np.uint32)
    names, inverse = np.unique(words, return_inverse=True)
    totals = np.bincount(inverse, weights=counts, minlength=len(names)).astype(np.int64)
    rest = [0] * (len(sizes) - 1)
    return pa.table(
        {
            "block": table.column("block"),
            "level": pa.array([1] * len(sizes), pa.int32()),
            "shard": table.column("shard"),
            "n": table.column("n"),
            "reply": _replies(table, sizes, totals[inverse]),
            "known": pa.array([int((totals > 0).sum()), *rest], pa.int64()),
            "total": pa.array([int(totals.sum()), *rest], pa.int64()),
        }
    )


def _bigrams(tokens: np.ndarray, bounds: np.ndarray, inverse: np.ndarray, counts: np.ndarray,
             starts: int, shards: int):
    """The different bigrams of a block, by shard, context and key: (shard, context, key, count of the
    context, the bigram's number for each token, counts of each token's context)."""
    context = np.empty(len(tokens), np.uint64)
    context[1:] = tokens[:-1]
    context[bounds[:-1]] = START
    seen = np.empty(len(tokens), np.int64)
    seen[1:] = counts[inverse[:-1]]
    seen[bounds[:-1]] = starts
    key = tx.mix(tokens) >> np.uint64(64 - KEY_BITS)
    share = key % (1 + seen // SPREAD).astype(np.uint64)
    shard = tx.mix(context + share) >> np.uint64(65 - shards.bit_length())
    whole = tx.mix(context) ^ key
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    order = np.lexsort((key[first], context[first], shard[first]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = first[order]
    return shard[first].astype(np.int64), context[first], key[first], seen[first], place[number], seen


def _word_counts(answers: pa.Table, level: int, dtype: type) -> np.ndarray:
    mine = answers.filter(pc.equal(answers.column("level"), level)).sort_by("shard")
    return _joined(mine, "reply", mine.column("n").to_numpy(), dtype)


def _send_bigrams(shards: int, starts: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        tokens, bounds = stream(docs)
        words, inverse = np.unique(tokens, return_inverse=True)
        counts = _word_counts(answers, 1, np.int64)
        shard, context, key, seen, number, _ = _bigrams(tokens, bounds, inverse, counts, starts, shards)
        train = _counted(number, _learnt(docs, bounds), len(shard))
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        out: dict[str, list] = {k: [] for k in ("shard", "n", "m", "contexts", "seen", "runs", "keys", "counts")}
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[s], cuts[s + 1]
            names, first, runs = np.unique(context[a:b], return_index=True, return_counts=True)
            planes = key[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
            out["shard"].append(s)
            out["n"].append(int(b - a))
            out["m"].append(len(names))
            out["contexts"].append(tx.pack_sorted(names))
            out["seen"].append(tx.pack(seen[a:b][first]))
            out["runs"].append(tx.pack(runs.astype(np.uint32)))
            out["keys"].append(tx.pack(planes.T))
            out["counts"].append(tx.pack(train[a:b]))
        block = docs.column("block")[0].as_py()
        return pa.table(
            {
                "shard": pa.array(out["shard"], pa.int32()),
                "block": pa.array([block] * len(out["shard"]), pa.int32()),
                "n": pa.array(out["n"], pa.int32()),
                "m": pa.array(out["m"], pa.int32()),
                **{k: pa.array(out[k], pa.binary()) for k in ("contexts", "seen", "runs", "keys", "counts")},
            }
        )

    return send


def _answer_bigrams(key: tuple, table: pa.Table) -> pa.Table:
    """Build the shard's trie from the counts that the blocks sent, and look their bigrams up in it."""
    sizes, widths = table.column("n").to_numpy(), table.column("m").to_numpy()
    names = _sorted_parts(table, "contexts", widths)
    runs = _joined(table, "runs", widths, np.uint32)
    contexts = np.repeat(names, runs)
    seen = np.repeat(_joined(table, "seen", widths, np.int64), runs)
    counts = _joined(table, "counts", sizes, np.uint32)
    width = KEY_BITS // 8
    keys = np.zeros((len(contexts), 8), np.uint8)
    row = 0
    for packed, n in zip(table.column("keys"), sizes.tolist(), strict=True):
        keys[row : row + n, :width] = tx.unpack(packed.as_py(), n * width, np.uint8).reshape(width, n).T
        row += n
    keys = keys.view("<u8").reshape(-1)
    # Each different bigram is looked up once, whatever number of blocks ask for it.
    order = np.lexsort((keys, contexts))
    c, k = contexts[order], keys[order]
    first = np.ones(len(order), bool)
    first[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    total = np.add.reduceat(counts[order].astype(np.int64), at)
    c, k, learnt = c[at], k[at], total > 0
    codes = quantise(total[learnt] / (seen[order][at][learnt] + MU))
    found = Trie.of(c[learnt], k[learnt], codes).mapped().look_up(c, k)
    answers = np.empty(len(order), CODE)
    answers[order] = found[np.cumsum(first) - 1]
    return pa.table(
        {
            "block": table.column("block"),
            "level": pa.array([2] * len(sizes), pa.int32()),
            "shard": table.column("shard"),
            "n": table.column("n"),
            "reply": _replies(table, sizes, answers),
        }
    )


def _score(shards: int, starts: int, total: int, known: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        tokens, bounds = stream(docs)
        words, inverse = np.unique(tokens, return_inverse=True)
        counts = _word_counts(answers, 1, np.int64)
        number, seen = _bigrams(tokens, bounds, inverse, counts, starts, shards)[4:]
        codes = _word_counts(answers, 2, CODE)
        mine = counts[inverse]
        base = (mine + 0.5) / (total + 0.5 * (known + 1))
        p = LEVELS[codes[number]] + MU / (seen + MU) * base
        heads = bounds[:-1]
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_tokens": pa.array(np.diff(bounds)),
                "n_known": pa.array(np.add.reduceat((mine > 0).astype(np.int64), heads)),
                "base_score": pa.array(np.add.reduceat(np.log10(base), heads)),
                "score": pa.array(np.add.reduceat(np.log10(p), heads)),
            }
        )

    return score


def score_texts(
    docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), learning where ``train`` is true."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(train) & F.col(doc_id).isNotNull(), F.lit(False)).alias("train"),
    )
    dealt, number, shards = blocks.deal(rows, "doc_id", "text")
    anywhere = F.pmod(F.xxhash64("text"), F.lit(number)).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("doc_id").isNull(), anywhere).otherwise(F.col("block")))
    starts = docs.where(F.col(train) & F.col(doc_id).isNotNull()).count()
    by_block = dealt.groupBy("block")
    sent = by_block.applyInArrow(
        _send_words(shards), "shard int, block int, n int, words binary, counts binary"
    )
    replies = "block int, level int, shard int, n int, reply binary"
    words = materialise(
        sent.groupBy("shard").applyInArrow(_answer_words, f"{replies}, known long, total long"), "words"
    )
    known, total = words.agg(F.sum("known"), F.sum("total")).first()
    known, total = known or 0, total or 0
    words = words.select("block", "level", "shard", "n", "reply")
    sent = by_block.cogroup(words.groupBy("block")).applyInArrow(
        _send_bigrams(shards, starts),
        "shard int, block int, n int, m int, contexts binary, seen binary, runs binary, keys binary, "
        "counts binary",
    )
    bigrams = sent.groupBy("shard").applyInArrow(_answer_bigrams, replies)
    scored = by_block.cogroup(words.unionByName(bigrams).groupBy("block")).applyInArrow(
        _score(shards, starts, total, known), SCHEMA
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
