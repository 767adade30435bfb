"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The different pre-tokens of a piece of text, sorted, are the trie in depth-first order: what follows
a prefix that two of them share is worked out once. At each trie node the forward score is the best
sum of token scores that spells the prefix; a node that ends a pre-token stores its token count.

A token of rank ``r`` among ``n`` scores the logarithm of a Zipf law, ``1 / ((r + 1) * H(n))``, as a
whole number of millionths, so that sums are exact. Among equal scores the fewest tokens win. A byte
that is no token itself counts as one token of a score below all others.

Defined results: null or empty text has no pre-tokens and no tokens. Columns named like a result are
replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import rows
from tidemark.llm.bpe import Memory, read_ranks
from tidemark.llm.pretokens import character_classes, pretoken_spans


def zipf_scores(n: int) -> list[int]:
    total = math.log(math.fsum(1 / (i + 1) for i in range(n)))
    return [-round(1e6 * (math.log(r + 1) + total)) for r in range(n)]


def token_trie(tokens: list[bytes]) -> tuple[dict[int, int], list[int]]:
    """(child of node << 8 | byte, score of each node; 0 where no token ends)."""
    scores = zipf_scores(len(tokens))
    children: dict[int, int] = {}
    ends = [0]
    for token, score in zip(tokens, scores, strict=True):
        node = 0
        for byte in token:
            node = children.setdefault(node << 8 | byte, len(ends))
            if node == len(ends):
                ends.append(0)
        ends[node] = score
    unknown = min(scores) - 10_000_000
    for byte in range(256):
        node = children.setdefault(byte, len(ends))
        if node == len(ends):
            ends.append(0)
        ends[node] = ends[node] or unknown
    return children, ends


def _under_way(span: bytes, at: int, get, longest: int) -> list[tuple[int, int]]:
    """Tokens that may have begun before ``at`` and reach beyond it: their nodes there, and their starts."""
    found = []
    for start in range(max(0, at - longest), at):
        node = 0
        for byte in span[start:at]:
            node = get(node << 8 | byte)
            if node is None:
                break
        else:
            found.append((node, start))
    return found


def count_tokens_sorted(
    spans: list[bytes], children: dict[int, int], ends: list[int], longest: int
) -> list[int]:
    """The token count of each of the ascending ``spans``; no token has more than ``longest`` bytes.

    Scores are kept for the bytes of one span. Tokens under way are kept for the current byte alone, and
    found again where the next span leaves the prefix that it shares.
    """
    score, count = [0], [0]
    out, before = [], b""
    get = children.get
    for span in spans:
        depth, most = 0, min(len(span), len(before))
        while depth < most and span[depth] == before[depth]:
            depth += 1
        del score[depth + 1 :], count[depth + 1 :]
        reach = _under_way(span, depth, get, longest) if depth < len(span) else []
        for at in range(depth, len(span)):
            byte = span[at]
            open_here, best, fewest = [], None, 0
            for node, start in [*reach, (0, at)]:
                node = get(node << 8 | byte)
                if node is None:
                    continue
                open_here.append((node, start))
                if value := ends[node]:
                    value += score[start]
                    n = count[start] + 1
                    if best is None or value > best or value == best and n < fewest:
                        best, fewest = value, n
            score.append(best)
            count.append(fewest)
            reach = open_here
        out.append(count[len(span)])
        before = span
    return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_pretokens`` and ``n_tokens`` of each whole text."""
    tokens = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(
        (*token_trie(tokens), max(map(len, tokens)), character_classes())
    )

    def start() -> rows.Make:
        children, ends, longest, classes = shared.value

        def work(spans: list[bytes], _: np.ndarray) -> list[list[int]]:
            order = sorted(range(len(spans)), key=spans.__getitem__)
            out: list[list[int]] = [[]] * len(spans)
            counts = count_tokens_sorted([spans[i] for i in order], children, ends, longest)
            for i, n in zip(order, counts, strict=True):
                out[i] = [n]
            return out

        memory = Memory(work)

        def make(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            starts, stops, firsts = pretoken_spans(data, offsets, classes)
            place, sizes = memory.lists(data, starts, stops)
            total = np.append(0, np.cumsum(memory.gather(place, sizes), dtype=np.int64))
            return [pa.array(np.diff(firsts)), pa.array(np.diff(total[firsts]))]

        return make

    return rows.add_columns(docs, text, "n_pretokens long, n_tokens long", start)
