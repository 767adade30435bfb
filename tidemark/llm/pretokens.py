"""The pre-tokens of byte-level vocabularies, found by classes of characters instead of backtracking.

Equal to splitting by the usual pattern: contractions; letters, digits or other signs with at most one
blank before them; white space, whose last blank goes to the word that follows.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)

#: Code points with the property White_Space.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


def character_classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    classes = bytearray(
        kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)
    )
    table = np.frombuffer(bytes(classes), np.uint8).copy()
    table[WHITE_SPACE] = SPACE
    return table


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lead = data[at].astype(np.uint32)
    if not (lead >= 0x80).any():
        return lead
    padded = np.append(data, np.zeros(3, np.uint8))
    value = lead.copy()
    for low, high, bits, extra in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 256, 0x07, 3)):
        some = np.flatnonzero((lead >= low) & (lead < high))
        part = lead[some] & bits
        for j in range(1, extra + 1):
            part = (part << 6) | (padded[at[some] + j] & 0x3F)
        value[some] = part
    return value


def pretoken_spans(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens in bytes, and for each row its first one's number."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(at)
    if not n:
        return at, at, np.zeros(len(offsets), np.int64)
    point = _code_points(data, at)
    kind = classes[point]
    opens = np.zeros(n + 1, bool)  # the first character of a row, and the end
    opens[np.searchsorted(at, offsets[:-1][offsets[1:] > offsets[:-1]])] = True
    opens[n] = True
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    token = run.copy()

    # White space before something else: its last character stands alone, or goes with what follows.
    last = np.flatnonzero((kind == SPACE) & run[1:] & ~opens[1:])
    token[last] = True
    token[last[point[last] == 0x20] + 1] = False

    quote = np.flatnonzero((point == ord("'")) & token[:n] & run[1:] & ~opens[1:])
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        padded = np.append(point, [0, 0])
        one = padded[quote + 1]
        two = np.where(opens[np.minimum(quote + 2, n)], 0, padded[quote + 2])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            double |= (one == ord(pair[0])) & (two == ord(pair[1]))
        token[quote[single | double] + 1] = False
        token[quote[single] + 2] = True
        token[quote[double] + 3] = True
    starts = at[token[:n]]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)
