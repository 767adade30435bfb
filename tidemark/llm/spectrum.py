"""Eigenpairs of a scatter matrix, kept up to date vector by vector.

Adding a vector to a centred scatter matrix is a rank-one change, ``A + w v v'``. In the eigenvectors of
``A`` that is a diagonal matrix plus ``z z'``, whose eigenvalues are the roots of the secular equation
``1 / w + sum(z[i]**2 / (d[i] - m)) = 0``, one between each two neighbouring values ``d``. Entries of ``z``
that vanish, and values that coincide, are *deflated* first: their eigenpairs stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np

EPS = np.finfo(float).eps
_ROUNDS = 60


def secular_roots(d: np.ndarray, z2: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots ``m`` of the secular equation for ascending, distinct ``d``, and the matrix ``d[i] - m[j]``.

    Each root is found as a distance from the nearer of its two poles, so that the differences keep
    their relative precision. The two sums left and right of a root are replaced by simple fractions
    with the same value and slope, whose root is the next guess; a guess outside the bracket is
    replaced by its middle.
    """
    k = len(d)
    gap = np.append(d[1:], d[-1] + weight * z2.sum()) - d
    across = d[:, None] - d[None, :]
    row = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 / weight + (z2[:, None] / (across - gap / 2)).sum(axis=0)
        left = middle >= 0
        left[-1] = True
        pole = np.where(left, row, np.minimum(row + 1, k - 1))
        away = d[:, None] - d[pole][None, :]
        low = np.where(left, 0, -gap / 2)
        high = np.where(left, gap / 2, 0)
        high[-1] = gap[-1]
        t = np.where(left, high / 2, low / 2)
        upper = row[:, None] <= row[None, :]
        for _ in range(_ROUNDS):
            delta = away - t
            part = z2[:, None] / delta
            value = 1 / weight + part.sum(axis=0)
            high = np.where(value > 0, np.minimum(high, t), high)
            low = np.where(value <= 0, np.maximum(low, t), low)
            small = np.abs(value) <= 16 * EPS * (1 / weight + np.abs(part).sum(axis=0))
            if (small | (high - low <= 4 * EPS * np.abs(t))).all():
                break
            slope = part / delta
            below = (slope * upper).sum(axis=0)
            above = slope.sum(axis=0) - below
            to_left = delta[row, row]
            to_right = delta[np.minimum(row + 1, k - 1), row]
            s, r = to_left**2 * below, to_right**2 * above
            c = value - to_left * below - to_right * above
            c[-1] = value[-1] - to_left[-1] * below[-1]
            a = c * (to_left + to_right) + s + r
            b = to_left * to_right * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            move[-1] = to_left[-1] + s[-1] / c[-1]
            guess = t + move
            inside = (guess >= low) & (guess <= high) & (guess != 0)
            t = np.where(small, t, np.where(inside, guess, (low + high) / 2))
    return d[pole] + t, away - t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of ``vectors diag(values) vectors' + weight v v'``."""
    z = v @ vectors
    length = np.sqrt(z @ z)
    if not weight * length > 0:
        return values, vectors
    weight, z = weight * length * length, z / length
    tiny = 8 * EPS * max(values[-1], weight)
    # Values that coincide: a reflection turns z so that one of them carries all of its part.
    close = np.diff(values) <= tiny
    if close.any():
        vectors, z = vectors.copy(), z.copy()
        first = np.flatnonzero(np.append(True, ~close))
        last = np.append(first[1:], len(values))
        for a, b in zip(first[last - first > 1], last[last - first > 1], strict=True):
            part = z[a:b]
            size = np.sqrt(part @ part)
            if size == 0:
                continue
            mirror = part.copy()
            mirror[-1] += size if mirror[-1] >= 0 else -size
            vectors[:, a:b] -= np.outer(vectors[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
            z[b - 1] = -size if part[-1] >= 0 else size
            z[a : b - 1] = 0
    moving = np.flatnonzero(weight * np.abs(z) > tiny)
    if not len(moving):
        return values, vectors
    d, part = values[moving], z[moving]
    roots, delta = secular_roots(d, part * part, weight)
    # The z for which these roots are exact: with it the new vectors are orthogonal.
    across = d[:, None] - d[None, :]
    np.fill_diagonal(across, -1)
    exact = np.copysign(np.sqrt(np.abs((delta / across).prod(axis=1))), part)
    turn = exact[:, None] / delta
    turn /= np.sqrt((turn * turn).sum(axis=0))
    out, basis = values.copy(), vectors.copy() if not close.any() else vectors
    out[moving] = roots
    basis[:, moving] = basis[:, moving] @ turn
    order = np.argsort(out, kind="stable")
    return out[order], basis[:, order]


class Spectrum:
    """How many vectors were added, their mean, and the eigenpairs of their centred scatter matrix."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def _change(self, v: np.ndarray, weight: float) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v, weight)

    def add(self, v: np.ndarray) -> None:
        apart = v - self.mean
        self._change(apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        """Adds what the other has seen: one change per eigenpair, and one for the two means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self._change(vector, value)
        n, apart = self.n + other.n, other.mean - self.mean
        self._change(apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n

    def basis(self) -> np.ndarray:
        """The eigenvectors, made orthogonal again where many changes let them drift."""
        return np.linalg.qr(self.vectors)[0]

    def dump(self) -> bytes:
        return pickle.dumps((self.n, self.mean, self.values, self.vectors))

    @staticmethod
    def load(data: bytes) -> Spectrum:
        n, mean, values, vectors = pickle.loads(data)
        found = Spectrum(len(mean))
        found.n, found.mean, found.values, found.vectors = n, mean, values, vectors
        return found


def merge_spectra(states: Iterator[bytes]) -> bytes:
    first = Spectrum.load(next(states))
    for state in states:
        first.merge(Spectrum.load(state))
    return first.dump()
