"""Whitening of embedding vectors by the eigenvectors of their covariance.

Components are those of the *fit list*, in which each different vector stands once, so that a vector
with very many copies does not pull them its way. Tasks fold their part of the list into a
:class:`~tidemark.llm.spectrum.Spectrum`, one centred rank-one change a vector, at a cost of about
``width ** 3`` each; spectra are merged on the executors, some at a time, again by rank-one changes. A last
pass over the list forms the covariance in the basis found so (Rayleigh-Ritz), which is almost
diagonal, and its small eigenproblem turns the basis to double precision.

Entries are whole numbers, so sums over the list are exact. A mean is never rounded: what is summed is
``(n * x - S) / n``, whose numerator is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import vectors as vec
from tidemark.llm.spectrum import EPS, Spectrum
from tidemark.scratch import materialise

#: Vectors that a task folds into its spectrum at least, where there are so many.
TASK_VECTORS, MOST_TASKS = 4096, 4096


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors of the fit list with sums ``S``; ``components`` (columns) by falling
    ``values``, the eigenvalues of the covariance, whose trace is ``trace``. ``error`` is the
    largest absolute entry of the whitened list's covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float
    scale: float
    offset: int
    exact: bool

    @property
    def width(self) -> int:
        return len(self.sums)

    def turn(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _numbers(vector: str, width: int, scale: float, offset: int) -> Column:
    return vec.padded(vec.as_integers(vector, scale, offset), width, offset)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...], small: bool) -> np.ndarray:
    """``n * x - S``, in 64 bits where these are enough."""
    if small:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _whole(left: np.ndarray, n: int) -> np.ndarray:
    return left.astype(float) / n


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _fold(rows: DataFrame, width: int, fold, merge) -> bytes | None:
    """``fold`` of the matrices of each task, merged over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fold(vec.matrix(b.column(0), width) for b in batches if b.num_rows)
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_part()], pa.int32()), pa.array([state], pa.binary())], ["part", "state"]
            )

    tasks = rows.rdd.getNumPartitions()
    return vec.tree(rows.mapInArrow(run, "part int, state binary"), merge, tasks)


def _spectra(fit: DataFrame, width: int, offset: int) -> tuple[list[int], Spectrum]:
    def fold(matrices: Iterator[np.ndarray]) -> bytes | None:
        found, sums = Spectrum(width), [0] * width
        for x in matrices:
            # Sums of a batch may not fit in 64 bits, halves of its entries do.
            high, low = x >> 32, x & 0xFFFFFFFF
            sums = [
                a + (int(b) << 32) + int(c)
                for a, b, c in zip(sums, high.sum(axis=0), low.sum(axis=0), strict=True)
            ]
            for v in (x - offset).astype(float):
                found.add(v)
        return pickle.dumps((sums, found.dump())) if found.n else None

    def merge(states: Iterator[bytes]) -> bytes:
        sums, first = pickle.loads(next(states))
        found = Spectrum.load(first)
        for state in states:
            more, other = pickle.loads(state)
            sums = [a + b for a, b in zip(sums, more, strict=True)]
            found.merge(Spectrum.load(other))
        return pickle.dumps((sums, found.dump()))

    sums, found = pickle.loads(_fold(fit, width, fold, merge))
    return sums, Spectrum.load(found)


def _moments(fit: DataFrame, n: int, sums: tuple[int, ...], small: bool, turn: np.ndarray) -> tuple:
    """Sum and sum of products of ``((n * x - S) / n) @ turn`` over the list."""
    width = len(sums)

    def fold(matrices: Iterator[np.ndarray]) -> bytes | None:
        total, products, seen = np.zeros(turn.shape[1]), np.zeros((turn.shape[1],) * 2), False
        for x in matrices:
            seen = True
            y = _whole(_deviations(x, n, sums, small), n) @ turn
            total += y.sum(axis=0)
            products += y.T @ y
        return pickle.dumps((total, products)) if seen else None

    def merge(states: Iterator[bytes]) -> bytes:
        parts = [pickle.loads(s) for s in states]
        return pickle.dumps((sum(p[0] for p in parts), sum(p[1] for p in parts)))

    return pickle.loads(_fold(fit, width, fold, merge))


def _covariance(moments: tuple, n: int) -> np.ndarray:
    mean = moments[0] / n
    return moments[1] / n - np.outer(mean, mean)


def fit(
    rows: DataFrame, vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, components: int = 16
) -> Whitening | None:
    """Learns the components of ``floor(scale * c) + offset`` from every usable vector; see :func:`whiten`.

    None if there is no usable vector with an entry. Vectors of fewer entries than the longest have
    zeros (``x = offset``) there. Only as many components are kept as have an eigenvalue above
    rounding, so fewer than asked for if the vectors span fewer dimensions, and none if all are equal.
    """
    usable = rows.where(vec.usable(vector)).select(F.col(f"`{vector}`").alias("v"))
    given, width = usable.agg(F.count("*"), F.max(F.size("v"))).first()
    if not width or width < 0:
        return None
    listed = usable.select(_numbers("v", width, scale, offset).alias("x")).distinct()
    tasks = max(1, min(MOST_TASKS, -(-given // TASK_VECTORS)))
    listed = materialise(listed.repartition(tasks), "fit-list")
    n, _, low, high = vec.shape(listed, "x")
    small = n * max(abs(low), abs(high)) < 1 << 62
    sums, spectrum = _spectra(listed, width, offset)
    sums = tuple(sums)
    basis = spectrum.basis()
    inside = _covariance(_moments(listed, n, sums, small, basis), n)
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    kept = [i for i in np.argsort(-values, kind="stable") if values[i] > 64 * width * EPS * values.max()][:components]
    axes = basis @ turn[:, kept]
    # Of the two directions, that in which the largest entry is positive.
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(kept))] < 0, -1.0, 1.0)
    error = 0.0
    if kept:
        white = _covariance(_moments(listed, n, sums, small, axes / np.sqrt(values[kept])), n)
        error = float(np.abs(white - np.eye(len(kept))).max())
    exact = small and width * (n * (high - low)) ** 2 < 1 << 63
    return Whitening(n, sums, values[kept], axes, float(np.trace(inside)), error, scale, offset, exact)


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each usable row with each component: (key, component, n, deviation, whitened, explained, identity_error).

    A vector is usable if it is not null and has no null, NaN or infinite entry; other rows go. Rows
    that repeat an id or a vector, and rows without an id, are answered one by one. ``deviation`` is
    the sum of ``(n * x - S) ** 2``, held at the largest long where it is greater. Columns other than key
    and vector are left out, so names in them can't clash. Without a model or components, and for an
    empty table, there are no rows.
    """
    kind = rows.select(F.col(f"`{key}`")).schema.fields[0].dataType
    schema = T.StructType().add(key, kind).add("component", "integer").add("n", "long").add("deviation", "long")
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    usable = rows.where(vec.usable(vector))
    # A vector longer than all that the model has seen has no place in it.
    usable = usable.where(F.size(F.col(f"`{vector}`")) <= model.width)
    numbers = _numbers(vector, model.width, model.scale, model.offset)
    usable = usable.select(F.col(f"`{key}`").alias("key"), numbers.alias("x"))
    turn, names = model.turn(), schema.names
    many, n, sums, most = len(model.values), model.n, model.sums, (1 << 63) - 1
    small = n * (abs(model.offset) + max(map(abs, sums))) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vec.matrix(batch.column("x"), model.width)
            fits = small and (not x.size or n * int(np.abs(x).max()) < 1 << 62)
            left = _deviations(x, n, sums, fits)
            if model.exact and fits:
                squares = (left * left).sum(axis=1)
            else:
                squares = [min(sum(v * v for v in row), most) for row in left.astype(object)]
            white = _whole(left, n) @ turn
            rows = np.repeat(np.arange(len(x)), many)
            size = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, n, np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(rows)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                    pa.array(np.full(size, model.error)),
                ],
                names=names,
            )

    return usable.mapInArrow(run, schema)
