"""Whitening of embeddings: exact covariance, eigenvectors by Householder, Sturm counts and inverse iteration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerspark.llm.common import arrow_map
from ledgerspark.llm.vectors import gram, sound, summed, whole

#: Vectors become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000

#: Eigenvalues nearer to each other than this share of the norm form a cluster.
_NEAR = 1e-3


def tridiagonal(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the Householder vectors that lead from ``symmetric`` to them."""
    a, n = symmetric.astype(np.float64, copy=True), len(symmetric)
    reflectors: list[np.ndarray | None] = []
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 1):
        x = a[k + 1 :, k].copy()
        if not np.any(x[1:]):
            off[k] = x[0]
            reflectors.append(None)
            continue
        off[k] = -math.copysign(np.linalg.norm(x), x[0])
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
        reflectors.append(x)
    return np.diagonal(a).copy(), off, reflectors


def restored(vector: np.ndarray, reflectors: list[np.ndarray | None]) -> np.ndarray:
    """An eigenvector of the tridiagonal matrix as one of the matrix that it came from."""
    out = vector.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        if (x := reflectors[k]) is not None:
            out[k + 1 :] -= 2 * x * (x @ out[k + 1 :])
    return out


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of the values: the negative pivots of T - value (Sturm)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, n = diagonal[0] - at, np.zeros(len(at), np.int64)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        n += pivot < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues in falling order, each between neighbouring doubles of the norm's precision."""
    n = len(diagonal)
    radius = np.r_[np.abs(off), 0][:n] + np.r_[0, np.abs(off)][:n]
    norm = float(np.abs(diagonal).max() + radius.max())
    low, high = np.full(k, (diagonal - radius).min() - norm * 1e-15), np.full(k, (diagonal + radius).max() + norm * 1e-15)
    wanted = n - np.arange(k)  # the j-th largest has so many eigenvalues up to itself
    for _ in range(200):
        middle = (low + high) / 2
        enough = counts_below(diagonal, off, middle) >= wanted
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        if np.all(high - low <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high)) + np.finfo(float).tiny):
            break
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """The solution of (T - value) x = right, with row exchanges; pivots of zero become ``least``."""
    n, x = len(diagonal), right.copy()
    a, b, c = diagonal - value, np.r_[off, 0.0], np.zeros(n)  # diagonal, first and second above it
    for i in range(n - 1):
        below, own, above = off[i], a[i + 1], b[i + 1]
        if abs(below) > abs(a[i]):
            a[i], below = below, a[i]
            b[i], own = own, b[i]
            c[i], above = above, 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(a[i]) < least:
            a[i] = math.copysign(least, a[i])
        times = below / a[i]
        a[i + 1], b[i + 1] = own - times * b[i], above - times * c[i]
        x[i + 1] -= times * x[i]
    if abs(a[-1]) < least:
        a[-1] = math.copysign(least, a[-1])
    for i in range(n - 1, -1, -1):
        known = (b[i] * x[i + 1] if i + 1 < n else 0.0) + (c[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - known) / a[i]
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors of the eigenvalues (falling) in rows, by inverse iteration.

    Within a cluster of near eigenvalues each vector is made orthogonal to those before it, in every round.
    """
    n, draw = len(diagonal), np.random.default_rng(1)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    out, begun = np.zeros((len(values), n)), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > _NEAR * norm:
            begun = j
        x = draw.standard_normal(n)
        for _ in range(rounds):
            x = solved(diagonal, off, value, x / np.abs(x).max(), np.finfo(float).eps * norm or 1.0)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[begun:j].T @ (out[begun:j] @ x)
            x /= np.linalg.norm(x)
        out[j] = x
    return out


def eigen(symmetric: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues in falling order, and their unit eigenvectors in rows, largest entry positive."""
    scale = float(np.abs(symmetric).max(initial=0)) or 1.0
    diagonal, off, reflectors = tridiagonal(symmetric / scale)
    values = leading_values(diagonal, off, k)
    vectors = np.stack([restored(x, reflectors) for x in leading_vectors(diagonal, off, values)])
    largest = vectors[np.arange(k), np.abs(vectors).argmax(axis=1)]
    return values * scale, vectors * np.sign(largest)[:, None]


class Whitening:
    """What is learned from all vectors: count, sums, components, and what share of the variance each explains."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, k: int):
        self.n, size = n, len(sums)
        self.middle = np.array([round(s / n) if abs(s) < 1 << 52 else s // n for s in sums], np.int64)
        self.rest = [s - n * int(m) for s, m in zip(sums, self.middle)]
        self.k = min(k, size)
        self.trace = math.fsum(np.diagonal(covariance))
        self.values, self.components = eigen(covariance, self.k)
        # Directions without variance but for rounding have no whitened coordinate.
        self.live = self.values > 8 * size * np.finfo(float).eps * max(float(self.values[0]), 0.0)
        roots = np.sqrt(np.where(self.live, self.values, 1.0))
        self.projection = (self.components / roots[:, None]).T
        self.explained = np.where(self.live, self.values / (self.trace or 1.0), 0.0)
        self.error = math.nan

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number vectors; the difference from the mean is made of whole numbers."""
        return (x - self.middle - np.array([r / self.n for r in self.rest])) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each vector the sum of (n x - S) squared, exact; null where it doesn't fit 64 bits."""
        own = x - self.middle
        largest = self.n * int(np.abs(own).max(initial=0)) + max(map(abs, self.rest), default=0)
        fits = largest * largest * len(self.rest) < 1 << 63
        far = own.astype(np.int64 if fits else object) * self.n - np.array(self.rest, np.int64 if fits else object)
        found = (far * far).sum(axis=1)
        return found.tolist() if fits else [v if v < 1 << 63 else None for v in found.tolist()]


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sound vectors, and these as whole numbers, without SHIFT, which cancels out of all differences."""
    rows, _, entries = sound(column)
    return rows, whole(entries, SCALE).reshape(len(rows), size)


def fitted(vectors: DataFrame, vector: str = "embedding", k: int = 32) -> Whitening | None:
    """The whitening of all sound vectors; None where there are none, or none with an entry.

    Three passes over the column: sums; products of what is centred on the whole number next to the mean,
    corrected exactly for the rest, so that no order of tasks changes a bit; the covariance of the whitened rows. A covariance of
    d x d numbers and its decomposition are on the driver, where d is the number of components of a vector.
    """
    column = vectors.select(f"`{vector}`")

    def totals(batch: pa.RecordBatch) -> list:
        rows, sizes, entries = sound(batch.column(0))
        if not len(rows):
            return []
        size = int(sizes[0])
        if np.any(sizes != size):
            raise ValueError(f"vectors of {size} and of {int(sizes[sizes != size][0])} components")
        # Slot -1 counts, slots below it count vectors by size.
        return [(np.array([-1, -2 - size]), np.array([len(rows), len(rows)])), (np.arange(size), whole(entries, SCALE).reshape(len(rows), size).sum(axis=0))]

    found = summed(column, totals)
    sizes = [-2 - slot for slot in found if slot < -1]
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    if not sizes or not sizes[0]:
        return None
    size, n = sizes[0], found[-1]
    sums = [found[i] for i in range(size)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    row, col = np.triu_indices(size)

    def products(batch: pa.RecordBatch) -> list:
        _, x = _vectors(batch.column(0), size)
        return [(row * size + col, gram(x - middle)[row, col])] if len(x) else []

    found = summed(column, products)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    covariance = np.zeros((size, size))
    for i, j in zip(row.tolist(), col.tolist()):
        # Python divides whole numbers with one rounding.
        covariance[i, j] = covariance[j, i] = (n * found[i * size + j] - rest[i] * rest[j]) / (n * n)
    whitening = Whitening(n, sums, covariance, k)
    _measure(column, size, whitening)
    return whitening


def _measure(column: DataFrame, size: int, whitening: Whitening) -> None:
    """Sets ``error``: the largest entry of the whitened rows' own covariance less the identity."""
    live = np.flatnonzero(whitening.live)
    m = len(live)
    row, col = np.triu_indices(m)

    def moments(batch: pa.RecordBatch) -> list:
        _, x = _vectors(batch.column(0), size)
        if not len(x) or not m:
            return []
        white = whitening.apply(x)[:, live]
        return [(np.arange(-m, 0), white.sum(axis=0)), (row * m + col, (white.T @ white)[row, col])]

    found = summed(column, moments, exact=False)
    mean = [found[i - m] / whitening.n for i in range(m)]
    apart = [abs(found[i * m + j] / whitening.n - mean[i] * mean[j] - (i == j)) for i, j in zip(row.tolist(), col.tolist())]
    whitening.error = max(apart, default=0.0)


def whitened(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 32) -> DataFrame:
    """One row per sound vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows with a null vector, or one with null or non-finite entries, are left out; a null key stays. Repeated
    rows count and come out as often as they are there. Tables without sound vectors, and vectors without
    components, give an empty result; vectors of different sizes, and components beyond 2**44, are an error.
    Where vectors have no variance in a component's direction its whitened is null and its explained 0.
    deviation is null if the exact number is beyond 64 bits. Only the two named columns are read.
    """
    kind = vectors.schema[key].dataType
    names = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(name, type_) for name, type_ in names]])
    whitening = fitted(vectors, vector, k)
    if whitening is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size, k = len(whitening.rest), whitening.k
    missing = ~whitening.live

    def project(batch: pa.RecordBatch) -> list:
        rows, x = _vectors(batch.column(1), size)
        m = len(rows)
        white = whitening.apply(x).ravel()
        far = pa.array(whitening.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
        return [
            batch.column(0).take(pa.array(np.repeat(rows, k))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
            pa.array(np.full(m * k, whitening.n)),
            far,
            pa.array(white, mask=np.tile(missing, m)),
            pa.array(np.tile(whitening.explained, m)),
            pa.array(np.full(m * k, whitening.error)),
        ]

    return arrow_map(vectors.select(f"`{key}`", f"`{vector}`"), project, schema)
