"""Centroid clustering of whole-number vectors by scalar lookup tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import arrow_map, staged
from ledgerspark.llm.vectors import sound, summed, whole

#: Vectors become whole numbers: floor(SCALE * c).
SCALE = 256

#: Values of one dimension that lie in a range of this size are found by marking, others by sorting.
_RANGE = 1 << 16


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, rising, and the place of each value among them."""
    low, high = int(values.min()), int(values.max())
    if high - low >= _RANGE:
        return np.unique(values, return_inverse=True)
    marked = np.zeros(high - low + 1, np.int64)
    marked[values - low] = 1
    return np.flatnonzero(marked) + low, (np.cumsum(marked) - 1)[values - low]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors (rows) to all centroids, exact.

    For each dimension the squared differences of the values that occur to each centroid's are tabulated
    once; a distance is then a sum of table entries. Tables hold 32-bit numbers where every sum fits them,
    64-bit ones where these do, else numbers of any size.
    """
    widest = int(np.abs(x).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    bound = widest * widest * x.shape[1]
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    out = np.zeros((len(x), len(centroids)), kind)
    for d in range(x.shape[1]):
        values, place = occurring(x[:, d])
        apart = values.astype(kind)[:, None] - centroids[:, d].astype(kind)[None, :]
        out += (apart * apart)[place]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def kept(vectors: DataFrame, vector: str, key: str, size: int) -> DataFrame:
    """key and x: the vectors of ``size`` finite components as whole numbers."""
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("x", T.ArrayType(T.LongType()))])

    def convert(batch: pa.RecordBatch) -> list:
        rows, sizes, entries = sound(batch.column(1))
        fit = sizes == size
        x = whole(entries[np.repeat(fit, sizes)], SCALE)
        return [batch.column(0).take(pa.array(rows[fit])), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, size, dtype=np.int32)), pa.array(x))]

    return arrow_map(vectors.select(f"`{key}`", f"`{vector}`"), convert, schema)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' mean; those without vectors stay."""
    k, size = centroids.shape

    def sums(batch: pa.RecordBatch) -> list:
        x = _matrix(batch.column(0))
        cluster = distances(x, centroids).argmin(axis=1)
        order = np.argsort(cluster, kind="stable")
        found, first, counts = np.unique(cluster[order], return_index=True, return_counts=True)
        total = np.add.reduceat(x[order], first, axis=0)
        slots = found[:, None] * (size + 1) + np.arange(size + 1)
        return [(slots.ravel(), np.column_stack([total, counts]).ravel())]

    found = summed(rows.select("x"), sums)
    out = centroids.copy()
    for c in range(k):
        count = found.get(c * (size + 1) + size, 0)
        if count:
            out[c] = [found[c * (size + 1) + d] // count for d in range(size)]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector of ``size`` finite components: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:key`` (rows of one key: by
    their components; a null key comes last), or all, if there are fewer. Null vectors, vectors of another size or with null or
    non-finite components are left out; repeated rows are rows of their own; equal distances go to the smaller number. An
    empty table gives an empty result. Components of 2**42 and more are an error; a distance, or a sum of
    them, beyond 64 bits is null. Only the two named columns are read, so others may have any names.

    Every round reads the staged whole numbers once; the driver holds the centroids and one sum for each
    cluster and dimension.
    """
    rows = staged(kept(vectors, vector, key, size))
    chosen = rows.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256).alias("h"))
    first = [r["x"] for r in chosen.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]
    centroids = np.array(first, np.int64).reshape(len(first), size)
    for _ in range(rounds if first else 0):
        centroids = moved(rows, centroids)
    schema = T.StructType([rows.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def assign(batch: pa.RecordBatch) -> list:
        far = distances(_matrix(batch.column(1)), centroids)
        cluster = far.argmin(axis=1)
        least = far[np.arange(len(far)), cluster]
        return [batch.column(0), pa.array(cluster.astype(np.int32)), [v if v < 1 << 63 else None for v in least.tolist()]]

    assigned = staged(arrow_map(rows, assign, schema))
    total = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col(c).cast("decimal(38,0)")))
    per_cluster = assigned.groupBy("cluster").agg(total("distance").alias("sum")).collect()  # at most k rows
    sums = {r["cluster"]: None if r["sum"] is None else int(r["sum"]) for r in per_cluster}
    fits = lambda v: None if v is None or v >= 1 << 63 else v
    whole_sum = None if None in sums.values() else sum(sums.values())
    figures = [(c, fits(sums.get(c, 0)), fits(whole_sum), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    named = vectors.sparkSession.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
