"""Vectors in Arrow batches, and exact sums of what tasks find in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import claim, prepare

#: Doubles hold whole numbers up to here exactly.
EXACT = 1 << 53

#: Whole numbers made from components stay below this, so that they and their sums of a batch fit 64 bits.
LARGEST = 1 << 50


def sound(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors that are not null and hold finite entries only: their rows, their sizes, and all entries as doubles."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    sizes = column.value_lengths().drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(rows)), sizes)
    good = np.bincount(owner, ~np.isfinite(entries), minlength=len(rows)) == 0
    return rows[good], sizes[good], entries[good[owner]]


def whole(entries: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * entry) as 64-bit integers; entries beyond 2**50 / factor are an error."""
    scaled = np.floor(entries * factor)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ArithmeticError(f"a component times {factor} reaches 2**50")
    return scaled.astype(np.int64)


def summed(df: DataFrame, parts: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray]]], exact: bool = True) -> dict[int, int]:
    """Sums over all rows, by slot: ``parts`` gives (slots, values) of a batch, each slot once in a pair.

    A task adds up its own batches and emits one row per slot, Spark adds these. Only the sums come to the
    driver, so the number of slots must have a bound. Whole numbers are summed exactly, in any order;
    with ``exact`` off values are doubles.
    """
    prepare(df.sparkSession)
    kind = pa.decimal128(38, 0) if exact else pa.float64()
    module = parts.__module__

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(module)
        total: dict[int, object] = {}
        for batch in batches:
            for slots, values in parts(batch) if batch.num_rows else ():
                for slot, value in zip(slots.tolist(), values.tolist()):
                    total[slot] = total.get(slot, 0) + value
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), kind)], ["slot", "value"])

    found = df.mapInArrow(local, f"slot long, value {'decimal(38,0)' if exact else 'double'}")
    rows = found.groupBy("slot").agg(F.sum("value").alias("value")).collect()
    return {r["slot"]: int(r["value"]) if exact else r["value"] for r in rows}


def gram(rows: np.ndarray) -> np.ndarray:
    """The exact products of the columns of whole numbers, summed over the rows."""
    largest = int(np.abs(rows).max()) if rows.size else 0
    if largest * largest * len(rows) < EXACT:
        real = rows.astype(np.float64)
        return (real.T @ real).astype(np.int64)
    big = rows.astype(object)
    return big.T @ big
