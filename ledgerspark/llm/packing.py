"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.bulk_ids import GATHER_BYTES, ended_ids, text_ids  # noqa: F401
from ledgerspark.llm.common import arrow_map, numbered, staged


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids (with ``end_id`` behind them): key, piece, start, length, ids_crc32, and ids if asked.

    Only documents longer than ``capacity`` are cut; all pieces but the first are then full. Null texts
    are empty: one piece that holds the end only. Repeated rows give repeated pieces.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def cut(batch: pa.RecordBatch) -> list:
        rows = []
        ids, counts = ended_ids(batch.column(1), path, pattern, end_id)
        data = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
        ends = np.cumsum(counts)
        for name, begin, n in zip(batch.column(0).to_pylist(), (ends - counts).tolist(), counts.tolist()):
            first = (n - 1) % capacity + 1
            for i, end in enumerate(range(first, n + 1, capacity)):
                start = max(0, end - capacity) if i else 0
                own = data[4 * (begin + start) : 4 * (begin + end)]
                rows.append((name, i, start, end - start, zlib.crc32(own), bytes(own) if with_ids else None)[: len(schema)])
        return [list(c) for c in zip(*rows)]

    return arrow_map(docs.select(key, text), cut, schema, GATHER_BYTES)


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of (length, count) pairs, the lengths to take for the largest sum up to ``room``.

    Bit s of a number says that the sum s can be reached; counts go in by powers of two.
    """
    reach, steps, limit = 1, [], (1 << room + 1) - 1
    for length, count in available:
        count, unit = min(count, room // length), 1
        while count > 0 and not reach >> room & 1:
            take = min(unit, count)
            steps.append((length, take, reach))
            reach |= reach << length * take & limit
            count, unit = count - take, unit * 2
    at, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            taken[length] = taken.get(length, 0) + take
    return taken


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (how many of each length, how many such bins).

    Each bin takes the longest length left and the fullest combination that fits beside it; the same bin is
    repeated while the counts last, so there are few different bins for any number of pieces.
    """
    left, plan = {k: v for k, v in sorted(counts.items(), reverse=True) if v}, []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        taken = fullest([(k, v) for k, v in left.items() if v and k <= capacity - longest], capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        plan.append((taken, times))
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first index, sequence of it, pieces in a sequence, offset of the first) by length and index."""
    rows, used, sequence = [], {}, 0
    for taken, times in plan:
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (with a column length, 1 to ``capacity``) with sequence_id and offset; each sequence is gapless from 0.

    Only a count for each length comes to the driver, ``capacity`` numbers at most. Pieces of one length are
    interchangeable: they are numbered within their length and find their place by that number.
    """
    rows = numbered(cut, "length")
    found = rows.groupBy("length").agg(F.count("*").alias("n")).collect()
    table = places(slack_plan({r["length"]: r["n"] for r in found}, capacity))
    schema = T.StructType([*[f for f in cut.schema.fields], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # A place per length and bin of the plan; both parts of the key are below 2**62 together.
    shift = np.int64(50)
    keys = (table[:, 0] << shift) + table[:, 1]
    place, index = rows.columns.index("length"), rows.columns.index("_index")
    own = [rows.columns.index(c) for c in cut.columns]

    def locate(batch: pa.RecordBatch) -> list:
        lengths, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (place, index))
        row = table[np.searchsorted(keys, (lengths << shift) + numbers, side="right") - 1]
        behind = numbers - row[:, 1]
        return [*[batch.column(i) for i in own], pa.array(row[:, 2] + behind // row[:, 3]), pa.array(row[:, 4] + behind % row[:, 3] * lengths)]

    return arrow_map(rows, locate, schema)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequences; empty tables give an empty result."""
    # Staged first: numbering in the same stage would keep a second Python worker for each task.
    return packed(staged(pieces(docs, path, pattern, capacity, text=text, key=key, with_ids=with_ids)), capacity)
