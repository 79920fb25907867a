"""Shared parts: reading tables, staging, numbering within keys, hashing of words in numpy."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.session import scratch_folder

#: Rows in one Arrow batch at most; texts may be long, and a batch is held in memory as a whole.
BATCH_ROWS = 500

#: Characters of text that one vectorised step holds.
STEP_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make the session ready for Python tasks.

    Lowers the Arrow batch size to ``BATCH_ROWS``, as rows here can be whole books, and sends this package
    to the executors, as ``--py-files`` would.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back; lost executors then cost no recomputation."""
    path = f"{scratch_folder(df.sparkSession)}/staged"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that ``df`` doesn't use yet, whatever its case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns; its own columns of the same names (in any case) go."""
    names = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in columns.items()])


def slices(texts: list, limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``limit`` characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def as_texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


_clearing: dict[str, list[Callable]] = {}
_owner = [""]


def process_cache(function):
    """``lru_cache`` for what a worker process keeps from task to task."""
    kept = lru_cache(maxsize=4)(function)
    _clearing.setdefault(function.__module__, []).append(kept.cache_clear)
    return kept


def claim(module: str) -> None:
    """Drop what this process keeps for other modules: stages share workers, whose memory is counted together."""
    if _owner[0] != module:
        _owner[0] = module
        for name, clearing in _clearing.items():
            for clear in clearing if name != module else ():
                clear()
        pa.default_memory_pool().release_unused()


def merged(found: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches with rows, put together until they hold ``limit`` bytes."""
    held, size = [], 0
    for batch in found:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if held and size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def arrow_map(df: DataFrame, function, schema: str | T.StructType, gather: int = 0) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to a list of columns; small batches are put together up to ``gather`` bytes."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kinds = to_arrow(schema)
    prepare(df.sparkSession)
    module = function.__module__

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(module)
        for batch in merged(found, gather) if gather else found:
            if batch.num_rows:
                columns = function(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, kind in zip(columns, kinds.types)], schema=kinds)

    return df.mapInArrow(batches, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def numbered(df: DataFrame, key: str, index: str = "_index") -> DataFrame:
    """``df`` with ``index``: a gapless number from 0 within each value of ``key``, without gathering a key.

    Every task numbers its own rows while the rows are staged; the starts of the tasks within a key are
    running sums over one row per key and task. ``key`` is a long and never null.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_task", T.LongType()), T.StructField("_own", T.LongType())])
    kinds = to_arrow(schema)
    prepare(df.sparkSession)
    place = df.columns.index(key)

    def local(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for batch in found:
            if batch.num_rows:
                keys = batch.column(place).to_numpy(zero_copy_only=False)
                own = running_count(keys, seen)
                yield pa.RecordBatch.from_arrays([*[c.cast(k.type) for c, k in zip(batch.columns, kinds)], pa.array(np.full(len(keys), task, np.int64)), pa.array(own)], schema=kinds)

    rows = staged(df.mapInArrow(local, schema))
    counts = rows.groupBy(key, "_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(key, "_task", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(starts, [key, "_task"]).withColumn(index, F.col("_start") + F.col("_own")).drop("_task", "_own", "_start")


def running_count(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """For each place, how often its key came before; ``seen`` carries counts from call to call."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[first, len(keys)])
    own = np.arange(len(keys)) - np.repeat(first, sizes)
    for at, size in zip(first.tolist(), sizes.tolist()):
        k = int(ordered[at])
        if k in seen:
            own[at : at + size] += seen[k]
        seen[k] = seen.get(k, 0) + size
    out = np.empty(len(keys), np.int64)
    out[order] = own
    return out


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the number of words in each text."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
    raw = np.frombuffer(data, np.uint8)
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts)) + 1
    word = ~_SPACE[raw]
    edge = np.diff(np.r_[False, word].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    per_text = np.diff(np.r_[0, np.searchsorted(starts, np.cumsum(lengths))])
    if not len(starts):
        return np.empty(0, np.uint64), per_text
    sizes = ends - starts
    letters = raw[word].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(letters * _powers(int(sizes.max()))[place], first)), per_text
