"""Token ids of documents in Parquet files: list columns, chosen encodings, row groups and page indexes.

A folder holds ``tokens`` (one row per document: shard, doc_id, at, n_tokens, ids), written in order of
doc_id over the files, and ``shards`` (one row per file: where its first id lies). ``shards`` is written
last; without it a folder is not complete.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.bulk_ids import GATHER_BYTES, ended_ids
from ledgerspark.llm.common import arrow_map


@dataclass(frozen=True)
class Layout:
    """How files are laid out.

    ``encoding`` of the ids: ``dictionary`` (each row group lists its ids once, 16 bits or fewer stand for an id) or ``delta``
    (differences of neighbours, packed in blocks; no dictionary, which suits huge vocabularies).
    """

    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000

    def options(self) -> dict[str, str]:
        """Options of Spark's Parquet writer; column and offset indexes of pages are always written."""
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"unknown encoding {self.encoding}")
        out = {
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(4 << 20),
            "parquet.enable.dictionary": "true",
            "compression": "zstd",
        }
        if self.encoding == "delta":
            # Delta encodings belong to the second version of the format's writer.
            out |= {"parquet.writer.version": "v2", "parquet.enable.dictionary#ids.list.element": "false"}
        return out


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id and text, rising over the partitions and inside each; null ids first.

    Rows of one id lie by their text's hash. A number of the row keeps copies apart, so that no id and
    no group of copies is too large for one partition.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = ["doc_id", "_hash", "_row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 2, layout: Layout = Layout(), key: str = "doc_id", text: str = "text") -> None:
    """Encode the whole texts and write their ids, with ``end_id`` behind each document, in ascending order of ``key``.

    Null and empty texts hold the end only. Long texts are encoded in steps and lie in one list each; an
    empty table gives an empty folder; repeated rows are documents of their own; other columns are not read.
    """
    kinds = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", docs.schema[key].dataType), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    written: dict[tuple[int, int], int] = {}

    def encode(batch: pa.RecordBatch) -> list:
        task = TaskContext.get()
        shard = task.partitionId()
        begun = written.pop((task.stageId(), task.taskAttemptId()), 0)
        ids, counts = ended_ids(batch.column(1), tokenizer, pattern, end_id)
        ends = np.cumsum(counts)
        written[task.stageId(), task.taskAttemptId()] = begun + int(ends[-1])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
        return [pa.array(np.full(len(counts), shard, np.int32)), batch.column(0), pa.array(begun + ends - counts), pa.array(counts), lists]

    arrow_map(in_order(docs, key, text), encode, kinds, GATHER_BYTES).write.options(**layout.options()).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    sizes = spark.read.schema(kinds).parquet(f"{path}/tokens").groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    # One row per file, so a window over all of them is short.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str, where: Column | None = None, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Documents of a folder; ``where`` may name doc_id and n_tokens.

    Only the named columns are read, so figures are told without touching ids, and ``where`` reaches the
    scan, which skips row groups and pages by their least and greatest values.
    """
    rows = spark.read.parquet(f"{path}/tokens")
    if where is not None:
        rows = rows.filter(where)
    shards = spark.read.parquet(f"{path}/shards").select("shard", "first")
    if "start" in columns:
        rows = rows.join(shards, "shard").withColumn("start", F.col("first") + F.col("at"))
    return rows.select(*columns)


def digests(rows: DataFrame) -> DataFrame:
    """The other columns of ``read`` rows, and ids_crc32: of the ids as little-endian unsigned 32-bit integers."""
    others = [c for c in rows.columns if c != "ids"]
    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField("ids_crc32", T.LongType())])

    def check(batch: pa.RecordBatch) -> list:
        lists = batch.column(len(others))
        data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")).cast("B")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * 4).tolist()
        return [*batch.columns[: len(others)], pa.array([zlib.crc32(data[a:b]) for a, b in zip([0, *ends], ends)], pa.int64())]

    return arrow_map(rows.select(*others, "ids"), check, schema)
