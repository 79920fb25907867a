"""CSV records of many files in one scan, also where quoted fields hold line breaks.

Files are read as lines without decoding, so files of any size are split among tasks. What a line means
depends on little: the file's encoding, its header, and whether a quoted field is open where the line
begins. What a line does to that is a function of two values (closed, open); functions of lines are put
together by the task that scans a block of a file first, then from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerspark.session import ship_package

#: A record longer than this is rejected: most likely a quote is missing, and the rest of its file hangs on it.
LONGEST_RECORD = 1 << 24

#: The parts of a header between commas outside of quotes.
_FIELD = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'


def lines_of(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Every line: value (raw bytes as a string), path, block (first byte of its split) and line, which rises within a block.

    Line numbers hold for one listing of the files, so all steps must use the same DataFrame.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    return found.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def _quote_free(value: Column) -> Column:
    """The line without the quoted fields that are closed properly."""
    return F.regexp_replace(value, r'(?<=^|,)"[^"]*+"(?=,|\r?$)', "")


def _is_odd(part: Column) -> Column:
    return (F.octet_length(part) - F.octet_length(F.replace(part, F.lit('"'), F.lit("")))) % 2 == 1


def open_after(value: Column, open_before: int) -> Column:
    """Whether (1 or 0) a quoted field is open behind a line.

    Only a quote at a field's start opens it; others are plain text. Lines without quotes, or with
    properly closed fields alone, are told without looking at each field.
    """
    steps = F.aggregate(
        F.split(value, ","), F.lit(open_before),
        lambda open_, part: F.when(_is_odd(part) & ((open_ == 1) | part.startswith('"')), 1 - open_).otherwise(open_),
    )
    told = F.when(~value.contains('"'), F.lit(open_before))
    if not open_before:
        told = told.when(~_quote_free(value).contains('"'), F.lit(0))
    return told.otherwise(steps)


def _commas(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(","), F.lit("")))


def separators(text: Column, values: Column) -> Column:
    """How many commas of a record stand between fields, up to the last field that isn't empty.

    ``values`` are the fields that were read; the commas in them are no separators.
    """
    return _commas(F.rtrim(text, F.lit(", \t\r"))) - _commas(F.array_join(values, ""))


def blocks_of(lines: DataFrame) -> DataFrame:
    """Per block of a file: its first line, whether it is UTF-8, and whether any line leaves a field open.

    Fixed-size values only, so it is a hash aggregate. No UTF-8 sequence holds a line feed, so checking
    lines is checking the file.
    """
    return lines.groupBy("path", "block").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(open_after(F.col("value"), 0) == 1).alias("open_lines"),
        F.min("line").alias("first"),
    )


def header_fields(header: Column) -> Column:
    """The names in a header line, without quotes, outer blanks and byte order mark."""
    clean = F.regexp_replace(F.regexp_replace(header, "^\ufeff", ""), "\r$", "")
    count = F.length(F.regexp_replace(F.regexp_replace(clean, r'"(?:[^"]|"")*"', ""), "[^,]", "")) + 1
    parts = F.slice(F.regexp_extract_all(clean, F.lit(_FIELD), F.lit(1)), F.lit(1), count)
    bare = lambda p: F.when(p.startswith('"'), F.replace(F.regexp_replace(p, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(p)
    return F.transform(parts, lambda p: F.trim(bare(p)))


def decoded(value: str, utf8: str) -> Column:
    """The text of raw bytes, in the encoding of their file."""
    return F.when(F.col(utf8), F.make_valid_utf8(value)).otherwise(F.decode(F.col(value).cast("binary"), "ISO-8859-1"))


def files_of(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per file with lines: path, utf8, multi_line, first (line), first_line (text), open_header and header (array of names)."""
    files = blocks.groupBy("path").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("open_lines").alias("multi_line"),
        F.min(F.when(F.col("block") == 0, F.col("first"))).alias("first"),
    )
    first = lines.filter("block = 0").select("line", "value")
    joined = files.join(first, files["first"] == first["line"])
    told = joined.select("path", "utf8", "multi_line", "first", decoded("value", "utf8").alias("first_line"))
    return told.withColumn("open_header", open_after(F.col("first_line"), 0) == 1).withColumn("header", header_fields(F.col("first_line")))


def _state(last: str, swaps: Column, start: Column) -> Column:
    """Open or closed, from the last line that sets it whatever was before, the swaps since, or else from the start."""
    since = F.coalesce(swaps, F.lit(0)) - F.coalesce(F.col(f"{last}.swaps"), F.lit(0))
    return (F.coalesce(F.col(f"{last}.sets"), start) + since) % 2


def _counted(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """For rows with ``after_0`` and ``after_1``: what comes before each (``last``, ``swaps``) and what holds behind it (``last_to``, ``swaps_to``)."""
    window = Window.partitionBy(*group).orderBy(order)
    before, upto = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("swaps_to", F.sum(((F.col("after_0") == 1) & (F.col("after_1") == 0)).cast("long")).over(upto))
    sets = F.when(F.col("after_0") == F.col("after_1"), F.struct(F.col("after_0").alias("sets"), F.col("swaps_to").alias("swaps")))
    rows = rows.withColumn("own_set", sets)
    return rows.select(
        "*", F.last("own_set", ignorenulls=True).over(before).alias("last"), F.last("own_set", ignorenulls=True).over(upto).alias("last_to"),
        F.lag("swaps_to").over(window).alias("swaps"),
    ).drop("own_set")


def _line_ends(line: bytes) -> tuple[int, int]:
    """``open_after`` of a line for both values."""
    closed, opened = 0, 1
    if b'"' in line:
        for part in line.split(b","):
            if part.count(b'"') % 2:
                leads = part.startswith(b'"')
                closed, opened = int(leads and not closed), int(leads and not opened)
    return closed, opened


class _Reading:
    """The records of a block if its first line is, or isn't, within a quoted field."""

    def __init__(self, start: int | None, open_: int):
        self.start, self.open, self.begun = start, open_, False
        self.held: list[bytes] = []
        self.size = self.lines = 0

    def take(self, line: bytes, ends: tuple[int, int], most: int) -> tuple | None:
        """What ends with this line: start, begins, ends, text, lines. A text of more than ``most`` bytes isn't held."""
        self.begun |= not self.open
        self.open = ends[self.open]
        self.lines += 1
        self.size += len(line)
        if self.lines == 1 or self.size <= most:
            self.held.append(line)
        else:
            self.held.clear()
        return None if self.open else self.give(most)

    def give(self, most: int) -> tuple:
        text = b"\n".join(self.held) if self.lines == 1 or self.size <= most else None
        out = (self.start, self.begun, not self.open, text, self.lines)
        self.held, self.begun, self.size, self.lines = [], False, 0, 0
        return out


#: What a scan's task gives of a block: records and parts of records, and one row (``lines`` 0) with what the block does to an open field.
_PARTS = "path string, block long, start int, begins boolean, ends boolean, text binary, lines long, after_0 int, after_1 int"

#: Bytes of text in one batch that a task gives back, beyond its last record.
_BATCH_BYTES = 1 << 22


def _assembled(most: int, schema: pa.Schema):
    """For ``mapInArrow`` over path, block and value (bytes) in the order of the scan: rows of ``_PARTS``.

    A block of which the start isn't known is read in both ways until the two agree, mostly at the first
    line that closes a field.
    """

    def block_rows(path: str, block: int, readings: list[_Reading], most: int) -> Iterator[tuple]:
        for reading in readings:
            if reading.lines:
                yield (path, block, *reading.give(most), None, None)
        yield path, block, None, None, None, None, 0, readings[0].open, readings[-1].open

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, readings = None, []
        for batch in batches:
            for path, block, line in zip(*(column.to_pylist() for column in batch.columns)):
                ends = _line_ends(line)
                if (path, block) != at:
                    if at:
                        yield from block_rows(*at, readings, most)
                    at = path, block
                    readings = [_Reading(0, 0), _Reading(1, 1)] if block else [_Reading(None, 0)]
                    if not block:
                        # The header is no record. One with an open field rejects its file.
                        readings[0].take(line, ends, most)
                        readings[0].give(most)
                        continue
                for reading in readings:
                    done = reading.take(line, ends, most)
                    if done:
                        yield (path, block, *done, None, None)
                if len(readings) == 2 and not readings[0].open and not readings[1].open:
                    readings = [_Reading(None, 0)]
        if at:
            yield from block_rows(*at, readings, most)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[5] or b"") + 64
            if size >= _BATCH_BYTES:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return assemble


#: Bits of the hash by which lines of files without open quotes are passed over; bounds what is broadcast.
_PASS_BITS = 20


def whole_records(lines: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Records of files whose quoted fields may span lines: path, text, too_long. They are staged in ``folder``.

    The task that scans a block puts its lines together. Only the parts of records that cross the
    border of a block are moved: each belongs to the last record that began before its block.
    """
    spark = lines.sparkSession
    ship_package(spark)
    broken = files.filter("multi_line").select("path", "utf8")
    spot = F.pmod(F.xxhash64("path"), F.lit(1 << _PASS_BITS)).alias("spot")
    # A broadcast leaves lines in the order of their block, which the tasks rely on. UTF-8 has four bytes a character at most.
    scanned = lines.select("path", "block", F.col("value").cast("binary").alias("value"), spot).join(F.broadcast(broken.select(spot).distinct()), "spot", "left_semi")
    schema = T._parse_datatype_string(_PARTS)
    scanned.drop("spot").mapInArrow(_assembled(4 * LONGEST_RECORD, to_arrow_schema(schema)), schema).write.parquet(folder)
    parts = spark.read.schema(schema).parquet(folder)

    # A block as a whole is a function of two values too; one row per block.
    blocks = parts.filter("lines = 0").select("path", "block", "after_0", "after_1")
    starts = _counted(blocks, ["path"], "block").select("path", "block", _state("last", F.col("swaps"), F.lit(0)).alias("known"))
    text = F.when(F.col("utf8"), F.make_valid_utf8(F.col("text").cast("string"))).otherwise(F.decode("text", "ISO-8859-1"))
    size = F.length("text") - F.col("lines") + 1

    def told(some: DataFrame) -> DataFrame:
        return some.join(broken, "path").withColumn("text", text).withColumn("size", size)

    given = parts.filter("lines > 0")
    sure = given.filter("start IS NULL")
    doubtful = given.filter("start IS NOT NULL").join(starts, ["path", "block"]).filter("start = known").drop("known")
    both = sure.unionByName(doubtful)
    too_long = (F.col("lines") > 1) & (F.col("text").isNull() | (F.col("size") > LONGEST_RECORD))
    inside = told(both.filter("begins AND ends")).select("path", F.when(~too_long, F.col("text")).alias("text"), too_long.alias("too_long"))

    crossing = told(both.filter("NOT (begins AND ends)"))
    earlier = Window.partitionBy("path").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    about = crossing.select("path", "block", "begins", "size")
    record = F.when(F.col("begins"), F.col("block")).otherwise(F.max(F.when(F.col("begins"), F.col("block"))).over(earlier))
    owned = about.withColumn("record", record).filter("record IS NOT NULL")
    over = F.bool_or(F.col("size").isNull()) | (F.sum("size") > LONGEST_RECORD)
    sizes = owned.groupBy("path", "record").agg(over.alias("too_long"))
    long = sizes.filter("too_long").select("path", F.lit(None).cast("string").alias("text"), "too_long")
    fit = crossing.join(owned.join(sizes.filter("NOT too_long"), ["path", "record"]).select("path", "block", "begins", "record"), ["path", "block", "begins"])
    in_order = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = fit.groupBy("path", "record").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"))
    return inside.unionByName(joined.select("path", "text", F.lit(False).alias("too_long"))).unionByName(long)


def records_of(lines: DataFrame, files: DataFrame, folder: str | None) -> DataFrame:
    """path, text and too_long of every record but the headers; blank lines are left out.

    Files without odd lines are a projection of their lines, after one join to their files. ``folder`` is
    needed if there are others.
    """
    plain = lines.join(files.filter("NOT multi_line").select("path", "utf8", "first"), "path").filter(F.col("line") != F.col("first"))
    out = plain.select("path", decoded("value", "utf8").alias("text"), F.lit(False).alias("too_long"))
    if folder is not None:
        out = out.unionByName(whole_records(lines, files, folder))
    return out.filter(F.col("too_long") | F.col("text").rlike(r"\S"))
