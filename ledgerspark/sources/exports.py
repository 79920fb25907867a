"""Bank export files: discovery, probing, reading, and what was left out.

Export files differ in encoding, header and quoting. A first pass over their lines gives one small row
per file, which stays in Spark; a second pass reads all files in one scan, joins each record to its file's row and
picks the fields by the places that the file's header has for them.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import ledger as ledgers
from ledgerspark.operators.identity import with_transaction_id, with_unique_ids
from ledgerspark.operators.normalize import DESCRIPTION_PARTS, canonical_columns, canonical_values, normalize
from ledgerspark.schema import IDENTITY_COLUMNS, KEY_COLUMN, LAYOUTS, ORIGIN_COLUMN, TRANSACTION_COLUMNS, TRANSACTION_SCHEMA, Layout
from ledgerspark.session import scratch_folder
from ledgerspark.sources import tables
from ledgerspark.sources.records import LONGEST_RECORD, blocks_of, files_of, lines_of, records_of, separators

EXPORT_FILES = "*.{csv,CSV}"
# Texts the usual table readers take for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def probe_files(spark: SparkSession, folder: str, pattern: str = EXPORT_FILES) -> DataFrame:
    """Per export file below the folder: path, encoding, header line, and whether a quoted field spans lines."""
    lines = lines_of(spark, folder, pattern)
    return files_of(lines, blocks_of(lines)).select(
        "path", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), "multi_line", F.col("first_line").alias("header")
    )


def parse_header(line: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([line.lstrip("\ufeff").rstrip("\r")]), [])]


@dataclass
class ExportLoad:
    """The loaded table, and what could not be used."""

    transactions: DataFrame
    rejected_files: DataFrame
    rejected_rows: DataFrame


def load_exports(
    spark: SparkSession,
    folder: str,
    layouts: tuple[Layout, ...] = LAYOUTS,
    unique_ids: bool = True,
    money_type: str = "double",
    strip_thousands: bool = False,
    staging: str | None = None,
    keyed: bool = False,
    ledger: str | None = None,
) -> ExportLoad:
    """All export files below a folder as one canonical table with IDs.

    Files whose header fits no layout are listed as rejected and the rest goes
    on; rows with more fields than their header are rejected one by one.

    Making IDs unique reads the table more than once, so the parsed rows are
    first written as Parquet to ``staging`` (a new folder beside the checkpoints
    by default); the result reads from there. ``keyed`` keeps the full hash, made unique in the same way, as
    ``Transaction_Key``. ``ledger`` is the folder of a ledger of given suffixes: IDs known from earlier
    loads stay, and those that this load adds are put there.
    """
    lines = lines_of(spark, folder, EXPORT_FILES)
    base = staging or scratch_folder(spark)
    blocks_of(lines).write.parquet(f"{base}/blocks")
    blocks = spark.read.parquet(f"{base}/blocks")
    _classified(files_of(lines, blocks), layouts).write.parquet(f"{base}/files")
    files = spark.read.parquet(f"{base}/files")
    good = files.filter("reason IS NULL")
    # One row: how many fields the longest header has, and what columns there are in any file.
    seen = good.agg(
        F.max(F.size("header")).alias("width"), F.bool_or("multi_line").alias("multi_line"),
        *[F.bool_or(f"has.{name}").alias(name) for name in TRANSACTION_COLUMNS],
    ).first()

    records = records_of(lines, good, f"{base}/lines" if seen.multi_line else None)
    present = [name for name in TRANSACTION_COLUMNS if seen.width is None or name in ("Transaction_ID", "Description", ORIGIN_COLUMN) or seen[name]]
    parsed = _parsed(records, good, seen.width or 1, present, layouts, money_type, strip_thousands)
    parsed.write.parquet(f"{base}/rows")
    rows = spark.read.schema(parsed.schema).parquet(f"{base}/rows")
    rejected = rows.filter("reason IS NOT NULL")
    transactions = rows.filter("reason IS NULL").select(*present, *([KEY_COLUMN] if keyed else []))
    if unique_ids and seen.width is not None:
        for column in ([KEY_COLUMN] if keyed else []) + ["Transaction_ID"]:
            transactions = _made_unique(transactions, column, ledger)
    rejected_files = _without_lines(lines, files).unionByName(files.filter("reason IS NOT NULL").select("path", "reason"))
    return ExportLoad(
        transactions=canonical_columns(transactions),
        rejected_files=rejected_files,
        rejected_rows=rejected.select(ORIGIN_COLUMN, "row", "reason"),
    )


def _without_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Files of Spark's own listing that no line came from. Scans skip empty files, so only the listing shows them."""
    listed = lines.sparkSession.createDataFrame([(path,) for path in lines.inputFiles()], "path string")
    bare = lambda path: F.regexp_replace(path, r"^(\w+):/+", "$1:/")  # noqa: E731  listings differ in slashes
    return listed.join(files.select(bare("path").alias("known")), bare(listed["path"]) == F.col("known"), "left_anti").select("path", F.lit("empty file").alias("reason"))


def _made_unique(transactions: DataFrame, column: str, ledger: str | None) -> DataFrame:
    if ledger is None:
        return with_unique_ids(transactions, column)
    base = f"{ledger}/{column}"
    assigned = ledgers.assign(transactions, tables.read_segments(transactions.sparkSession, base, ledgers.LEDGER_SCHEMA), column)
    tables.append_segment(assigned.additions, base)
    return assigned.rows


def _source_names(layouts: tuple[Layout, ...]) -> list[str]:
    return list(dict.fromkeys(name for layout in layouts for name in layout.columns))


def _classified(files: DataFrame, layouts: tuple[Layout, ...]) -> DataFrame:
    """Files with their layout's number, the place of each known heading (0: none), the canonical columns they have, or a reason to reject them."""

    def holds(name: str) -> Column:
        return F.array_contains("header", F.lit(name))

    def has(canonical: str) -> Column:
        found = F.lit(False)
        for layout_number, layout in enumerate(layouts):
            for name, target in layout.columns.items():
                if target == canonical:
                    found = found | ((F.col("layout") == layout_number) & holds(name))
        return found.alias(canonical)

    numbers = [F.when(F.forall(F.array(*[F.lit(r) for r in known.required]), lambda r: F.array_contains("header", r)), F.lit(i)) for i, known in enumerate(layouts)]
    repeated = F.size(F.array_distinct("header")) != F.size("header")
    reason = F.when(F.col("open_header"), "header of several lines").when(F.col("layout").isNull(), "no known layout").when(repeated, "repeated column names")
    places = F.array(*[F.array_position("header", F.lit(name)).cast("int") for name in _source_names(layouts)])
    return files.drop("first_line").withColumn("layout", F.coalesce(*numbers)).select(
        "*", reason.alias("reason"), places.alias("places"), F.struct(*[has(name) for name in TRANSACTION_COLUMNS]).alias("has")
    )


def _parsed(records: DataFrame, files: DataFrame, width: int, present: list[str], layouts: tuple[Layout, ...], money_type: str, strip_thousands: bool) -> DataFrame:
    """Records as canonical rows with IDs and the full key; reason and row (the text) tell of rejected ones.

    All files are parsed alike, into as many text fields as the longest header has; what a field means is
    looked up in the places that its file's row holds.
    """
    schema = ", ".join(f"c{i} string" for i in range(width))
    names = _source_names(layouts)
    about = files.select("path", "layout", "places", "has", F.size("header").alias("fields"))
    split = records.join(about, "path").withColumn("c", F.from_csv("text", schema, {"escape": '"', "mode": "PERMISSIVE"}))
    values = F.array(*[F.col(f"c.c{i}") for i in range(width)])
    split = split.withColumn("values", values)
    overfull = separators(F.col("text"), F.col("values")) >= F.col("fields")
    reason = F.when(F.col("too_long"), f"record of more than {LONGEST_RECORD} characters").when(overfull, "more fields than the header")
    named = split.select(
        "layout", "has", F.coalesce(reason, F.lit(None).cast("string")).alias("reason"), F.when(reason.isNotNull(), F.col("text")).alias("row"), _file_name(F.col("path")).alias(ORIGIN_COLUMN),
        *[F.try_element_at("values", F.nullif(F.col("places")[i], F.lit(0))).alias(f"v{i}") for i in range(len(names))],
    )
    known = {name: F.when(~F.col(f"v{i}").isin(*MISSING_TEXTS), F.col(f"v{i}")) for i, name in enumerate(names)}
    wanted = {*present, *DESCRIPTION_PARTS}
    made: dict[str, Column] = {}
    for number, layout in enumerate(layouts):
        fields = {target: known[name] for name, target in layout.columns.items() if target in wanted}
        for name, value in canonical_values(fields, layout, money_type, strip_thousands).items():
            own = F.when(F.col("layout") == number, value)
            made[name] = F.coalesce(made[name], own) if name in made else own
    columns = [f for f in TRANSACTION_SCHEMA if f.name in present and f.name not in ("Transaction_ID", ORIGIN_COLUMN)]
    table = named.select(*[made.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in columns], ORIGIN_COLUMN, "reason", "row", "has")
    # A field that a file doesn't have counts as absent, whatever files are loaded beside it.
    has = {name: F.col(f"has.{name}") for name in IDENTITY_COLUMNS if name != "Description"}
    return with_transaction_id(table, KEY_COLUMN, has).drop("has")


def load_table(
    spark: SparkSession, path: str, layout: Layout, file_format: str = "parquet", **normalize_options
) -> DataFrame:
    """A bank's table that is stored in another format (say, exported spreadsheets as Parquet), with IDs."""
    raw = spark.read.format(file_format).option("header", True).load(path)
    values = [F.col(f"`{name}`").cast("string").alias(name) for name in raw.columns]
    raw = raw.select(*values, _file_name().alias("Source_File"))
    return with_transaction_id(normalize(raw, layout, **normalize_options))


def _file_name(path: Column | None = None) -> Column:
    """The name of a row's file; metadata columns are URI-encoded, where a plus sign stands for itself."""
    name = F.col("_metadata.file_name") if path is None else F.substring_index(path, "/", -1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
