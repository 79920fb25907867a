"""Content-based transaction IDs and the suffixes that make them unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerspark.functions.text import text_form
from ledgerspark.schema import IDENTITY_COLUMNS, ORIGIN_COLUMN, TRANSACTION_COLUMNS
from ledgerspark.session import ensure_checkpoint_dir

# Copies of one row are numbered in slices of this size, each its own task input.
COPIES_PER_SLICE = 100_000
# Up to this many IDs or numbered contents (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
# An ID with more rows than this is numbered in buckets of its contents.
HOT_ROWS = 1_000_000
# Leading hex digits of the content hash that split a much-repeated ID.
_BUCKET_DIGITS = 4


def _identity_text(df: DataFrame, name: str) -> Column:
    """Field text for hashing: absent gives '', null gives 'NaT' or 'nan'."""
    if name not in df.columns:
        return F.lit("")
    data_type = df.schema[name].dataType
    missing = "NaT" if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "nan"
    return F.coalesce(text_form(F.col(name), data_type), F.lit(missing))


def identity_hash(df: DataFrame, present: dict[str, Column] | None = None) -> Column:
    """Full md5, 32 hex digits, of the six identity fields.

    ``present`` tells row by row whether a field is there, for tables of rows from different files;
    fields that aren't named in it are there when the table has them.
    """
    texts = []
    for name in IDENTITY_COLUMNS:
        text = _identity_text(df, name)
        texts.append(F.when(present[name], text).otherwise("") if present and name in present else text)
    return F.md5(F.concat_ws("|", *texts))


def with_transaction_id(df: DataFrame, key_column: str | None = None, present: dict[str, Column] | None = None) -> DataFrame:
    """Add ``Transaction_ID``, ``TXN_`` and eight hex digits.

    Eight digits collide once a table holds some 100,000 rows; ``key_column``
    also keeps the full hash, which is the better join key. A projection.
    """
    digest = identity_hash(df, present)
    # Only hex digits, so upper case needs no rules of a language, which cost more than the hash.
    df = df.withColumn("Transaction_ID", F.concat(F.lit("TXN_"), F.translate(F.substring(digest, 1, 8), "abcdef", "ABCDEF")))
    if key_column:
        df = df.withColumn(key_column, digest)
    front = [name for name in TRANSACTION_COLUMNS if name in df.columns]
    return df.select(*front, *[name for name in df.columns if name not in front])


def duplicate_id_count(df: DataFrame, id_column: str = "Transaction_ID") -> DataFrame:
    """How many rows repeat an ID that an earlier row has."""
    per_id = df.groupBy(id_column).agg(F.count("*").alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """md5 over the whole row; lengths keep fields, and null from text, apart."""
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        sized = F.concat(F.length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("~")))
    return F.md5(F.concat_ws("|", *parts))


def content_key(df: DataFrame) -> Column:
    """What rows of one ID are told apart and ordered by: the md5 of all but the file they came from, then the file."""
    digest = content_hash(df, [name for name in df.columns if name != ORIGIN_COLUMN])
    if ORIGIN_COLUMN not in df.columns:
        return digest
    return F.concat(digest, F.lit(":"), F.coalesce(F.col(ORIGIN_COLUMN), F.lit("")))


def shared_ids(df: DataFrame, key: str, id_column: str = "Transaction_ID") -> DataFrame:
    """IDs with several owners: how many different values of ``key`` each stands for, and its rows."""
    owners = F.count_distinct(key).alias("owners")
    return df.groupBy(id_column).agg(owners, F.count("*").alias("rows")).filter(F.col("owners") > 1)


def with_unique_ids(df: DataFrame, id_column: str = "Transaction_ID") -> DataFrame:
    """Suffix repeated IDs with ``_1``, ``_2``, …; the first keeps the plain ID.

    "First" is by row content (its md5, then the file), so file order and reruns do not matter.
    Rows added later may come in between; ``ledger.assign`` numbers them behind what is known.
    Rows are never grouped whole by ID. A count per ID finds the repeated ones,
    and reads the ID column only; contents are then counted for those alone. The
    running index is a sum over these counts; an ID with very many rows is split
    by the leading digits of the content hash. What has to change is joined back:
    as a broadcast when it is little, so that the wide rows are not shuffled,
    else as a shuffle join. Exact copies of a row are counted, then written out
    again slice by slice. The counting runs when the function is called.
    """
    columns = df.columns
    ensure_checkpoint_dir(df.sparkSession)
    per_id = df.groupBy(F.col(id_column).alias("__rid")).agg(F.count("*").alias("__rows"))
    repeated = per_id.filter(F.col("__rows") > 1).checkpoint()
    sizes = repeated.agg(F.count("*").alias("ids"), F.count_if(F.col("__rows") > HOT_ROWS).alias("hot")).first()
    if not sizes.ids:
        return df

    hashed = df.withColumn("__content", content_key(df))
    keys = hashed.select(F.col(id_column).alias("__id"), "__content").join(
        F.broadcast(repeated) if sizes.ids <= BROADCAST_ROWS else repeated, F.col("__id") == F.col("__rid")
    )
    starts = _start_numbers(keys, split=sizes.hot > 0)
    starts = starts.filter((F.col("__start") > 0) | (F.col("__copies") > 1)).checkpoint()
    found = starts.agg(F.count("*").alias("rows"), F.count_if(F.col("__copies") > 1).alias("copied")).first()

    joined = hashed.join(
        F.broadcast(starts) if found.rows <= BROADCAST_ROWS else starts,
        (F.col(id_column) == F.col("__id")) & (F.col("__content") == F.col("__content_key")),
        "left",
    ).drop("__content", "__content_key", "__id")
    numbered = joined.withColumn("__n", F.coalesce(F.col("__start"), F.lit(0)))
    if found.copied:
        once = numbered.filter(F.coalesce(F.col("__copies"), F.lit(1)) == 1).select(*columns, "__n")
        numbered = once.unionByName(_write_out_copies(joined.filter(F.col("__copies") > 1), columns, id_column))
    return suffixed(numbered, "__n", id_column).select(*columns)


def suffixed(df: DataFrame, number: str, id_column: str) -> DataFrame:
    """The ID with its number behind it; number 0 stays plain."""
    text = F.when(F.col(number) > 0, F.concat_ws("_", id_column, F.col(number).cast("string")))
    return df.withColumn(id_column, text.otherwise(F.col(id_column)))


def _write_out_copies(copied: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Equal rows, counted and then repeated with consecutive numbers."""
    return write_out(copied.groupBy(*columns, "__start").agg(F.count("*").alias("__copies")), columns, id_column)


def write_out(copied: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Each row ``__copies`` times, numbered from ``__start``, in slices that spread over tasks."""
    last_slice = F.expr(f"(__copies - 1) div {COPIES_PER_SLICE}")
    copied = copied.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), last_slice)))
    copied = copied.repartition(id_column, "__start", "__slice")
    first = F.col("__slice") * COPIES_PER_SLICE
    last = F.least(first + (COPIES_PER_SLICE - 1), F.col("__copies") - 1)
    copied = copied.withColumn("__copy", F.explode(F.sequence(first, last)))
    return copied.withColumn("__n", F.col("__start") + F.col("__copy")).select(*columns, "__n")


def _start_numbers(keys: DataFrame, split: bool) -> DataFrame:
    """Per (ID, content) of a repeated ID: the first index and the number of copies."""
    return running_starts(keys.groupBy("__id", "__content", "__rows").agg(F.count("*").alias("__copies")), split)


def running_starts(per_content: DataFrame, split: bool) -> DataFrame:
    """(ID, content, copies, rows of the ID) with the sum of the copies before each content of an ID.

    With ``split``, IDs of many rows are summed in buckets of their contents.
    """
    bucket = F.when(F.col("__rows") > HOT_ROWS, F.substring("__content", 1, _BUCKET_DIGITS)).otherwise("")
    per_content = per_content.withColumn("__bucket", bucket if split else F.lit(""))
    inside = (
        Window.partitionBy("__id", "__bucket").orderBy("__content").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum("__copies").over(inside), F.lit(0))
    counted = per_content.withColumn("__start", start)
    if split:
        # Only IDs with very many rows have buckets, at most 16 ** _BUCKET_DIGITS each.
        before = Window.partitionBy("__oid").orderBy("__obucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            per_content.filter(F.col("__bucket") != "")
            .groupBy(F.col("__id").alias("__oid"), F.col("__bucket").alias("__obucket"))
            .agg(F.sum("__copies").alias("__bucket_rows"))
            .withColumn("__offset", F.coalesce(F.sum("__bucket_rows").over(before), F.lit(0)))
        )
        counted = counted.join(
            offsets, (F.col("__id") == F.col("__oid")) & (F.col("__bucket") == F.col("__obucket")), "left"
        ).withColumn("__start", F.col("__start") + F.coalesce(F.col("__offset"), F.lit(0)))
    return counted.select("__id", F.col("__content").alias("__content_key"), "__copies", "__start")
