"""Bank exports, all text, to the canonical transaction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import dates, numbers, text
from ledgerspark.schema import KEY_COLUMN, TRANSACTION_COLUMNS, TRANSACTION_SCHEMA, Layout

DESCRIPTION_PARTS = ("Description_1", "Description_2", "Description_3")


def canonical_values(
    fields: dict[str, Column],
    layout: Layout,
    money_type: str = "double",
    strip_thousands: bool = False,
) -> dict[str, Column]:
    """A layout's text fields, by canonical name, as canonical columns in canonical order.

    ``Description`` is always made, and never null; what ``fields`` lacks is left out.
    """
    parts = [fields[name] for name in DESCRIPTION_PARTS if name in fields]
    made: dict[str, Column] = {}
    for name in TRANSACTION_COLUMNS:
        if name == "Description":
            made[name] = text.collapse_whitespace(text.join_non_empty(*parts)) if parts else F.lit("")
        elif name not in fields:
            continue
        elif name in ("Amount", "Balance_After"):
            made[name] = numbers.parse_decimal_comma(fields[name], strip_thousands).cast(money_type)
        elif name == "Date":
            made[name] = dates.parse_date(fields[name], layout.date_formats)
        elif name == "Sequence_Number":
            made[name] = numbers.parse_whole_number(fields[name])
        else:
            made[name] = fields[name]
    return made


def normalize(
    raw: DataFrame,
    layout: Layout,
    money_type: str = "double",
    strip_thousands: bool = False,
) -> DataFrame:
    """One layout's raw columns to canonical names, types and order.

    Only columns that the export has are produced, except ``Description``,
    which is always there and never null. A plain projection: no shuffle, and
    it prunes the scan to the mapped columns.
    """
    renamed = raw.withColumnsRenamed({k: v for k, v in layout.columns.items() if k in raw.columns})
    fields = {name: F.col(name) for name in renamed.columns if name in TRANSACTION_COLUMNS or name in DESCRIPTION_PARTS}
    made = canonical_values(fields, layout, money_type, strip_thousands)
    return renamed.select(*[value.alias(name) for name, value in made.items()])


def canonical_columns(df: DataFrame) -> DataFrame:
    """The canonical columns that exist, in canonical order, and the full key; others are dropped."""
    return df.select(*[name for name in [*TRANSACTION_COLUMNS, KEY_COLUMN] if name in df.columns])


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column one side lacks is null there."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return canonical_columns(united)


def empty_transactions(spark) -> DataFrame:
    return spark.createDataFrame([], TRANSACTION_SCHEMA)


def load_summary(df: DataFrame) -> DataFrame:
    """Row count, first and last date, and the column list, in one pass."""
    return df.agg(
        F.count("*").alias("total_transactions"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
    ).withColumn("columns", F.lit(", ".join(df.columns)))


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("Year", F.year("Date"))
