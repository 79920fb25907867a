"""Slices of the transaction table, and the projections they are shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import dates
from ledgerspark.functions.text import is_blank, literal_pattern
from ledgerspark.operators.conditions import Options, java_accepts, java_pattern, matching_rows

LARGE_ABOVE = 100
SMALL_BELOW = 50
PREVIEW_COLUMNS = ("Date", "Amount", "Description", "Counterparty_Name")
# Shown columns and the headings they get.
DISPLAY_COLUMNS = {
    "Date": "Date",
    "Amount": "Amount",
    "Counterparty_Name": "Counterparty",
    "Description": "Description",
    "Category": "Category",
    "Subcategory": "Subcategory",
    "Categorization_Source": "Source",
}

AMOUNT_FILTERS = {
    "expenses": lambda: F.col("Amount") < 0,
    "income": lambda: F.col("Amount") > 0,
    "large": lambda: F.abs("Amount") > LARGE_ABOVE,
    "small": lambda: F.abs("Amount") < SMALL_BELOW,
}


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    return df if category is None else df.filter(F.col("Category") == category)


def by_amount(df: DataFrame, which: str | None) -> DataFrame:
    """``expenses``, ``income``, ``large`` (above 100) or ``small`` (below 50)."""
    return df if which is None else df.filter(AMOUNT_FILTERS[which]())


def by_period(df: DataFrame, which: str | None, as_of=None) -> DataFrame:
    """``last30``, ``last90``, ``this_year`` or ``last_year``, seen from ``as_of``.

    Only ``last_year`` has an upper end. The bounds are constants, so they reach
    the scan as pushed filters; with a Year column they also prune its folders.
    """
    if which is None:
        return df
    until = None
    if which in ("last30", "last90"):
        since = dates.days_before(as_of, int(which[4:]))
    elif which == "this_year":
        since = dates.year_start(as_of)
    elif which == "last_year":
        since, until = dates.year_start(as_of, 1), dates.year_start(as_of)
    else:
        raise ValueError(f"unknown period {which!r}")
    kept = df.filter(F.col("Date") >= dates.moment(since))
    if until is not None:
        kept = kept.filter(F.col("Date") < dates.moment(until))
    if "Year" in df.columns:
        kept = kept.filter(F.col("Year") >= since.year)
        if until is not None:
            kept = kept.filter(F.col("Year") < until.year)
    return kept


def by_label(df: DataFrame, labels: DataFrame, mode: str = "uncategorized", key: str = "Transaction_ID") -> DataFrame:
    """Transactions without a label, with one, or all of them."""
    if mode == "all":
        return df
    how = {"uncategorized": "left_anti", "categorized": "left_semi"}[mode]
    return df.join(labels.select(key), key, how).select(*df.columns)


def categorized_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Category") != "")


def without_blank_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~is_blank(F.col("Category")))


def is_manual() -> Column:
    return F.coalesce(F.col("Source") == "Manual", F.lit(False))


def is_from_rule(column: str = "Source") -> Column:
    return F.coalesce(F.startswith(column, F.lit("Rule:")), F.lit(False))


def search_description(df: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Case-insensitive search; the text is a pattern unless ``literal``.

    Any length of text is searched; a bad pattern is an error.
    """
    pattern = java_pattern(literal_pattern(text) if literal else text, ignore_case=True)
    if pattern is None or not java_accepts(df.sparkSession, pattern):
        raise ValueError(f"not a valid pattern: {text}")
    return df.filter(F.col("Description").rlike(pattern))


def search_cards(df: DataFrame) -> DataFrame:
    """What is shown of a found transaction."""
    shown = [
        F.col("Transaction_ID"),
        F.col("Description"),
        F.format_string("%.2f", F.col("Amount").cast("double")).alias("amount_text"),
        F.col("Date"),
    ]
    if "Counterparty_Name" in df.columns:
        shown.append(F.col("Counterparty_Name"))
    return df.select(*shown)


def with_labels(df: DataFrame, labels: DataFrame, key: str = "Transaction_ID") -> DataFrame:
    """Each transaction with its category, subcategory and source, null when unlabelled."""
    return df.join(labels.select(key, "Category", "Subcategory", "Source"), key, "left")


def lookup(df: DataFrame, transaction_id: str) -> DataFrame:
    return df.filter(F.col("Transaction_ID") == transaction_id)


def display(df: DataFrame) -> DataFrame:
    """The seven shown columns that exist, dates as ``yyyy-MM-dd``."""
    shown = []
    for name, heading in DISPLAY_COLUMNS.items():
        if name in df.columns:
            value = F.date_format(name, "yyyy-MM-dd") if name == "Date" else F.col(name)
            shown.append(value.alias(heading))
    return df.select(*shown)


def preview(df: DataFrame, conditions, limit: int = 20, options: Options = Options()) -> DataFrame:
    """The first matches of a condition by date and ID, in the preview columns."""
    order = [name for name in ("Date", "Transaction_ID") if name in df.columns]
    first = matching_rows(df, conditions, options).orderBy(*order).limit(limit)
    return first.select(*[name for name in PREVIEW_COLUMNS if name in df.columns])


def preview_total(df: DataFrame, conditions, options: Options = Options()) -> DataFrame:
    """Exact number of matches."""
    return matching_rows(df, conditions, options).agg(F.count("*").alias("total_matches"))
