"""Coverage, distribution and yearly figures. All are one-pass aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerspark.functions.numbers import percent, round_half_even
from ledgerspark.functions.text import is_blank
from ledgerspark.operators.filters import is_from_rule, is_manual, without_blank_labels

STATUSES = ["Categorized", "Uncategorized"]


def header_metrics(categorized: DataFrame) -> DataFrame:
    """Total, categorised and rule-based rows, with shares (null for an empty table)."""
    figures = categorized.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(~is_blank(F.col("Category"))).alias("categorized"),
        F.count_if(is_from_rule("Categorization_Source")).alias("rule_based"),
    )
    return figures.select(
        "*",
        percent(F.col("categorized"), F.col("total_transactions")).alias("categorized_pct"),
        percent(F.col("rule_based"), F.col("total_transactions")).alias("rule_based_pct"),
    )


def progress(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Total, labelled, unlabelled and share.

    ``categorized`` counts label rows, stale ones too, and so can pass the
    total; ``categorized_present`` counts rows of the table with a usable label.
    Both tables are read once and meet in one aggregation by ID.
    """
    sides = transactions.select(
        "Transaction_ID", F.lit(1).alias("rows"), F.lit(0).alias("labels"), F.lit(False).alias("usable")
    ).unionByName(
        labels.select(
            "Transaction_ID",
            F.lit(0).alias("rows"),
            F.lit(1).alias("labels"),
            (~is_blank(F.col("Category"))).alias("usable"),
        )
    )
    per_id = sides.groupBy("Transaction_ID").agg(
        F.sum("rows").alias("rows"), F.sum("labels").alias("labels"), F.bool_or("usable").alias("usable")
    )
    figures = per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_transactions"),
        F.coalesce(F.sum("labels"), F.lit(0)).alias("categorized"),
        F.coalesce(F.sum(F.when(F.col("usable"), F.col("rows"))), F.lit(0)).alias("categorized_present"),
    )
    return figures.select(
        "total_transactions",
        "categorized",
        (F.col("total_transactions") - F.col("categorized")).alias("uncategorized"),
        "categorized_present",
        F.coalesce(percent(F.col("categorized"), F.col("total_transactions")), F.lit(0.0)).alias("progress_pct"),
    )


def overlay_progress(overlaid: DataFrame, manual: DataFrame) -> DataFrame:
    """The figures of ``progress`` from ``labels.overlay``: no second join, the manual labels are only counted."""
    figures = overlaid.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(F.col("Labelled_By") == "rule").alias("by_rule"),
        F.count_if(F.col("Status") == "Categorized").alias("categorized_present"),
    ).withColumn("categorized", F.col("by_rule") + manual.agg(F.count("*").alias("n")).scalar())
    return figures.select(
        "total_transactions",
        "categorized",
        (F.col("total_transactions") - F.col("categorized")).alias("uncategorized"),
        "categorized_present",
        F.coalesce(percent(F.col("categorized"), F.col("total_transactions")), F.lit(0.0)).alias("progress_pct"),
    )


def _share_of_total(counted: DataFrame, count: str) -> Column:
    return percent(F.col(count), counted.agg(F.sum(count).alias("total")).scalar())


def category_distribution(labels: DataFrame) -> DataFrame:
    """Labels per category, most first, with the share of all non-blank labels."""
    counted = without_blank_labels(labels).groupBy("Category").agg(F.count("*").alias("transactions"))
    return counted.withColumn("percentage", _share_of_total(counted, "transactions")).orderBy(
        F.desc("transactions"), "Category"
    )


def invalid_label_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(is_blank(F.col("Category"))).alias("invalid_labels"))


def invalid_label_sample(labels: DataFrame, limit: int = 10) -> DataFrame:
    """The first labels without a usable category, by ID."""
    suspect = labels.filter(is_blank(F.col("Category")))
    return suspect.select("Transaction_ID", "Category", "Source").orderBy("Transaction_ID").limit(limit)


def source_split(labels: DataFrame) -> DataFrame:
    """Non-blank labels set by hand and by rules."""
    return without_blank_labels(labels).agg(
        F.count_if(is_manual()).alias("manual_labels"),
        F.count_if(is_from_rule()).alias("rule_labels"),
    )


def top_rules(labels: DataFrame, limit: int = 5) -> DataFrame:
    """The rules with most labels."""
    return (
        without_blank_labels(labels)
        .filter(is_from_rule())
        .groupBy("Source")
        .agg(F.count("*").alias("transactions"))
        .orderBy(F.desc("transactions"), "Source")
        .limit(limit)
        .select(F.replace("Source", F.lit("Rule: "), F.lit("")).alias("rule_name"), "transactions")
    )


def with_status(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Add Status: does a non-blank label exist for the row? Row count is kept."""
    labelled = without_blank_labels(labels).select("Transaction_ID").distinct().withColumn("__labelled", F.lit(True))
    joined = transactions.join(labelled, "Transaction_ID", "left")
    status = F.when(F.col("__labelled"), "Categorized").otherwise("Uncategorized")
    return joined.withColumn("Status", status).drop("__labelled")


def yearly_counts(marked: DataFrame) -> DataFrame:
    """Rows per year and status; rows without a date drop out."""
    return (
        marked.filter(F.col("Date").isNotNull())
        .groupBy(F.year("Date").alias("Year"), "Status")
        .agg(F.count("*").alias("Count"))
    )


def yearly_pivot(marked: DataFrame) -> DataFrame:
    """One row per year with both counts, gaps as 0, and their total."""
    per_year = marked.filter(F.col("Date").isNotNull()).groupBy(F.year("Date").alias("Year"))
    counts = [F.count_if(F.col("Status") == status).alias(status) for status in STATUSES]
    return per_year.agg(*counts).withColumn("Total", F.col("Categorized") + F.col("Uncategorized"))


def status_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch of changes does to ``yearly_counts``: Year, Status and Count to add, negative where rows are retracted.

    ``before`` and ``after`` are the changed transactions alone, marked by the labels as they were and as they are.
    """
    counted = [yearly_counts(rows).withColumn("Count", F.lit(sign) * F.col("Count")) for rows, sign in ((before, -1), (after, 1))]
    return merged_counts(*counted)


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Kept counts with changes added; years and statuses without rows drop out. As small as there are years."""
    united = reduce(DataFrame.unionByName, [p.select("Year", "Status", "Count") for p in parts])
    return united.groupBy("Year", "Status").agg(F.sum("Count").alias("Count")).filter("Count <> 0")


def pivot_of_counts(counts: DataFrame) -> DataFrame:
    """``yearly_pivot`` from kept counts."""
    columns = [F.coalesce(F.sum(F.when(F.col("Status") == status, F.col("Count"))), F.lit(0)).alias(status) for status in STATUSES]
    return counts.groupBy("Year").agg(*columns).withColumn("Total", F.col("Categorized") + F.col("Uncategorized"))


def yearly_progress(marked: DataFrame) -> DataFrame:
    """The yearly pivot with the share categorised, one decimal, half to even."""
    share = round_half_even(percent(F.col("Categorized"), F.col("Total")), 1)
    return yearly_pivot(marked).withColumn("Categorized_Pct", share)


def overall_status(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole-table figures over the non-blank labels."""
    sides = transactions.select(F.lit(1).alias("rows"), F.lit(0).alias("labels")).unionByName(
        without_blank_labels(labels).select(F.lit(0).alias("rows"), F.lit(1).alias("labels"))
    )
    figures = sides.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_transactions"),
        F.coalesce(F.sum("labels"), F.lit(0)).alias("categorized"),
    )
    return figures.select(
        "total_transactions",
        "categorized",
        (F.col("total_transactions") - F.col("categorized")).alias("uncategorized"),
        F.coalesce(percent(F.col("categorized"), F.col("total_transactions")), F.lit(0.0)).alias("categorized_pct"),
    )


def distinct_categories(df: DataFrame, with_blank: bool = False) -> DataFrame:
    """Category names in order, the empty one left out unless asked for."""
    names = df.select("Category").distinct()
    return (names if with_blank else names.filter(F.col("Category") != "")).orderBy("Category")
