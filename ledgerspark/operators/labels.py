"""Keyed table changes, the manual label store, and manual over rule labels.

Labels belong to a transaction by ``key``: ``Transaction_ID``, or ``Transaction_Key`` (the full hash), which holds where the
short ID has several owners. Tables with full keys carry both columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.filters import is_blank
from ledgerspark.schema import KEY_COLUMN, LABEL_SCHEMA


def label_columns(table: DataFrame) -> list[str]:
    """The label store's columns, with the full key if the table has it."""
    return [*LABEL_SCHEMA.fieldNames(), *([KEY_COLUMN] if KEY_COLUMN in table.columns else [])]


def latest_per_key(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One change per key, the last by ``order``; ties go by the other columns, not by place.

    Pre-aggregated, so a hot key is no burden.
    """
    rest = [name for name in changes.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("__row")
    return changes.groupBy(*keys).agg(newest).select(*[
        F.col(name) if name in keys else F.col(f"__row.{name}").alias(name) for name in changes.columns
    ])


def merge_by_key(
    target: DataFrame,
    keys: list[str],
    changes: DataFrame | None = None,
    deletes: DataFrame | None = None,
    reduced: bool = False,
) -> DataFrame:
    """The target with rows of the given keys removed, and the changed rows added.

    Of several changes to a key one stays (the greatest by its other columns), so that a key never
    doubles; ``reduced`` says that there is one per key already.
    """
    gone = [table.select(*keys) for table in (changes, deletes) if table is not None]
    kept = target
    for table in gone:
        kept = kept.join(table, keys, "left_anti")
    kept = kept.select(*target.columns)
    if changes is None:
        return kept
    return kept.unionByName(changes if reduced else one_per_key(changes, keys), allowMissingColumns=True).select(*target.columns)


def one_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest row of each key, by the other columns in order; map-side combined, so repeats are cheap."""
    rest = [name for name in changes.columns if name not in keys]
    if not rest:
        return changes.select(*keys).distinct()
    largest = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row"))
    return largest.select(*[F.col(name) if name in keys else F.col(f"__row.{name}").alias(name) for name in changes.columns])


def label_rows(changes: DataFrame, as_of: str, source: str = "Manual") -> DataFrame:
    """(Transaction_ID, Category, Subcategory) as label-store rows."""
    made = {"Date_Categorized": F.lit(as_of), "Source": F.lit(source)}
    return changes.select(*[made[name].alias(name) if name in made else F.col(name) for name in label_columns(changes)])


def upsert_labels(store: DataFrame, changes: DataFrame, key: str = "Transaction_ID") -> DataFrame:
    """Replace the labels of the changed transactions; the latest change of one counts."""
    newest = latest_per_key(changes.select(*label_columns(changes)), [key], "Date_Categorized")
    return merge_by_key(store, [key], newest, reduced=True)


def delete_labels(store: DataFrame, ids: DataFrame, key: str = "Transaction_ID") -> DataFrame:
    return merge_by_key(store, [key], deletes=ids)


@dataclass
class KeyedLabels:
    """Labels that found their transaction's full key, and those whose short ID has several owners, or none."""

    labels: DataFrame
    ambiguous: DataFrame
    unknown: DataFrame


def with_keys(labels: DataFrame, transactions: DataFrame) -> KeyedLabels:
    """Give labels of short IDs the full keys of their transactions.

    A label of a short ID with several owners can't be given to one of them, so it is set apart. One
    aggregation of the transactions by short ID gives owners and keys; labels are joined to it.
    """
    owners = transactions.groupBy("Transaction_ID").agg(F.min(KEY_COLUMN).alias(KEY_COLUMN), (F.min(KEY_COLUMN) != F.max(KEY_COLUMN)).alias("__shared"))
    joined = labels.select(*LABEL_SCHEMA.fieldNames()).join(owners, "Transaction_ID", "left")
    columns = LABEL_SCHEMA.fieldNames()
    return KeyedLabels(
        labels=joined.filter("NOT __shared").select(*columns, KEY_COLUMN),
        ambiguous=joined.filter("__shared").select(*columns),
        unknown=joined.filter(F.col("__shared").isNull()).select(*columns),
    )


def rule_labels(categorized: DataFrame, as_of: str | Column) -> DataFrame:
    """Rule results with a category as label-store rows."""
    stamp = F.lit(as_of) if isinstance(as_of, str) else as_of
    made = {"Date_Categorized": stamp, "Source": F.col("Categorization_Source")}
    found = categorized.filter(~is_blank(F.col("Category")))
    return found.select(*[made[name].alias(name) if name in made else F.col(name) for name in label_columns(categorized)])


def effective_labels(categorized: DataFrame, manual: DataFrame, as_of: str, key: str = "Transaction_ID") -> DataFrame:
    """Every manual label, and rule labels for the other transactions.

    One equi join on the key; with few manual labels it is a broadcast anti join.
    """
    columns = [name for name in label_columns(manual) if name in label_columns(categorized)]
    from_rules = rule_labels(categorized, as_of).join(manual.select(key), key, "left_anti")
    return manual.select(*columns).unionByName(from_rules.select(*columns))


def overlay(categorized: DataFrame, manual: DataFrame, key: str = "Transaction_ID") -> DataFrame:
    """Every transaction with its effective label, after one left join to the manual labels.

    The latest manual label of a key counts, also a blank one; else the rule's. Adds Source, Labelled_By (manual, rule or
    null) and Status, and Category and Subcategory are the effective ones, null without a label. Only the
    manual labels are reduced by key; where they are few they are broadcast and no transaction moves.
    """
    names = ["Category", "Subcategory", "Date_Categorized", "Source"]
    newest = latest_per_key(manual.select(key, *names), [key], "Date_Categorized")
    joined = categorized.join(newest.select(key, F.struct(*names).alias("__manual")), key, "left")
    by_hand, by_rule = F.col("__manual").isNotNull(), ~is_blank(F.col("Category"))

    def effective(name: str, ruled: str) -> Column:
        return F.when(by_hand, F.col(f"__manual.{name}")).when(by_rule, F.col(ruled)).alias(name)

    rest = [name for name in categorized.columns if name not in ("Category", "Subcategory", "Categorization_Source")]
    chosen = joined.select(
        *rest,
        effective("Category", "Category"),
        effective("Subcategory", "Subcategory"),
        effective("Source", "Categorization_Source"),
        F.when(by_hand, "manual").when(by_rule, "rule").alias("Labelled_By"),
    )
    return chosen.withColumn("Status", F.when(~is_blank(F.col("Category")), "Categorized").otherwise("Uncategorized"))


def labels_of(labels: DataFrame, transactions: DataFrame, key: str = "Transaction_ID") -> DataFrame:
    """The labels of the given transactions."""
    return labels.join(transactions.select(key), key, "left_semi").select(*labels.columns)
