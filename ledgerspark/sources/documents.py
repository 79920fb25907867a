"""Rule and category documents (JSON) as tables, and tables as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.paging import numbered
from ledgerspark.operators.rules import RULE_TABLE_SCHEMA, RuleSet
from ledgerspark.sources.tables import path_exists

_RULE = (
    "struct<id:string,name:string,description:string,category:string,subcategory:string,priority:int,active:boolean,"
    "conditions:string,created_at:string,created_by:string,last_modified_at:string,last_modified_by:string>"
)
RULES_DOCUMENT = f"categorization_rules struct<rules:array<{_RULE}>>, first_rule bigint"
#: Rules of one document at most; a larger set becomes several, each of which tells the place of its first rule.
RULES_PER_DOCUMENT = 20_000
CATEGORIES_DOCUMENT = (
    "categories map<string,struct<description:string,active:boolean,"
    "subcategories:map<string,struct<description:string,active:boolean>>>>"
)
CATEGORY_TABLE = "category string, description string, active boolean"
TREE_TABLE = "category string, subcategory string, description string, active boolean"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One row per rule, ``seq`` its place; conditions stay JSON text. A missing or broken file gives no rules.

    A folder may hold a rule set in several documents, as ``write_rules`` leaves it.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], RULE_TABLE_SCHEMA)
    document = spark.read.schema(RULES_DOCUMENT).option("multiLine", True).json(path)
    rules = document.select(F.coalesce("first_rule", F.lit(0)).alias("first"), F.posexplode("categorization_rules.rules").alias("place", "rule"))
    return rules.select((F.col("first") + F.col("place")).cast("int").alias("seq"), "rule.*")


def write_rules(rules: DataFrame, path: str) -> None:
    """The rules in document order as a JSON document; empty entries are left out.

    A document is one value by its format, which one task makes and reads. So of more than ``RULES_PER_DOCUMENT``
    rules each such part of the order is a document in a file of its own, with ``first_rule``, the place where it begins.
    """
    fields = [name for name in RULE_TABLE_SCHEMA.fieldNames() if name != "seq" and name in rules.columns]
    entries = rules.select("seq", F.struct(*fields).alias("rule"))
    in_order = lambda place: F.transform(F.array_sort(F.collect_list(F.struct(place, "rule"))), lambda entry: entry["rule"]).alias("rules")
    document = F.struct("rules").alias("categorization_rules")
    if entries.count() <= RULES_PER_DOCUMENT:
        entries.agg(in_order("seq")).select(document).write.json(path)
        return
    placed = numbered(entries, [F.col("seq"), F.col("rule")], "place").withColumn("part", F.expr(f"(place - 1) div {RULES_PER_DOCUMENT}"))
    parts = placed.groupBy("part").agg(in_order("place")).select(document, (F.col("part") * RULES_PER_DOCUMENT).alias("first_rule"))
    parts.write.option("maxRecordsPerFile", 1).json(path)


def read_rule_set(spark: SparkSession, path: str) -> RuleSet:
    return RuleSet.from_table(read_rules(spark, path))


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The category table and the subcategory table. A missing or broken file gives empty ones."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CATEGORY_TABLE), spark.createDataFrame([], TREE_TABLE)
    document = spark.read.schema(CATEGORIES_DOCUMENT).option("multiLine", True).json(path)
    top = document.select(F.explode("categories").alias("category", "entry"))
    categories = top.select("category", "entry.description", "entry.active")
    tree = top.select("category", F.explode("entry.subcategories").alias("subcategory", "below"))
    return categories, tree.select("category", "subcategory", "below.description", "below.active")


def write_categories(categories: DataFrame, tree: DataFrame, path: str) -> None:
    """Categories with their subcategories as one JSON document; subcategories of unknown categories are left out."""
    entry = F.struct("subcategory", F.struct("description", "active"))
    below = tree.groupBy("category").agg(F.map_from_entries(F.collect_list(entry)).alias("subcategories"))
    top = F.struct("category", F.struct("description", "active", "subcategories"))
    document = categories.join(below, "category", "left").agg(F.map_from_entries(F.collect_list(top)).alias("categories"))
    document.write.json(path)
