"""Rule and category catalogues as tables: figures, order, checks and changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import dates
from ledgerspark.functions.numbers import parse_float, percent
from ledgerspark.functions.text import shorten
from ledgerspark.operators.conditions import ALL_OPERATORS
from ledgerspark.operators.labels import latest_per_key, merge_by_key, one_per_key
from ledgerspark.operators.paging import numbered
from ledgerspark.operators.rules import DEFAULT_PRIORITY
from ledgerspark.schema import RULE_FIELDS
from ledgerspark.session import ensure_checkpoint_dir

# The five priority bands, lower end and label.
PRIORITY_BANDS = [
    (90, "90-100 (Very High)"),
    (70, "70-89 (High)"),
    (50, "50-69 (Medium)"),
    (30, "30-49 (Low)"),
    (None, "1-29 (Very Low)"),
]


def is_active() -> Column:
    return F.coalesce(F.col("active"), F.lit(True))


def priority() -> Column:
    return F.coalesce(F.col("priority"), F.lit(DEFAULT_PRIORITY))


def category_name() -> Column:
    return F.coalesce(F.col("category"), F.lit("Unknown"))


def by_status(rules: DataFrame, status: str = "all") -> DataFrame:
    """``active``, ``inactive`` or ``all`` rules."""
    return {"all": rules, "active": rules.filter(is_active()), "inactive": rules.filter(~is_active())}[status]


def rules_status(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count("*").alias("total_rules"),
        F.count_if(is_active()).alias("active_rules"),
        F.count_if(~is_active()).alias("inactive_rules"),
    )


def average_priority(rules: DataFrame) -> DataFrame:
    return rules.agg(F.coalesce(F.avg(priority()), F.lit(0.0)).alias("average_priority"))


def activation_rate(rules: DataFrame) -> DataFrame:
    rate = percent(F.count_if(is_active()), F.count("*"))
    return rules.agg(F.coalesce(rate, F.lit(0.0)).alias("activation_rate"))


def rules_by_category(rules: DataFrame) -> DataFrame:
    """Rules per category, and where the category first appears."""
    return rules.groupBy(category_name().alias("category")).agg(
        F.count("*").alias("rules"), F.min("seq").alias("first_seq")
    )


def distinct_category_count(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count_distinct(category_name()).alias("categories_used"))


def top_categories(rules: DataFrame, limit: int = 5) -> DataFrame:
    """Categories with most rules; ties go to the one seen first."""
    ranked = rules_by_category(rules).orderBy(F.desc("rules"), "first_seq").limit(limit)
    return ranked.select("category", "rules")


def most_used_category(rules: DataFrame) -> DataFrame:
    return top_categories(rules, 1).select("category", shorten(F.col("category")).alias("shown"), "rules")


def priority_bands(rules: DataFrame) -> DataFrame:
    """Rules per priority band, empty bands with 0."""
    band = F.lit(PRIORITY_BANDS[-1][1])
    for low, label in reversed(PRIORITY_BANDS[:-1]):
        band = F.when(priority() >= low, label).otherwise(band)
    counted = rules.groupBy(band.alias("priority_range")).agg(F.count("*").alias("n"))
    bands = rules.sparkSession.createDataFrame(
        [(i, label) for i, (_, label) in enumerate(PRIORITY_BANDS)], "band_order int, priority_range string"
    )
    return bands.join(counted, "priority_range", "left").select(
        "band_order", "priority_range", F.coalesce("n", F.lit(0)).alias("rules")
    )


def creation_timeline(rules: DataFrame) -> DataFrame:
    """Rules created per day; unreadable stamps are left out."""
    day = F.to_date(dates.parse_iso(F.col("created_at")))
    return (
        rules.select(day.alias("day"))
        .filter(F.col("day").isNotNull())
        .groupBy("day")
        .agg(F.count("*").alias("rules_created"))
        .orderBy("day")
    )


def created_recently(rules: DataFrame, as_of, days: int = 7) -> DataFrame:
    return rules.filter(dates.parse_iso(F.col("created_at")) > dates.moment(dates.days_before(as_of, days)))


def by_priority_order(default: int = 0) -> list[Column]:
    """Highest first, document order on ties. Listing takes 0 for none, applying 50."""
    return [F.coalesce(F.col("priority"), F.lit(default)).desc(), F.col("seq").asc()]


def by_created_order(newest_first: bool = True) -> list[Column]:
    """A missing stamp sorts as the text ``Unknown``."""
    stamp = F.coalesce(F.col("created_at"), F.lit("Unknown"))
    return [stamp.desc() if newest_first else stamp.asc(), F.col("seq").asc()]


def by_name_order() -> list[Column]:
    return [F.lower(F.coalesce("name", F.lit(""))).asc(), F.col("seq").asc()]


def priority_level(value: Column) -> Column:
    return F.when(value >= 90, "high").when(value >= 70, "medium").otherwise("low")


def rule_overview(rules: DataFrame, as_of) -> DataFrame:
    """Every rule as listed: defaults filled in, stamps formatted, age told."""
    created = dates.parse_iso(F.col("created_at"))
    modified = dates.parse_iso(F.col("last_modified_at"))
    listed = F.coalesce(F.col("priority"), F.lit(0))
    return rules.select(
        "seq",
        F.coalesce("id", F.concat(F.lit("rule_"), F.col("seq").cast("string"))).alias("id"),
        F.coalesce("name", F.lit("Unnamed Rule")).alias("name"),
        F.coalesce("description", F.lit("No description")).alias("description"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("subcategory", F.lit("")).alias("subcategory"),
        listed.alias("priority"),
        priority_level(listed).alias("level"),
        F.when(is_active(), "Active").otherwise("Inactive").alias("status"),
        F.coalesce(F.date_format(created, "yyyy-MM-dd HH:mm"), "created_at", F.lit("Unknown")).alias("created"),
        F.coalesce("created_by", F.lit("Unknown")).alias("created_by"),
        F.coalesce(dates.age_text(created, as_of), F.lit("Unknown")).alias("age"),
        F.coalesce(
            F.date_format(modified, "yyyy-MM-dd HH:mm"), "last_modified_at", F.lit("Not modified")
        ).alias("last_modified"),
    )


def missing_parts(rules: DataFrame) -> DataFrame:
    """One row per requirement a rule fails before it may be saved."""

    def empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    failed = {
        "name": empty("name"),
        "category": empty("category"),
        "subcategory": empty("subcategory"),
        "conditions": F.trim(F.coalesce("conditions", F.lit(""))).isin("", "{}", "null"),
        "priority between 1 and 100": ~priority().between(1, 100),
    }
    checks = F.array_compact(F.array(*[F.when(test, part) for part, test in failed.items()]))
    return rules.select("id", F.explode(checks).alias("missing"))



def _opened(rules: DataFrame) -> DataFrame:
    """Every node and leaf of the rules' trees: id, logic, path, node, is_leaf (null for what is no object).

    Level by level until none is left. Each level is checkpointed, so a deep tree is read once per level only;
    the driver learns whether there is one more.
    """
    ensure_checkpoint_dir(rules.sparkSession)
    has_tree = ~F.trim(F.coalesce("conditions", F.lit(""))).isin("", "{}", "null")
    level = rules.filter(has_tree).select(
        "id",
        F.lit(None).cast("string").alias("logic"),
        F.array().cast("array<int>").alias("path"),
        F.try_parse_json("conditions").alias("node"),
    )
    found: list[DataFrame] = []
    while not found or not level.isEmpty():
        keys = F.json_object_keys(F.to_json("node"))
        level = level.withColumn("is_leaf", F.array_contains(keys, "field")).checkpoint()
        found.append(level)
        nodes = level.filter(F.coalesce(~F.col("is_leaf"), F.lit(False)))
        level = nodes.select(
            "id",
            _node_operator().alias("logic"),
            "path",
            F.posexplode(F.try_variant_get("node", "$.rules", "array<variant>")).alias("place", "child"),
        ).select("id", "logic", F.array_append("path", F.col("place") + 1).alias("path"), F.col("child").alias("node"))
    return reduce(DataFrame.unionByName, found)


def _node_operator() -> Column:
    return F.coalesce(F.try_variant_get("node", "$.operator", "string"), F.lit("AND"))


def _position() -> Column:
    numbers = F.array_join(F.transform("path", lambda p: p.cast("string")), ".")
    return F.when(F.size("path") == 0, "1").otherwise(numbers).alias("position")


def condition_leaves(rules: DataFrame) -> DataFrame:
    """The leaves of every rule's tree, whatever its depth.

    ``position`` is the leaf's place (``2.1`` is the first leaf under the second
    child), ``logic`` the operator that joins it to its siblings.
    """
    return _leaves(_opened(rules))


def _leaves(opened: DataFrame) -> DataFrame:
    return opened.filter("is_leaf").select(
        "id",
        _position(),
        F.coalesce("logic", F.lit("AND")).alias("logic"),
        F.coalesce(F.try_variant_get("node", "$.field", "string"), F.lit("")).alias("field"),
        F.coalesce(F.try_variant_get("node", "$.operator", "string"), F.lit("")).alias("operator"),
        F.try_variant_get("node", "$.value", "array<string>").alias("values"),
        F.coalesce(F.try_variant_get("node", "$.value", "string"), F.lit("")).alias("value"),
        F.coalesce(F.try_variant_get("node", "$.case_sensitive", "boolean"), F.lit(False)).alias("case_sensitive"),
    )


def condition_texts(leaves: DataFrame) -> DataFrame:
    """Leaves in readable form: ``Field operator 'value' (case insensitive)``."""
    shown = F.when(F.col("values").isNotNull(), F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]")))
    text = F.concat(
        F.col("field"),
        F.lit(" "),
        F.col("operator"),
        F.lit(" '"),
        F.coalesce(shown, F.col("value")),
        F.lit("'"),
        F.when(F.col("case_sensitive"), "").otherwise(" (case insensitive)"),
    )
    return leaves.select("id", "position", "logic", text.alias("condition_text"))


def _compiles() -> Callable[[str], Column]:
    """Whether a text is a pattern of the dialect that rules are written in, which only Python tells."""

    @F.pandas_udf("boolean")
    def compiles(patterns: pd.Series) -> pd.Series:
        import re

        def valid(pattern: str) -> bool:
            try:
                re.compile(pattern)
            except (re.error, RecursionError, OverflowError):
                return False
            return True

        return patterns.map(valid)

    return compiles


def condition_problems(rules: DataFrame, fields: list[str] = RULE_FIELDS) -> DataFrame:
    """What in the rules' conditions can never match, and why: broken JSON, bad nodes, leaves, patterns and numbers."""
    opened = _opened(rules)
    leaves = _leaves(opened)
    regex = leaves.filter(F.col("operator") == "regex")
    leaves = leaves.withColumn("bad", F.lit(False)).filter(F.col("operator") != "regex").unionByName(
        regex.withColumn("bad", ~_compiles()("value"))
    )
    compares = F.col("operator").isin("greater_than", "less_than")
    bounds = F.col("operator") == "between"
    problem = (
        F.when(~F.col("field").isin(*fields), F.concat(F.lit("unknown field "), "field"))
        .when(~F.col("operator").isin(*ALL_OPERATORS), F.concat(F.lit("unknown operator "), "operator"))
        .when(F.col("bad"), F.concat(F.lit("bad pattern "), "value"))
        .when(bounds & (F.coalesce(F.size("values"), F.lit(0)) != 2), F.lit("between needs two bounds"))
        .when(bounds & F.exists("values", lambda v: parse_float(v).isNull()), F.lit("not a number"))
        .when(compares & parse_float(F.col("value")).isNull(), F.concat(F.lit("not a number "), "value"))
    )
    children = F.try_variant_get("node", "$.rules", "array<variant>")
    broken = (
        F.when(F.col("node").isNull(), F.lit("conditions are not JSON"))
        .when(F.col("is_leaf").isNull(), F.lit("not an object"))
        .when(~_node_operator().isin("AND", "OR"), F.concat(F.lit("unknown node operator "), _node_operator()))
        .when(F.coalesce(F.size(children), F.lit(0)) <= 0, F.lit("a node without rules"))
    )
    nodes = opened.filter(~F.coalesce("is_leaf", F.lit(False))).select("id", _position(), broken.alias("problem"))
    found = leaves.select("id", "position", problem.alias("problem")).unionByName(nodes)
    return found.filter(F.col("problem").isNotNull())


def orphan_rules(rules: DataFrame, tree: DataFrame) -> DataFrame:
    """Rules whose category and subcategory the tree does not have."""
    return rules.join(tree.select("category", "subcategory"), ["category", "subcategory"], "left_anti").select(
        *rules.columns
    )


def tree_overview(categories: DataFrame, tree: DataFrame) -> DataFrame:
    """Categories with their subcategories, also those that have none; defaults filled in."""
    plain = F.lit("No description")
    below = tree.select(
        "category",
        "subcategory",
        F.coalesce("description", plain).alias("subcategory_description"),
        F.when(is_active(), "Active").otherwise("Inactive").alias("subcategory_status"),
    )
    above = categories.select(
        "category",
        F.coalesce("description", plain).alias("description"),
        F.when(is_active(), "Active").otherwise("Inactive").alias("status"),
    )
    # A left join would keep a large category's subcategories in one task; an inner
    # join can be split or broadcast, and the bare categories are added to it.
    filled = below.join(above, "category")
    bare = above.join(tree.select("category").distinct(), "category", "left_anti")
    columns = ["category", "description", "status", "subcategory", "subcategory_description", "subcategory_status"]
    return filled.select(*columns).unionByName(bare, allowMissingColumns=True)


def tree_totals(categories: DataFrame, tree: DataFrame) -> DataFrame:
    subcategories = tree.agg(F.count("*").alias("n")).scalar()
    totals = categories.agg(
        F.count("*").alias("total_categories"), F.count_if(is_active()).alias("active_categories")
    )
    return totals.withColumn("total_subcategories", subcategories)


def tree_by_category(tree: DataFrame) -> DataFrame:
    """Subcategories per category: all, active, inactive and the active share."""
    counted = tree.groupBy("category").agg(
        F.count("*").alias("subcategories"),
        F.count_if(is_active()).alias("active_subcategories"),
        F.count_if(~is_active()).alias("inactive_subcategories"),
    )
    return counted.withColumn("active_pct", percent(F.col("active_subcategories"), F.col("subcategories")))


def known_names(changes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The insertions that are refused because the name is taken."""
    return changes.join(table.select(*keys), keys, "left_semi").select(*changes.columns)


def insert_new(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows with new names; those with a known name are refused. Of several rows of one key the greatest is added."""
    fresh = one_per_key(changes, keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True).select(*table.columns)


def update_rows(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Overwrite the columns of ``changes`` in the rows that exist. Of several rows of one key the greatest counts."""
    rest = [name for name in changes.columns if name not in keys]
    renamed = one_per_key(changes, keys).select(*keys, F.struct(*rest).alias("__new"))
    joined = table.join(renamed, keys, "left")
    return joined.select(*[
        F.when(F.col("__new").isNotNull(), F.col(f"__new.{name}")).otherwise(F.col(name)).alias(name)
        if name in rest
        else F.col(name)
        for name in table.columns
    ])


def accepted_renames(table: DataFrame, renames: DataFrame, name: str, within: list[str] = []) -> DataFrame:
    """The renames that are done; a new name that is empty, unchanged or taken is refused.

    ``renames`` has the columns of ``within``, ``name`` and ``new_name``, one row per
    old name; of two renames to one new name the alphabetically first is done.
    """
    wanted = renames.filter((F.coalesce("new_name", F.lit("")) != "") & (F.col("new_name") != F.col(name)))
    existing = wanted.join(table.select(*within, name), [*within, name], "left_semi")
    taken = table.select(*within, F.col(name).alias("new_name")).distinct()
    free = existing.join(taken, [*within, "new_name"], "left_anti")
    return free.groupBy(*within, "new_name").agg(F.min(name).alias(name))


def apply_renames(table: DataFrame, accepted: DataFrame, name: str, within: list[str] = []) -> DataFrame:
    joined = table.join(accepted, [*within, name], "left")
    return joined.withColumn(name, F.coalesce("new_name", name)).select(*table.columns)


def rename_rows(table: DataFrame, renames: DataFrame, name: str, within: list[str] = []) -> DataFrame:
    """Give rows new names where that is allowed (see ``accepted_renames``)."""
    return apply_renames(table, accepted_renames(table, renames, name, within), name, within)


def rename_categories(categories: DataFrame, tree: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename categories and take their subcategories along."""
    accepted = accepted_renames(categories, renames, "category")
    return apply_renames(categories, accepted, "category"), apply_renames(tree, accepted, "category")


def delete_categories(categories: DataFrame, tree: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete categories with their subcategories."""
    return delete_rows(categories, gone, ["category"]), delete_rows(tree, gone, ["category"])


def delete_rows(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Remove by key. A category's children go with it when keyed by category alone."""
    return merge_by_key(table, keys, deletes=gone)


def set_all_active(tree: DataFrame, category: str, active: bool) -> DataFrame:
    chosen = F.col("category") == category
    return tree.withColumn("active", F.when(chosen, F.lit(active)).otherwise(F.col("active")))


def drop_inactive(tree: DataFrame, category: str) -> DataFrame:
    """Delete the inactive subcategories of a category."""
    return tree.filter(~((F.col("category") == category) & ~is_active()))


def subcategories_of(tree: DataFrame, category: str) -> DataFrame:
    """What a label or rule of this category may use."""
    return tree.filter(F.col("category") == category).select("subcategory")


def upsert_rules(rules: DataFrame, changes: DataFrame, now: str, user: str = "user") -> DataFrame:
    """Insert rules, or update those whose id is known.

    An update keeps the creation stamps and document place and sets the modification stamps. An insertion is
    stamped as created now and goes behind the last rule; several go by their ``seq``, if they have one, and
    by id. Of two changes to one id the one with the larger ``seq`` counts, then the larger row.
    """
    kind = rules.schema["seq"].dataType
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(None).cast(kind))
    known = rules.select(
        "id",
        F.col("seq").alias("__seq"),
        F.col("created_at").alias("__created_at"),
        F.col("created_by").alias("__created_by"),
        F.lit(True).alias("__known"),
    )
    incoming = latest_per_key(changes, ["id"], "seq").drop("created_at", "created_by", "last_modified_at", "last_modified_by")
    incoming = incoming.join(known, "id", "left")
    fresh = numbered(incoming.filter(F.col("__known").isNull()), [F.col("seq").asc_nulls_last(), F.col("id").asc()], "__place")
    last = rules.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last")).scalar()

    def stamped(rows: DataFrame, stamps: dict[str, Column]) -> DataFrame:
        return rows.select(*[
            (stamps[name] if name in stamps else F.col(name) if name in changes.columns else F.lit(None))
            .cast(rules.schema[name].dataType).alias(name)
            for name in rules.columns
        ])

    updates = stamped(incoming.filter(F.col("__known")), {
        "seq": F.col("__seq"),
        "created_at": F.coalesce(F.col("__created_at"), F.lit(now)),
        "created_by": F.coalesce(F.col("__created_by"), F.lit(user)),
        "last_modified_at": F.lit(now),
        "last_modified_by": F.lit(user),
    })
    insertions = stamped(fresh, {
        "seq": last + F.col("__place"),
        "created_at": F.lit(now),
        "created_by": F.lit(user),
        "last_modified_at": F.lit(None),
        "last_modified_by": F.lit(None),
    })
    return merge_by_key(rules, ["id"], updates.unionByName(insertions), reduced=True)
