"""A rule document on the driver: defaults, order and checks."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerspark.operators.conditions import (
    ALL_OPERATORS,
    NUMERIC_KINDS,
    ConditionError,
    Options,
    java_accepts,
    java_pattern,
    leaves,
    parse,
    _number,
)

DEFAULT_PRIORITY = 50


@dataclass(frozen=True)
class Rule:
    id: str = ""
    name: str = "Unknown Rule"
    description: str = "No description"
    category: str = ""
    subcategory: str = ""
    priority: int | None = None
    active: bool | None = None
    conditions: object = None
    created_at: str | None = None
    created_by: str | None = None
    last_modified_at: str | None = None
    last_modified_by: str | None = None

    @classmethod
    def from_mapping(cls, data: dict) -> Rule:
        """Absent and null entries take their defaults."""
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**known)

    @property
    def is_active(self) -> bool:
        return True if self.active is None else bool(self.active)

    @property
    def rank_priority(self) -> int:
        return DEFAULT_PRIORITY if self.priority is None else self.priority

    @property
    def has_conditions(self) -> bool:
        return self.conditions not in (None, "", "{}", {}, "null", [])

    @property
    def source(self) -> str:
        return f"Rule: {self.name}"


@dataclass(frozen=True)
class RuleSet:
    """Rules in document order. Documents are written by hand, so they fit the driver."""

    rules: tuple[Rule, ...] = field(default=())

    @classmethod
    def from_document(cls, document: dict | str) -> RuleSet:
        if isinstance(document, str):
            document = json.loads(document)
        listed = document.get("categorization_rules", {}).get("rules", [])
        return cls(tuple(Rule.from_mapping(rule) for rule in listed))

    @classmethod
    def from_table(cls, rules: DataFrame) -> RuleSet:
        """From a rules table with a ``seq`` column that holds document order."""
        rows = rules.collect()
        rows.sort(key=lambda row: row["seq"])
        return cls(tuple(Rule.from_mapping(row.asDict()) for row in rows))

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row per rule; conditions as JSON text."""
        rows = []
        for seq, rule in enumerate(self.rules):
            text = rule.conditions
            if text is not None and not isinstance(text, str):
                text = json.dumps(text, ensure_ascii=False)
            rows.append(
                (
                    seq, rule.id, rule.name, rule.description, rule.category, rule.subcategory, rule.priority,
                    rule.active, text, rule.created_at, rule.created_by, rule.last_modified_at, rule.last_modified_by,
                )
            )
        return spark.createDataFrame(rows, RULE_TABLE_SCHEMA)

    def in_order(self) -> list[tuple[Rule, dict]]:
        """Active rules that have a usable tree, best first: priority, then document order."""
        usable = []
        for rule in self.rules:
            if not rule.is_active or not rule.has_conditions:
                continue
            try:
                usable.append((rule, parse(rule.conditions)))
            except ConditionError:
                continue
        return sorted(usable, key=lambda pair: -pair[0].rank_priority)

    def with_rule(self, rule: Rule) -> RuleSet:
        """Insert, or replace the rule with the same id in its place."""
        if any(known.id == rule.id for known in self.rules):
            return RuleSet(tuple(rule if known.id == rule.id else known for known in self.rules))
        return RuleSet((*self.rules, rule))

    def without_rule(self, rule_id: str) -> RuleSet:
        return RuleSet(tuple(rule for rule in self.rules if rule.id != rule_id))

    def errors(self, df: DataFrame, options: Options = Options()) -> list[tuple[str, str]]:
        """(rule id, message) for everything that keeps a rule or leaf from matching ``df``."""
        found = []
        for rule in self.rules:
            if not rule.has_conditions:
                found.append((rule.id, "no conditions"))
                continue
            try:
                tree = parse(rule.conditions)
            except ConditionError as error:
                found.append((rule.id, str(error)))
                continue
            for leaf in leaves(tree):
                problem = leaf_problem(leaf, df, options)
                if problem:
                    found.append((rule.id, problem))
        return found


RULE_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("conditions", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("last_modified_at", T.StringType()),
        T.StructField("last_modified_by", T.StringType()),
    ]
)


def leaf_problem(leaf: dict, df: DataFrame, options: Options = Options()) -> str | None:
    """Why a leaf can never match, if so."""
    name, operator, value = leaf.get("field", ""), leaf.get("operator", ""), leaf.get("value", "")
    if name not in df.columns:
        return f"unknown field {name}"
    if operator not in ALL_OPERATORS:
        return f"unknown operator {operator}"
    if not options.allows(operator):
        return f"operator {operator} is not applied"
    if operator == "regex":
        pattern = java_pattern(str(value), ignore_case=True)
        if pattern is None or not java_accepts(df.sparkSession, pattern):
            return f"bad pattern {value}"
    if operator in NUMERIC_KINDS:
        bounds = value if operator == "between" else [value]
        if not isinstance(bounds, list) or (operator == "between" and len(bounds) != 2):
            return "between needs two bounds"
        if any(_number(bound) is None for bound in bounds):
            return f"not a number {value}"
    return None


def missing_parts(rule: Rule) -> list[str]:
    """What a rule lacks before it may be saved."""
    missing = [part for part in ("name", "category", "subcategory") if not getattr(rule, part)]
    if not rule.has_conditions:
        missing.append("conditions")
    if not 1 <= rule.rank_priority <= 100:
        missing.append("priority between 1 and 100")
    return missing


def new_rule(
    name: str,
    category: str,
    subcategory: str,
    conditions: dict,
    priority: int = DEFAULT_PRIORITY,
    active: bool = True,
    description: str = "",
    now: dt.datetime | None = None,
) -> Rule:
    """A checked rule with a content-derived id."""
    stamp = (now or dt.datetime.now()).isoformat()
    content = json.dumps([name, category, subcategory, conditions, stamp], sort_keys=True, default=str)
    rule = Rule(
        id=f"{name.lower().replace(' ', '_')}_{hashlib.md5(content.encode()).hexdigest()[:8]}",
        name=name,
        description=description,
        category=category,
        subcategory=subcategory,
        priority=priority,
        active=active,
        conditions=conditions,
        created_at=stamp,
        created_by="user",
    )
    missing = missing_parts(rule)
    if missing:
        raise ValueError(f"the rule lacks: {', '.join(missing)}")
    return rule


def edited(rule: Rule, now: dt.datetime | None = None, **changes) -> Rule:
    """A changed rule; creation stamps are kept, modification stamps set."""
    stamp = (now or dt.datetime.now()).isoformat()
    changed = replace(
        rule,
        **changes,
        created_at=rule.created_at or stamp,
        created_by=rule.created_by or "user",
        last_modified_at=stamp,
        last_modified_by="user",
    )
    missing = missing_parts(changed)
    if missing:
        raise ValueError(f"the rule lacks: {', '.join(missing)}")
    return changed
