import datetime as dt
import random

import pytest
from evaluator import first_match, holds
from pyspark.sql import functions as F

from ledgerspark.operators import conditions, filters, matching
from ledgerspark.operators.conditions import Options
from ledgerspark.operators.rules import RuleSet, edited, new_rule
from ledgerspark.plans.demo import both, either, leaf

SCHEMA = "id int, Date timestamp_ntz, Amount double, Description string, Counterparty_Name string, Balance_After string, Sequence_Number bigint"
ROWS = [
    (0, dt.datetime(2025, 10, 5), 100.0, "Pay at SHOP one", "Shop One", "12.5", 7),
    (1, dt.datetime(2025, 10, 6, 8, 30), -50.25, "shop two it's [x]", "Shop\\Two", " 1_000 ", 8),
    (2, None, None, "", None, "n/a", None),
    (3, dt.datetime(2024, 1, 1, 0, 0, 0, 250), 1e17, "line one\nline two", "Ünïcode É", "1d", 9),
    (4, dt.datetime(2024, 2, 29), 0.00005, "ends with shop", "shop one", "inf", 10),
    (5, dt.datetime(2024, 3, 1), float("nan"), "10.5", "10.5", "-3", 11),
]

LEAVES = [
    leaf("Description", "contains", "shop"),
    leaf("Description", "contains", "SHOP", True),
    leaf("Description", "contains", ""),
    leaf("Description", "contains", "it's ["),
    leaf("Counterparty_Name", "contains", "\\t"),
    leaf("Counterparty_Name", "equals", "SHOP ONE"),
    leaf("Counterparty_Name", "equals", "Shop One", True),
    leaf("Amount", "equals", "100.0"),
    leaf("Amount", "equals", 100.0),
    leaf("Amount", "equals", "1e+17"),
    leaf("Amount", "equals", "5e-05"),
    leaf("Date", "equals", "2025-10-05 00:00:00"),
    leaf("Date", "ends_with", ".000250"),
    leaf("Date", "contains", ""),
    leaf("Sequence_Number", "equals", "7"),
    leaf("Description", "starts_with", "pay"),
    leaf("Description", "ends_with", "Shop"),
    leaf("Counterparty_Name", "ends_with", "é"),
    leaf("Amount", "greater_than", "-60"),
    leaf("Amount", "greater_than", "abc"),
    leaf("Amount", "less_than", 0),
    leaf("Balance_After", "greater_than", "1"),
    leaf("Balance_After", "less_than", "1e3"),
    leaf("Description", "greater_than", "10"),
    leaf("Date", "greater_than", "0"),
    leaf("Amount", "between", ["-50.25", "100"]),
    leaf("Amount", "between", ["1"]),
    leaf("Amount", "between", "1,2"),
    leaf("Amount", "between", ["a", "b"]),
    leaf("Counterparty_Name", "in", ["shop one", "x"]),
    leaf("Counterparty_Name", "in", ["shop one", "x"], True),
    leaf("Counterparty_Name", "in", []),
    leaf("Counterparty_Name", "in", "Shop One"),
    leaf("Amount", "in", [100.0, "x"]),
    leaf("Description", "regex", r"\bS\w+p\b"),
    leaf("Description", "regex", r"^line (?P<n>one)$"),
    leaf("Description", "regex", r"line.*two\Z", True),
    leaf("Description", "regex", "(bad"),
    leaf("Counterparty_Name", "regex", "ÜNÏ"),
    leaf("Memo", "contains", ""),
    leaf("Description", "like", "x"),
    {"field": "Description"},
    {"field": "Description", "operator": "contains"},
]
NODES = [
    both(LEAVES[0], LEAVES[18]),
    both(LEAVES[0], LEAVES[39]),
    either(LEAVES[39], LEAVES[5]),
    {"rules": [LEAVES[0], LEAVES[20]]},
    {"operator": "AND", "rules": []},
    {"operator": "NOT", "rules": [LEAVES[0]]},
    both(either(LEAVES[5], both(LEAVES[0], LEAVES[20])), either(LEAVES[15], LEAVES[3])),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in row) for row in ROWS]
    return spark.createDataFrame(rows, SCHEMA).cache()


def as_dicts():
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return [
        {name: (None if isinstance(v, float) and v != v else v) for name, v in zip(names, row)} for row in ROWS
    ]


def test_every_leaf_and_node_agrees_with_plain_python(table):
    trees = LEAVES + NODES
    df = table
    for i, tree in enumerate(trees):
        df = conditions.with_match(df, tree, f"m{i}")
    for row in df.collect():
        source = next(r for r in as_dicts() if r["id"] == row["id"])
        for i, tree in enumerate(trees):
            assert row[f"m{i}"] is holds(source, tree), (tree, source)


def test_not_a_number_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),)], "Amount double")
    for operator, value in (("greater_than", 0), ("contains", ""), ("less_than", 1e9)):
        assert not conditions.with_match(df, leaf("Amount", operator, value)).first()["matches"]


def test_apply_operators_leave_out_in_and_between(table):
    options = Options(operators="apply")
    assert conditions.matching_rows(table, leaf("Amount", "between", [0, 1e20]), options).count() == 0
    assert conditions.matching_rows(table, leaf("Counterparty_Name", "in", ["shop one"]), options).count() == 0
    assert conditions.matching_rows(table, leaf("Description", "contains", "shop"), options).count() == 3


def test_regex_compat_lowers_the_pattern(table):
    tree = leaf("Description", "regex", r"^\S+$")
    assert [r.id for r in conditions.matching_rows(table, tree).collect()] == [5]
    assert conditions.matching_rows(table, tree, Options(regex_compat=True)).count() == 0


def random_tree(rng, depth=0):
    if depth == 3 or rng.random() < 0.4:
        return rng.choice(LEAVES)
    return {"operator": rng.choice(["AND", "OR"]), "rules": [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 3))]}


@pytest.mark.parametrize("seed", range(4))
def test_both_paths_agree_with_plain_python(table, seed):
    rng = random.Random(seed)
    rules = [
        {
            "id": f"r{i}", "name": f"Rule {i}", "category": f"c{i}", "subcategory": f"s{i}",
            "conditions": random_tree(rng) if rng.random() > 0.05 else {},
            **({"priority": rng.choice([10, 50, 90])} if rng.random() > 0.2 else {}),
            **({"active": rng.random() > 0.1} if rng.random() > 0.5 else {}),
        }
        for i in range(25)
    ]
    rule_set = RuleSet.from_document({"categorization_rules": {"rules": rules}})
    expected = {row["id"]: first_match(row, rules) for row in as_dicts()}
    for path in ("compiled", "lookup"):
        found = matching.categorize(table, rule_set, path, rule_id_column="rule").collect()
        assert len(found) == len(ROWS)
        assert {row["id"]: row["rule"] for row in found} == expected, path
        for row in found:
            number = expected[row["id"]]
            assert row["Category"] == (number.replace("r", "c") if number else "")
            assert row["Categorization_Source"] == (number.replace("r", "Rule: Rule ") if number else "")


def test_wide_trees_fall_back_to_the_compiled_form(table):
    pairs = [either(leaf("Description", "contains", f"no{i}"), leaf("Description", "contains", "shop")) for i in range(12)]
    rules = RuleSet.from_document(
        {"categorization_rules": {"rules": [{"id": "w", "name": "w", "category": "C", "conditions": both(*pairs)}]}}
    )
    tree = conditions.resolve_tree(rules.in_order()[0][1], table)
    assert conditions.conjuncts(tree, matching.MAX_ALTERNATIVES) is None
    assert matching.categorize(table, rules, "lookup").filter("Category = 'C'").count() == 3


def test_matching_adds_no_shuffle(table):
    rules = RuleSet.from_document(
        {"categorization_rules": {"rules": [
            {"id": "a", "conditions": leaf("Counterparty_Name", "equals", "shop one")},
            {"id": "b", "conditions": both(leaf("Description", "contains", "x"), leaf("Amount", "less_than", 0))},
        ]}}
    )
    for path in ("compiled", "lookup"):
        plan = matching.categorize(table, rules, path)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "NestedLoop" not in plan


def test_filters_do_not_evaluate_many_rules_again(table):
    words = [leaf("Description", "contains", f"marker{i:02d}") for i in range(40)]
    rules = RuleSet.from_document({"categorization_rules": {"rules": [{"id": "a", "category": "C", "conditions": either(*words)}]}})
    for path in ("compiled", "lookup"):
        kept = matching.categorize(table, rules, path).filter("Category <> '' AND Amount > 0")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("marker07") == 1


def test_broken_rules_are_skipped_and_reported(table):
    rules = RuleSet.from_document(
        {"categorization_rules": {"rules": [
            {"id": "list", "category": "bad", "priority": 99, "conditions": [1]},
            {"id": "text", "category": "bad", "priority": 99, "conditions": "no json"},
            {"id": "child", "category": "bad", "priority": 99, "conditions": {"operator": "OR", "rules": [None]}},
            {"id": "none", "priority": 98},
            {"id": "pattern", "priority": 97, "conditions": leaf("Description", "regex", "(")},
            {"id": "field", "priority": 97, "conditions": leaf("Memo", "equals", "x")},
            {"id": "good", "category": "ok", "conditions": leaf("Description", "contains", "shop")},
        ]}}
    )
    assert matching.categorize(table, rules).filter("Category = 'ok'").count() == 3
    assert matching.categorize(table, rules).filter("Category = 'bad'").count() == 0
    problems = dict(rules.errors(table))
    assert set(problems) == {"list", "text", "child", "none", "pattern", "field"}
    assert problems["field"] == "unknown field Memo"


def test_no_rules_and_existing_category_columns(table):
    old = table.withColumn("Category", F.lit("old"))
    assert {r.Category for r in matching.categorize(old, RuleSet()).collect()} == {""}


def test_leaf_and_tree_building():
    one = conditions.build_leaf("Description", "in", " a \n\n b\n")
    assert one["value"] == ["a", "b"]
    with pytest.raises(ValueError):
        conditions.build_leaf("Description", "in", " \n ")
    with pytest.raises(ValueError):
        conditions.build_leaf("Description", "contains", "")
    assert conditions.build_tree([one]) == one
    assert conditions.build_tree([one, one]) == {"operator": "AND", "rules": [one, one]}


def test_rule_changes():
    moment = dt.datetime(2025, 1, 2, 3, 4, 5)
    rule = new_rule("My Shop", "Food", "Groceries", leaf("Description", "contains", "shop"), now=moment)
    assert rule.id.startswith("my_shop_") and len(rule.id) == len("my_shop_") + 8
    changed = edited(rule, now=dt.datetime(2025, 2, 1), priority=90)
    assert changed.created_at == "2025-01-02T03:04:05" and changed.last_modified_at == "2025-02-01T00:00:00"
    with pytest.raises(ValueError):
        edited(rule, priority=0)
    with pytest.raises(ValueError):
        new_rule("x", "", "y", leaf("Description", "contains", "shop"))
    rules = RuleSet().with_rule(rule).with_rule(changed)
    assert rules.rules == (changed,) and rules.without_rule(rule.id).rules == ()


def test_preview(table):
    tree = leaf("Description", "contains", "shop")
    assert filters.preview(table, tree, 2).columns == ["Date", "Amount", "Description", "Counterparty_Name"]
    assert filters.preview(table, tree, 2).count() == 2
    assert filters.preview_total(table, tree).first()[0] == 3
