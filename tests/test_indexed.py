"""Categorisation by a rules table, against the way that has all rules on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import indexed, matching
from ledgerspark.operators.rules import RuleSet

WORDS = ["tea", "Coffee", "CAFÉ", "rent", "gas", "ΣΑΣ", "straße", "İstanbul", "ſhop", "Kiosk", "12", "a", "", "tea pot", "no.1", "x" * 30]


def leaf(draw):
    field = draw.choice(["Description", "Description", "Counterparty_Name", "Amount", "Memo", "Date"])
    operator = draw.choice(["contains", "contains", "equals", "starts_with", "ends_with", "greater_than", "less_than", "between", "in", "regex", "like"])
    word = lambda: draw.choice(WORDS)[draw.choice([0, 0, 1]) :]
    value = word()
    if operator in ("greater_than", "less_than"):
        value = draw.choice(["5", "-3.5", "x"])
    elif operator == "between":
        value = [str(draw.randint(-9, 0)), str(draw.randint(0, 9))]
    elif operator == "in":
        value = [word() for _ in range(draw.randint(0, 3))]
    elif operator == "regex":
        value = draw.choice(["t.a", "(tea|gas)", "te+a pot", r"\bcaf", "[a", "shop$", "^k", "(?P<n>rent)", "i.tan", ".*", "σ", "a{1,2}s"])
    return {"field": field, "operator": operator, "value": value, "case_sensitive": draw.random() < 0.4}


def tree(draw, depth=2):
    if not depth or draw.random() < 0.4:
        return leaf(draw)
    return {"operator": draw.choice(["AND", "OR", "OR", "XOR"] if draw.random() < 0.1 else ["AND", "OR"]), "rules": [tree(draw, depth - 1) for _ in range(draw.randint(0, 3))]}


@pytest.mark.parametrize("seed", range(4))
def test_table_of_rules_against_the_driver_path(spark, seed):
    draw = random.Random(seed)
    rows = [(i, draw.choice([None, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 3)))]), draw.choice([None, *WORDS]), draw.choice([None, float("nan"), float(draw.randint(-9, 9))])) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, Description string, Counterparty_Name string, Amount double").withColumn("Date", F.lit("2024-01-01").cast("timestamp_ntz"))
    rules = [{"id": f"r{k}", "name": f"n{k}", "category": f"C{k}", "subcategory": f"S{k}", "priority": draw.choice([None, 10, 50, 90]), "active": draw.choice([None, True, True, False]),
              "conditions": draw.choice([tree(draw), tree(draw), tree(draw), {}, "not json"])} for k in range(40)]
    known = RuleSet.from_document({"categorization_rules": {"rules": rules}})
    wanted = matching.categorize(df, known, rule_id_column="rule").orderBy("i").collect()
    found = indexed.categorize_from_table(df, known.to_table(spark).repartition(3), rule_id_column="rule").orderBy("i").collect()
    assert [r.asDict()["rule"] for r in found] == [r.asDict()["rule"] for r in wanted]
    assert [(r.Category, r.Subcategory, r.Categorization_Source) for r in found] == [(r.Category, r.Subcategory, r.Categorization_Source) for r in wanted]
    assert any(r.Category for r in found)


def test_literal_factors():
    cases = {"abc": "abc", "a.bcd": "bcd", "(foo|bar)baz": "baz", "(foo)+x": "foo", "a?bc": "bc", "(?:ab)*c": "c", r"\bword\b": "word", "[ab]": "", ".*": "", "x{0,2}": "", "(": "", r"\d+ eur": " eur", "(?i)Ab": "Ab", "caféx": "caf"}
    assert {p: indexed.literal_factor(p) for p in cases} == cases


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "tea")], "i int, Description string")
    none = RuleSet().to_table(spark)
    assert indexed.categorize_from_table(df, none).collect()[0].Category == ""
    some = RuleSet.from_document({"categorization_rules": {"rules": [{"id": "a", "category": "C", "conditions": leaf(random.Random(1)) | {"field": "Description", "operator": "contains", "value": "te"}}]}})
    assert indexed.categorize_from_table(df.limit(0), some.to_table(spark)).collect() == []
    assert indexed.categorize_from_table(df, some.to_table(spark)).first().Category == "C"
