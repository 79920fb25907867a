"""Work that must not grow faster than the input: rules with equal conditions, documents of many rules, patterns, IDs."""

import json

from ledgerspark.operators import conditions as trees
from ledgerspark.operators import identity, indexed, matching
from ledgerspark.operators.rules import Rule, RuleSet
from ledgerspark.plans.demo import both, leaf
from ledgerspark.sources import documents


def test_rules_that_cannot_win_are_dropped_before_texts_are_looked_up(spark):
    conditions = [leaf("Description", "contains", "tea"), both(leaf("Description", "contains", "tea"), leaf("Amount", "greater_than", "3")), leaf("Description", "in", ["rent", "gas"]), leaf("Description", "equals", "gas")]
    rules = RuleSet(tuple(Rule(id=f"r{i}", name=f"r{i}", category=f"c{i}", priority=10 + i % 7, conditions=conditions[i % 4]) for i in range(200)))
    df = spark.createDataFrame([("a tea", 5.0), ("a tea", 1.0), ("rent", None), ("gas", 1.0), ("none", 9.0), (None, 9.0)], "Description string, Amount double")
    assert indexed.alternatives(rules.to_table(spark), df).count() == 4
    done = indexed.categorize_from_table(df, rules.to_table(spark), rule_id_column="rule")
    assert sorted(map(str, done.collect())) == sorted(map(str, matching.categorize(df, rules, rule_id_column="rule").collect()))


def test_a_large_rule_set_becomes_documents_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "RULES_PER_DOCUMENT", 7)
    rules = RuleSet(tuple(Rule(id=f"r{i}", name=f"r{i}", category="c", conditions=leaf("a", "equals", str(i))) for i in range(20))).to_table(spark)
    documents.write_rules(rules.orderBy("id"), str(tmp_path / "rules"))
    found = [json.loads(f.read_text()) for f in (tmp_path / "rules").glob("part-*.json")]
    assert sorted(len(d["categorization_rules"]["rules"]) for d in found) == [6, 7, 7] and sorted(d["first_rule"] for d in found) == [0, 7, 14]
    assert sorted(documents.read_rules(spark, str(tmp_path / "rules")).collect()) == sorted(rules.collect())


def test_texts_that_a_pattern_needs_are_looked_for_first(spark):
    cases = {"(?d)#0*17$": ["17", "#"], "(?diu)tea #1": [" #1"], "(?diu)(a1|b2)": [], "(?d)(?i)tea2": ["2"], "(?d)x+\\\\z": ["\\z", "x"], "(?d)a\\z": ["a"], "(?d)(?<g0>ab)\\k<g0>": [], "(?d)[12]-": ["-"], "(?d)(ab)*": []}
    assert {p: trees.certain_texts(p) for p in cases} == cases
    df = spark.createDataFrame([("#0017",), ("#17 ",), ("17",), ("Tea #1",), ("TEA 1",), (None,)], "t string")
    found = trees.with_match(df, both(leaf("t", "regex", "#0*17$"), leaf("t", "regex", "^#")))
    assert [r.matches for r in found.collect()] == [True, False, False, False, False, False]
    assert [r.matches for r in trees.with_match(df, leaf("t", "regex", "tea #1")).collect()] == [False, False, False, True, False, False]
    assert ", 17)" in found._jdf.queryExecution().optimizedPlan().toString().split("RLIKE")[0]


def test_ids_are_made_without_upper_case_rules_of_a_language(spark):
    df = identity.with_transaction_id(spark.createDataFrame([("a",), ("b",), (None,)], "Description string"), "key")
    assert "upper(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(r.Transaction_ID == "TXN_" + r.key[:8].upper() for r in df.collect())
