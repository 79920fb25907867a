"""A small rule set over the mapped views, with one rule for every special case."""

from __future__ import annotations

from ledgerspark.operators.rules import RuleSet


def leaf(field: str, operator: str, value, case_sensitive: bool = False) -> dict:
    return {"field": field, "operator": operator, "value": value, "case_sensitive": case_sensitive}


def both(*children: dict) -> dict:
    return {"operator": "AND", "rules": list(children)}


def either(*children: dict) -> dict:
    return {"operator": "OR", "rules": list(children)}


def _rule(id: str, category: str, subcategory: str, conditions: dict, **more) -> dict:
    return {"id": id, "name": id, "category": category, "subcategory": subcategory, "conditions": conditions, **more}


DEMO_RULES = RuleSet.from_document(
    {
        "categorization_rules": {
            "rules": [
                _rule(
                    "urgent_in", "Income", "Urgent",
                    both(leaf("Description", "contains", "1-urgent"), leaf("Amount", "greater_than", "100000")),
                    priority=80,
                ),
                _rule(
                    "machines", "Business", "Equipment",
                    either(leaf("Description", "ends_with", "MACHINERY"), leaf("Description", "ends_with", "furniture")),
                    priority=80,
                ),
                _rule("one_party", "Family", "Transfer", leaf("Counterparty_Name", "equals", "customer#000000007"), priority=90),
                _rule(
                    "big_out", "Housing", "Large",
                    both(
                        leaf("Amount", "less_than", "-200000"),
                        either(leaf("Description", "regex", "[12]-"), leaf("Account_Number", "starts_with", "NL0")),
                    ),
                    priority=70,
                ),
                _rule(
                    "listed", "Family", "Gifts",
                    leaf("Counterparty_Name", "in", ["Customer#000000011", "Customer#000000012"]), priority=60,
                ),
                _rule("mid", "Income", "Small", leaf("Amount", "between", ["1000", "5000"]), active=True),
                _rule("off", "Never", "Never", leaf("Amount", "greater_than", "0"), priority=100, active=False),
                _rule("ghost", "Never", "Never", leaf("Reference", "contains", "x"), priority=95),
                _rule("empty", "Never", "Never", {}, priority=99),
            ]
        }
    }
)

BRANDS, TYPES = 25, ("ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM", "SMALL")


def wide_rules(count: int = 300) -> RuleSet:
    """Many rules over the line-item view: text, amount and counterparty alternatives.

    Rule i has priority i mod 10 and, by i mod 3, is: brand and type in the text;
    one counterparty with a large amount; or two counterparties. Counterparty
    numbers run from 0 to 99.
    """
    rules = []
    for i in range(count):
        brand, kind = f"brand#{i % BRANDS + 1}", TYPES[i % len(TYPES)].lower()
        party = f"Supplier#{i % 100:09d}"
        if i % 3 == 0:
            tree = both(leaf("Description", "ends_with", f" {brand}"), leaf("Description", "contains", f" {kind} "))
        elif i % 3 == 1:
            tree = both(leaf("Counterparty_Name", "equals", party), leaf("Amount", "greater_than", str(50 * i)))
        else:
            tree = either(
                both(leaf("Counterparty_Name", "in", [party, f"Supplier#{(i + 37) % 100:09d}"]), leaf("Amount", "less_than", str(-100 * i))),
                both(leaf("Counterparty_Name", "equals", party), leaf("Amount", "between", [str(i), str(20 * i)])),
            )
        rules.append(_rule(f"rule_{i}", f"Category {i % 17}", f"Sub {i % 5}", tree, priority=i % 10))
    return RuleSet.from_document({"categorization_rules": {"rules": rules}})
