"""Condition trees in plain Python, from the operator descriptions. Slow and obvious."""

import datetime as dt
import re


def text(value):
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06d}" if value.microsecond else "")
    return str(value)


def number(value):
    return None if isinstance(value, dt.datetime) else _try(float, value)


def _try(function, value):
    try:
        return function(value)
    except (TypeError, ValueError):
        return None


def holds(row: dict, node: dict, known=("contains", "equals", "starts_with", "ends_with", "greater_than", "less_than", "regex", "between", "in")) -> bool:
    if "field" not in node:
        below = [holds(row, child, known) for child in node.get("rules") or []]
        mode = node.get("operator", "AND")
        return bool(below) and {"AND": all, "OR": any}.get(mode, lambda _: False)(below)
    field = row.get(node["field"])
    operator, value = node.get("operator", ""), node.get("value", "")
    if field is None or operator not in known:
        return False
    if operator in ("greater_than", "less_than", "between"):
        bounds = value if operator == "between" else [value]
        if not isinstance(bounds, list) or (operator == "between" and len(bounds) != 2):
            return False
        n, limits = number(field), [number(b) for b in bounds]
        if n is None or None in limits:
            return False
        return {"greater_than": n > limits[0], "less_than": n < limits[0], "between": limits[0] <= n <= limits[-1]}[operator]
    if operator == "regex":
        flags = 0 if node.get("case_sensitive", False) else re.IGNORECASE
        try:
            return re.search(str(value), text(field), flags) is not None
        except re.error:
            return False

    def fold(t):
        return t if node.get("case_sensitive", False) else t.lower()

    mine = fold(text(field))
    if operator == "in" and isinstance(value, list):
        return mine in {fold(str(v)) for v in value}
    theirs = fold(str(value))
    return {
        "contains": theirs in mine,
        "equals": mine == theirs,
        "in": mine == theirs,
        "starts_with": mine.startswith(theirs),
        "ends_with": mine.endswith(theirs),
    }[operator]


def first_match(row: dict, rules: list[dict]):
    """The id of the best active rule that holds, or None."""
    usable = [rule for rule in rules if rule.get("active", True) and rule.get("conditions")]
    for rule in sorted(usable, key=lambda rule: -rule.get("priority", 50)):
        if holds(row, rule["conditions"]):
            return rule["id"]
    return None
