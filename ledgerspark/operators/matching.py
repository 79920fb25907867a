"""First-match categorisation of transactions by a rule set.

Neither way of matching shuffles. The *compiled* way turns every rule into a
column and takes the first that holds. The *lookup* way, for large rule sets,
keeps the expressions small: equality leaves are found by one broadcast hash
join per field, the other leaves by a scan over a literal array, and the best
complete rule is worked out in the row. Rules whose trees do not flatten into a
moderate number of alternatives are compiled in either way.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import percent
from ledgerspark.operators.conditions import (
    NUMERIC_KINDS,
    Leaf,
    Operands,
    Options,
    conjuncts,
    resolve_tree,
    tree_leaves,
    tree_sql,
)
from ledgerspark.operators.rules import RuleSet

# Up to so many leaves the compiled form is the faster one, measured with and without
# Spark's code generation keeping its methods below what Java compiles (README).
COMPILED_LEAVES = 60
COMPILED_LEAVES_SPLIT = 200
_JIT_LIMIT = 8000
# Below this, evaluating the rules again in a filter costs less than preventing it.
GUARDED_LEAVES = 30
# Wider expansions are compiled instead.
MAX_ALTERNATIVES = 256
# Leaves of one CASE at most; more are spread over several projections.
CHUNK_LEAVES = 200
# A pattern, with the texts that are looked for before it, counts as so many, or Java wouldn't compile the method.
PATTERN_LEAVES = 10
# The values of one field's equality leaves, with what they lead to, are broadcast up to this size.
BROADCAST_BYTES = 64 << 20

CATEGORY_COLUMNS = ("Category", "Subcategory", "Categorization_Source")


def categorize(
    df: DataFrame,
    rules: RuleSet,
    path: str = "auto",
    options: Options = Options(),
    rule_id_column: str | None = None,
) -> DataFrame:
    """Add Category, Subcategory and Categorization_Source from the best matching rule.

    Active rules are tried by priority, ties in document order; rows without a
    match get empty texts. ``path`` is ``compiled``, ``lookup`` or ``auto``.
    """
    ordered = [(rule, resolve_tree(tree, df, options)) for rule, tree in rules.in_order()]
    ordered = [(rule, tree) for rule, tree in ordered if tree is not None]
    trees = [tree for _, tree in ordered]
    used = [leaf for tree in trees for leaf in tree_leaves(tree)]
    if path == "auto":
        path = "compiled" if len(used) <= _compiled_limit(df) else "lookup"
    kept = [name for name in df.columns if name not in CATEGORY_COLUMNS]
    operands = Operands(df.select(*kept), used)
    ranked = _rank_compiled(operands, trees) if path == "compiled" else _rank_by_lookup(operands, trees)

    answers = json.dumps(
        [{"c": rule.category, "s": rule.subcategory, "o": rule.source, "i": rule.id} for rule, _ in ordered]
    )
    table = F.from_json(F.lit(answers), "array<struct<c:string,s:string,o:string,i:string>>")
    if len(used) > GUARDED_LEAVES:
        # A filter on the result must not drag the whole rule expression down with it, to be
        # evaluated twice. Predicates do not pass a generator, so the rank goes through one.
        ranked = ranked.select(*kept, F.explode_outer(F.array("__rank")).alias("__rank"))
    ranked = ranked.withColumn("__answer", F.get(table, F.col("__rank")))
    columns = [
        *[F.col(name) for name in kept],
        F.coalesce(F.col("__answer.c"), F.lit("")).alias("Category"),
        F.coalesce(F.col("__answer.s"), F.lit("")).alias("Subcategory"),
        F.coalesce(F.col("__answer.o"), F.lit("")).alias("Categorization_Source"),
    ]
    if rule_id_column:
        columns.append(F.col("__answer.i").alias(rule_id_column))
    return ranked.select(*columns)


def _compiled_limit(df: DataFrame) -> int:
    method_limit = int(df.sparkSession.conf.get("spark.sql.codegen.hugeMethodLimit", "65535"))
    return COMPILED_LEAVES_SPLIT if method_limit <= _JIT_LIMIT else COMPILED_LEAVES


def _first_of(trees: list[tuple[int, object]], operands: Operands) -> Column:
    """Rank of the first tree that holds; null when none does."""
    if not trees:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {tree_sql(tree, operands)} THEN {rank}" for rank, tree in trees) + " END")


def _rank_compiled(operands: Operands, trees: list) -> DataFrame:
    return _with_first(operands.df, list(enumerate(trees)), operands, "__rank")


def _with_first(df: DataFrame, trees: list[tuple[int, object]], operands: Operands, name: str) -> DataFrame:
    """Add the rank of the first tree that holds, in projections of bounded size.

    One CASE over all trees outgrows what Java compiles. Between the projections the rank passes a generator,
    or Spark would merge them again; only rows without a rank try the next one.
    """
    chunks: list[list] = [[]]
    size = 0
    for rank, tree in trees:
        more = sum(PATTERN_LEAVES if leaf.kind == "regex" else 1 for leaf in tree_leaves(tree))
        if chunks[-1] and size + more > CHUNK_LEAVES:
            chunks.append([])
            size = 0
        chunks[-1].append((rank, tree))
        size += more
    kept = [F.col(f"`{column}`") for column in df.columns]
    df = df.withColumn(name, _first_of(chunks[0], operands))
    for chunk in chunks[1:]:
        df = df.select(*kept, F.explode_outer(F.array(name)).alias(name))
        df = df.withColumn(name, F.coalesce(F.col(name), _first_of(chunk, operands)))
    return df


# Every alternative of a rule hangs on one leaf, its anchor. Rarely met kinds come first.
_ANCHOR_ORDER = ("set", "contains", "starts_with", "ends_with", "between", "greater_than", "less_than")
# What an anchor leads to: the rank won, and the other leaves that must hold as well.
_LEADS = "array<struct<rank:int,rest:array<struct<kind:int,operand:int,text:string,low:double,high:double,list:array<string>>>>>"


def _anchor(alternative: frozenset[Leaf]) -> Leaf:
    return min(
        alternative,
        key=lambda leaf: (
            _ANCHOR_ORDER.index(leaf.kind),
            -len(leaf.value) if isinstance(leaf.value, str) else 0,
            repr(leaf),
        ),
    )


def _rank_by_lookup(operands: Operands, trees: list) -> DataFrame:
    compiled: list[tuple[int, object]] = []
    leads: dict[Leaf, list[dict]] = defaultdict(list)
    texts: dict[str, int] = {}
    numbers: dict[str, int] = {}

    def packed(leaf: Leaf) -> dict:
        name = operands.name(leaf)
        places = numbers if leaf.kind in NUMERIC_KINDS else texts
        entry = {"kind": _ANCHOR_ORDER.index(leaf.kind), "operand": places.setdefault(name, len(places))}
        if leaf.kind == "set":
            entry["list"] = list(leaf.value)
        elif leaf.kind == "between":
            entry["low"], entry["high"] = map(_json_number, leaf.value)
        elif leaf.kind in NUMERIC_KINDS:
            entry["low"] = _json_number(leaf.value)
        else:
            entry["text"] = leaf.value
        return entry

    for rank, tree in enumerate(trees):
        flat = None if any(leaf.kind == "regex" for leaf in tree_leaves(tree)) else conjuncts(tree, MAX_ALTERNATIVES)
        if flat is None:
            compiled.append((rank, tree))
            continue
        for alternative in flat:
            anchor = _anchor(alternative)
            leads[anchor].append({"rank": rank, "rest": [packed(leaf) for leaf in alternative if leaf != anchor]})

    df = operands.df
    found: list[Column] = []
    equalities: dict[str, dict[str, list[dict]]] = defaultdict(lambda: defaultdict(list))
    scans: dict[tuple[str, str], dict[object, list[dict]]] = defaultdict(dict)
    for leaf, reached in leads.items():
        if leaf.kind == "set":
            for member in leaf.value:
                equalities[operands.name(leaf)][member].extend(reached)
        else:
            scans[operands.name(leaf), leaf.kind][leaf.value] = reached

    for index, (name, members) in enumerate(equalities.items()):
        # At most one row per equality value of the rule set, so the join keeps the row count.
        key, reached = f"__key_{index}", f"__reached_{index}"
        entries = [(member, json.dumps(_best_first(lead))) for member, lead in members.items()]
        lookup = df.sparkSession.createDataFrame(entries, f"{key} string, leads string").select(
            key, F.from_json("leads", _LEADS).alias(reached)
        )
        if sum(len(member) + len(lead) for member, lead in entries) <= BROADCAST_BYTES:
            lookup = F.broadcast(lookup)
        df = df.join(lookup, F.col(name) == F.col(key), "left").drop(key)
        found.append(F.coalesce(F.col(reached), F.expr(f"cast(array() AS {_LEADS})")))

    for (name, kind), values in scans.items():
        table = [{**_bounds(kind, value), "leads": _best_first(reached)} for value, reached in values.items()]
        literal = F.from_json(
            F.lit(json.dumps(table)), f"array<struct<text:string,low:double,high:double,leads:{_LEADS}>>"
        )
        met = F.filter(literal, _test(kind, F.col(name)))
        found.append(F.coalesce(F.flatten(F.transform(met, lambda entry: entry["leads"])), F.expr(f"cast(array() AS {_LEADS})")))

    best = F.lit(None).cast("int")
    if compiled:
        df = _with_first(df, compiled, operands, "__first")
        best = F.col("__first")
    if found:
        df = df.withColumn("__leads", F.concat(*found))
        df = df.withColumn("__texts", F.array(*[F.col(name) for name in texts]).cast("array<string>"))
        df = df.withColumn("__numbers", F.array(*[F.col(name) for name in numbers]).cast("array<double>"))
        complete = F.filter("__leads", lambda lead: F.forall(lead["rest"], _holds))
        best = F.least(F.array_min(F.transform(complete, lambda lead: lead["rank"])), best, F.lit(None).cast("int"))
    return df.withColumn("__rank", best)


def _json_number(number: float):
    return number if math.isfinite(number) else ("Infinity" if number > 0 else "-Infinity")


def _bounds(kind: str, value) -> dict:
    if kind == "between":
        return {"low": _json_number(value[0]), "high": _json_number(value[1])}
    return {"low": _json_number(value)} if kind in NUMERIC_KINDS else {"text": value}


def _best_first(leads: list[dict]) -> list[dict]:
    """By rank; behind an unconditional win nothing can do better."""
    ordered = sorted(leads, key=lambda lead: lead["rank"])
    for place, lead in enumerate(ordered):
        if not lead["rest"]:
            return ordered[: place + 1]
    return ordered


def _test(kind: str, operand: Column):
    """The comparison of one column with an entry of a literal array."""
    return {
        "contains": lambda entry: F.contains(operand, entry["text"]),
        "starts_with": lambda entry: F.startswith(operand, entry["text"]),
        "ends_with": lambda entry: F.endswith(operand, entry["text"]),
        "greater_than": lambda entry: operand > entry["low"],
        "less_than": lambda entry: operand < entry["low"],
        "between": lambda entry: operand.between(entry["low"], entry["high"]),
    }[kind]


def _holds(leaf: Column) -> Column:
    """A further leaf of an alternative, tested against the row's operand arrays."""
    text = F.get(F.col("__texts"), leaf["operand"])
    number = F.get(F.col("__numbers"), leaf["operand"])
    kind = {name: F.lit(index) for index, name in enumerate(_ANCHOR_ORDER)}
    tested = F.when(leaf["kind"] == kind["set"], F.array_contains(leaf["list"], text))
    for name in _ANCHOR_ORDER[1:]:
        operand = number if name in NUMERIC_KINDS else text
        tested = tested.when(leaf["kind"] == kind[name], _test(name, operand)(leaf))
    return F.coalesce(tested, F.lit(False))


def rule_hits(categorized: DataFrame, rule_id_column: str) -> DataFrame:
    """Transactions won per rule; partial counts before the shuffle."""
    return (
        categorized.filter(F.col(rule_id_column).isNotNull())
        .groupBy(F.col(rule_id_column).alias("rule_id"))
        .agg(F.count("*").alias("hits"))
    )


def rule_performance(categorized: DataFrame, rules: DataFrame, rule_id_column: str) -> DataFrame:
    """Per rule that won anything: name, transactions matched and share of all rows, best first."""
    counted = categorized.groupBy(F.col(rule_id_column).alias("rule_id")).agg(F.count("*").alias("hits"))
    total = counted.agg(F.sum("hits").alias("total")).scalar()
    names = rules.groupBy(F.col("id").alias("rule_id")).agg(
        F.max_by(F.coalesce("name", F.lit("Unknown Rule")), "seq").alias("rule_name")
    )
    return (
        counted.filter(F.col("rule_id").isNotNull())
        .join(names, "rule_id", "left")
        .select(
            "rule_id",
            F.coalesce("rule_name", F.concat(F.lit("Rule ID: "), "rule_id")).alias("rule_name"),
            F.col("hits").alias("transactions_matched"),
            percent(F.col("hits"), total).alias("percentage"),
        )
        .orderBy(F.desc("transactions_matched"), "rule_id")
    )
