"""Categorisation by a rules table of any size: rules stay in Spark, and an index of needles finds what texts they meet.

Every rule's tree becomes alternatives, sets of leaves that must all hold. Each alternative hangs on one leaf, its anchor: an
equality is found by a join on the text; a text to be contained (or the literal part that every match of a
pattern holds) by a join on its rarest run of three characters. Only different texts are looked at, and only rows
of texts with an anchor test the other leaves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.conditions import NUMERIC_KINDS, Leaf, Operands, Options, Shape, conjuncts, literal_runs, parse, resolve_tree
from ledgerspark.operators.rules import DEFAULT_PRIORITY, Rule
from ledgerspark.session import ship_package

#: A tree that becomes more alternatives is refused.
MOST_ALTERNATIVES = 10_000
#: Characters of a run that the index holds.
RUN = 3
#: Runs of all needles are broadcast up to this size, so that other runs of texts are dropped where they are made.
BROADCAST_BYTES = 32 << 20

_KINDS = ("set", "contains", "starts_with", "ends_with", "regex", "between", "greater_than", "less_than")
_LEAF = "struct<kind:string,field:string,folded:boolean,text:string,low:double,high:double,list:array<string>>"
_RANK = "struct<order:bigint,seq:bigint>"
_LEADS = f"array<struct<rank:{_RANK},rest:array<{_LEAF}>>>"


def literal_factor(pattern: str) -> str:
    """The longest run of ASCII characters that every match of a pattern (in the rules' dialect) contains; empty if none is certain."""
    return max(literal_runs(pattern), key=len, default="")


def _packed(leaf: Leaf) -> dict:
    entry = {"kind": leaf.kind, "field": leaf.field, "folded": leaf.folded}
    number = lambda x: x if abs(x) != float("inf") else ("Infinity" if x > 0 else "-Infinity")
    if leaf.kind == "set":
        entry["list"] = list(leaf.value)
    elif leaf.kind == "between":
        entry["low"], entry["high"] = map(number, leaf.value)
    elif leaf.kind in NUMERIC_KINDS:
        entry["low"] = number(leaf.value)
    else:
        entry["text"] = leaf.value
    return entry


def _needle(leaf: Leaf) -> str:
    """The text that the index looks for."""
    if leaf.kind != "regex":
        return leaf.value if isinstance(leaf.value, str) else ""
    # Back from Java's dialect, without the flags that were put in front.
    pattern = re.sub(r"^\(\?[a-zA-Z]+\)", "", leaf.value).replace("\\z", "\\Z")
    return literal_factor(re.sub(r"\\k<(\w+)>", r"(?P=\1)", re.sub(r"\(\?<(?=\w+>)", "(?P<", pattern)))


def _anchor(alternative: frozenset[Leaf]) -> Leaf:
    """The leaf that is likely met least: an equality, then the longest text, then a pattern; a number only if there is nothing else."""

    def order(leaf: Leaf):
        if leaf.kind == "set":
            return (0, 0, repr(leaf))
        if leaf.kind in NUMERIC_KINDS:
            return (2, 0, repr(leaf))
        return (1, -len(_needle(leaf)), repr(leaf))

    return min(alternative, key=order)


def alternatives(rules: DataFrame, df: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per alternative of an active rule with a usable tree: rank, anchor, needle and rest (the other leaves).

    ``rank`` orders by priority, then by place in the document (``seq``). Trees are taken apart in tasks, rule by rule; nothing comes
    to the driver. Of rules with the same conditions only the first can win, and of equal alternatives too, so one of each is kept.
    Alternatives with a pattern that Java refuses can't hold and are dropped.
    """
    ship_package(df.sparkSession)
    shape, default = Shape(df.schema), DEFAULT_PRIORITY

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for order, seq, conditions in zip(batch["order"], batch["seq"], batch["conditions"]):
                try:
                    tree = resolve_tree(parse(conditions), shape, options)
                except ValueError:
                    continue
                if tree is None:
                    continue
                flat = conjuncts(tree, MOST_ALTERNATIVES)
                if flat is None:
                    raise ValueError(f"rule {seq} becomes more than {MOST_ALTERNATIVES} alternatives")
                for one in flat:
                    anchor = _anchor(one)
                    rest = sorted((leaf for leaf in one if leaf != anchor), key=lambda leaf: _KINDS.index(leaf.kind), reverse=True)
                    rows.append((int(order), int(seq), json.dumps(_packed(anchor)), _needle(anchor), json.dumps([_packed(leaf) for leaf in rest])))
            yield pd.DataFrame(rows, columns=["order", "seq", "anchor", "needle", "rest"])

    active = rules.filter(F.coalesce("active", F.lit(True)) & F.col("conditions").isNotNull() & ~F.col("conditions").isin("", "{}", "null", "[]"))
    order = -F.coalesce(F.col("priority").cast("long"), F.lit(default).cast("long"))
    first = active.groupBy("conditions").agg(F.min(F.struct(order.alias("order"), F.col("seq").cast("long").alias("seq"))).alias("rank"))
    found = first.select("rank.order", "rank.seq", "conditions").mapInPandas(expand, "order long, seq long, anchor string, needle string, rest string")
    found = found.select(
        F.struct("order", "seq").alias("rank"), F.from_json("anchor", _LEAF).alias("anchor"), "needle", F.from_json("rest", f"array<{_LEAF}>").alias("rest")
    )
    usable = found.filter("forall(concat(array(anchor), rest), x -> x.kind <> 'regex' OR try_reflect('java.util.regex.Pattern', 'compile', x.text) IS NOT NULL)")
    return _undominated(usable, "anchor", "needle")


def _undominated(leads: DataFrame, *keys: str) -> DataFrame:
    """Of rows with rank and rest those that can win where their keys are met: the first without further leaves, and of others that come before it one for each rest."""
    free = F.size("rest") == 0
    sure = leads.filter(free).groupBy(*keys).agg(F.min("rank").alias("rank"))
    tested = leads.filter(~free).groupBy(*keys, "rest").agg(F.min("rank").alias("rank"))
    before = sure.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("rank").alias("__sure"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    tested = tested.join(before, same, "left").filter(F.col("__sure").isNull() | (F.col("rank") < F.col("__sure"))).select(*keys, "rank", "rest")
    return sure.select(*keys, "rank", F.array().cast(f"array<{_LEAF}>").alias("rest")).unionByName(tested)


def _test(leaf: Column, text: Column, number: Column) -> Column:
    """Whether a leaf holds for an operand; null counts as not."""
    return F.coalesce(
        F.when(leaf["kind"] == "set", F.array_contains(leaf["list"], text))
        .when(leaf["kind"] == "contains", F.contains(text, leaf["text"]))
        .when(leaf["kind"] == "starts_with", F.startswith(text, leaf["text"]))
        .when(leaf["kind"] == "ends_with", F.endswith(text, leaf["text"]))
        .when(leaf["kind"] == "regex", F.rlike(text, leaf["text"]))
        .when(leaf["kind"] == "between", number.between(leaf["low"], leaf["high"]))
        .when(leaf["kind"] == "greater_than", number > leaf["low"])
        .when(leaf["kind"] == "less_than", number < leaf["low"]),
        F.lit(False),
    )


def _plain(text: Column) -> Column:
    """Lower case, with the letters that patterns without case take for others: whatever holds a needle, holds it in this form too."""
    return F.translate(F.lower(text), "ſıς", "siσ")


def _runs(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters; of size 0 the empty run."""
    if not size:
        return F.array(F.lit(""))
    count = F.length(text) - (size - 1)
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))))


def met_by_index(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, number) of each different text with each needle that its plain form holds; ``needles`` has number and needle.

    A needle is looked up by the one of its runs that fewest texts have; needles with a run that no text has
    are gone at once. Runs of texts that no needle has are dropped before they are counted.
    """
    needles = needles.select("number", _plain(F.col("needle")).alias("needle")).withColumn("size", F.least(F.length("needle"), F.lit(RUN))).checkpoint()
    sizes = sorted(r["size"] for r in needles.select("size").distinct().collect())  # at most RUN + 1
    if not sizes:
        return texts.select("text", F.lit(None).cast("long").alias("number")).limit(0)
    own = needles.select("number", F.explode(_cases(sizes, lambda s: _runs(F.col("needle"), s))).alias("run"))
    runs = own.select("run").distinct().checkpoint()
    bytes_ = runs.agg(F.sum(F.octet_length("run") + 40)).first()[0]
    plain = texts.withColumn("plain", _plain(F.col("text")))
    made = plain.select("text", F.explode(F.array_compact(F.flatten(F.array(*[F.coalesce(_runs(F.col("plain"), s), F.array().cast("array<string>")) for s in sizes])))).alias("run"))
    counts = made.join(F.broadcast(runs) if bytes_ <= BROADCAST_BYTES else runs, "run").groupBy("run").agg(F.count("*").alias("texts"))
    known = own.join(counts, "run", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "run")).alias("rarest"))
    chosen = known.filter("rarest.texts > 0").select("number", F.col("rarest.run").alias("run")).checkpoint()
    size = chosen.agg(F.sum(F.octet_length("run") + 48)).first()[0] or 0
    return made.join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, "run").select("text", "number")


def _sized(df: DataFrame, bytes_: Column) -> DataFrame:
    """A table that is kept already, to be broadcast if it is small, so that the wide side of a join doesn't move."""
    size = df.agg(F.sum(bytes_ + 40)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _cases(sizes: list[int], build) -> Column:
    out = None
    for s in sizes:
        out = F.when(F.col("size") == s, build(s)) if out is None else out.when(F.col("size") == s, build(s))
    return out


def leads_by_text(texts: DataFrame, anchored: DataFrame) -> DataFrame:
    """For each different text (column ``text``) what its anchors lead to: leads, best first, up to one without further leaves."""
    equal = _undominated(anchored.filter("anchor.kind = 'set'").select(F.explode(F.array_distinct("anchor.list")).alias("text"), "rank", "rest"), "text")
    found = texts.join(equal, "text")
    others = anchored.filter("anchor.kind <> 'set'").withColumn("number", F.monotonically_increasing_id()).checkpoint()
    met = met_by_index(texts, others.select("number", "needle")).join(others.select("number", "anchor", "rank", "rest"), "number")
    met = met.filter(_test(F.col("anchor"), F.col("text"), F.lit(None).cast("double")))
    found = found.select("text", "rank", "rest").unionByName(met.select("text", "rank", "rest"))
    # Behind the best lead without further leaves nothing can win.
    sure = F.min(F.when(F.size("rest") == 0, F.col("rank")))
    best = found.groupBy("text").agg(sure.alias("sure"))
    near = found.join(best, "text").filter(F.col("sure").isNull() | (F.col("rank") <= F.col("sure")))
    return near.groupBy("text").agg(F.sort_array(F.collect_set(F.struct("rank", "rest"))).alias("leads"))


def categorize_from_table(df: DataFrame, rules: DataFrame, options: Options = Options(), rule_id_column: str | None = None) -> DataFrame:
    """Like ``matching.categorize``, by the active rules of a table, which isn't collected.

    Active rules are tried by priority, ties by ``seq``; rows without a match get empty texts. What comes to the
    driver is which fields, forms and kinds the rules use, whose number has a bound. Alternatives without any text leaf
    are tried one by one in each row.
    """
    from ledgerspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    known = alternatives(rules, df, options).checkpoint()
    used = known.select(F.explode(F.concat(F.array("anchor"), "rest")).alias("l")).select("l.kind", "l.field", "l.folded").distinct().collect()
    anchors = {(r["field"], r["folded"]) for r in known.filter(~F.col("anchor.kind").isin(*NUMERIC_KINDS)).select("anchor.field", "anchor.folded").distinct().collect()}
    shapes = [Leaf(r["kind"], r["field"], None, r["folded"]) for r in used]
    kept = [name for name in df.columns if name not in ("Category", "Subcategory", "Categorization_Source")]
    operands = Operands(df.select(*kept), shapes)
    key = lambda leaf: f"{leaf.field}|{str(leaf.folded).lower()}"
    texts = {key(leaf): operands.name(leaf) for leaf in shapes if leaf.kind not in NUMERIC_KINDS}
    numbers = {leaf.field: operands.name(leaf) for leaf in shapes if leaf.kind in NUMERIC_KINDS}

    rows, leads = operands.df, []
    for i, (field, folded) in enumerate(sorted(anchors)):
        name = texts[f"{field}|{str(folded).lower()}"]
        own = known.filter((F.col("anchor.field") == field) & (F.col("anchor.folded") == folded) & ~F.col("anchor.kind").isin(*NUMERIC_KINDS))
        different = operands.df.select(F.col(name).alias("text")).filter("text IS NOT NULL").distinct().checkpoint()
        found = leads_by_text(different, own).select(F.col("text").alias(f"__met_{i}"), F.col("leads").alias(f"__leads_{i}")).checkpoint()
        found = _sized(found, F.octet_length(f"__met_{i}") + F.octet_length(F.col(f"__leads_{i}").cast("string")))
        rows = rows.join(found, F.col(name) == F.col(f"__met_{i}"), "left").drop(f"__met_{i}")
        leads.append(F.coalesce(f"__leads_{i}", F.array().cast(_LEADS)))
    lone = known.filter(F.col("anchor.kind").isin(*NUMERIC_KINDS)).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.concat(F.array("anchor"), "rest").alias("rest")))).alias("leads")
    )
    if any(leaf.kind in NUMERIC_KINDS for leaf in shapes):
        leads.append(lone.scalar())
    if not leads:
        ranked = rows.withColumn("__rank", F.lit(None).cast(_RANK))
    else:
        values = lambda places: F.create_map(*[x for k, v in places.items() for x in (F.lit(k), F.col(v))]) if places else None
        text_map, number_map = values(texts), values(numbers)
        rows = rows.withColumn("__leads", F.concat(*leads))
        rows = rows.withColumn("__texts", text_map if text_map is not None else F.create_map().cast("map<string,string>"))
        rows = rows.withColumn("__numbers", number_map if number_map is not None else F.create_map().cast("map<string,double>"))

        def holds(leaf: Column) -> Column:
            text = F.try_element_at("__texts", F.concat(leaf["field"], F.lit("|"), leaf["folded"].cast("string")))
            return _test(leaf, text, F.try_element_at("__numbers", leaf["field"]))

        complete = F.filter("__leads", lambda lead: F.forall(lead["rest"], holds))
        ranked = rows.withColumn("__rank", F.array_min(F.transform(complete, lambda lead: lead["rank"])))
    winners = known.select(F.col("rank.seq").alias("seq")).distinct()
    answers = rules.join(winners, "seq", "left_semi").select(
        F.col("seq").cast("long").alias("__seq"), F.col("id").alias("__id"),
        *[F.coalesce(name, F.lit("")).alias(f"__{name}") for name in ("category", "subcategory")], F.concat(F.lit("Rule: "), F.coalesce("name", F.lit(Rule.name))).alias("__source"),
    )
    answers = answers.checkpoint()
    answers = _sized(answers, F.octet_length(F.concat_ws("", "__id", "__category", "__subcategory", "__source")) + 8)
    joined = ranked.withColumn("__won", F.col("__rank.seq")).join(answers, F.col("__won") == F.col("__seq"), "left")
    columns = [*kept, *[F.coalesce(f"__{n}", F.lit("")).alias(m) for n, m in (("category", "Category"), ("subcategory", "Subcategory"), ("source", "Categorization_Source"))]]
    return joined.select(*columns, *([F.col("__id").alias(rule_id_column)] if rule_id_column else []))
