"""A forward rule engine: rules are rows, compiled into projections.

A rule is (rule, level, condition, text): SQL expressions over the facts' columns and over the names of other
rules, whose results they then use: of a `value` the value, of any other level whether it holds. Rules are ordered by
these uses (a layer is what depends on earlier layers alone), and each layer is one projection, so the whole
table runs in one pass over the facts, in generated code, and a new rule needs a row, no code."""

from __future__ import annotations

import re
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, functions as F

MOST_RULES = 5000  # of a table; a larger one is refused, as a plan of that many expressions is
VALUE = "value"
_QUOTED, _NAME = re.compile(r"'(?:[^']|'')*'"), re.compile(r"[A-Za-z_]\w*")


def layers(rules: list[tuple[str, str, str, str]]) -> list[list[tuple[str, str, str, str]]]:
    """Rules by dependency. A name in a quoted text is no use of a rule; rules that use each other in a circle
    and two rules of one name are errors."""
    by_name = {r[0].lower(): r for r in rules}
    if len(by_name) < len(rules):
        raise ValueError("two rules have one name")
    uses = {n: {w.lower() for e in (r[2], r[3]) for w in _NAME.findall(_QUOTED.sub("", e or ""))} & by_name.keys() for n, r in by_name.items()}
    order = TopologicalSorter(uses)
    try:
        order.prepare()
    except CycleError as e:
        raise ValueError(f"rules use each other in a circle: {' '.join(e.args[1])}") from None
    out = []
    while order.is_active():
        ready = order.get_ready()
        out.append([by_name[n] for n in sorted(ready)])
        order.done(*ready)
    return out


def read_rules(rules: DataFrame) -> list[tuple[str, str, str, str]]:
    rows = [tuple(r) for r in rules.select("rule", "level", "condition", "text").limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rows


def evaluated(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """facts with a column for each rule: a value, or whether the rule holds (null counts as not)."""
    clash = {c.lower() for c in facts.columns} & {r.rule.lower() for r in rules.select("rule").limit(MOST_RULES).collect()}
    if clash:
        raise ValueError(f"rules are named as columns: {', '.join(sorted(clash))}")
    for layer in layers(read_rules(rules)):
        expr = lambda r: F.expr(r[2]) if r[1] == VALUE else F.coalesce(F.expr(r[2]), F.lit(False))
        facts = facts.withColumns({r[0]: expr(r) for r in layer})
    return facts


def findings(facts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, level, text): one row for each rule that holds of a fact, in no order. `text` is an expression too;
    a null one is no text."""
    own = [r for r in read_rules(rules) if r[1] != VALUE]
    told = evaluated(facts, rules)
    row = lambda r: F.when(F.col(r[0]), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("level"), (F.expr(r[3]) if r[3] else F.lit(None)).cast("string").alias("text")))
    if not own:
        return told.select(*keys, F.lit("").alias("rule"), F.lit("").alias("level"), F.lit("").alias("text")).where("false")
    all_: Column = F.filter(F.array(*map(row, own)), lambda x: x.isNotNull())
    return told.select(*keys, F.explode(all_).alias("f")).select(*keys, "f.*")
