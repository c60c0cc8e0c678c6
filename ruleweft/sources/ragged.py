"""Ragged facts (a map of tagged cells) for the full engine: one column of cells for each field that rules touch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.model import Append, Calculate, CreateFact, DeleteFact, Formula, Increment, LogTemplate, Rule, RuleError, SetField, UpdateFact, fields
from ruleweft.operators.actions import TEMPLATE

HEAD = ("fact_id", "external_id", "event_ts")


def touched(rules: Iterable[Rule]) -> list[str]:
    """Fields that rules read or write."""
    from ruleweft.functions.expr import parse, variables

    out: set[str] = set()
    for r in rules:
        for c in r.conditions:
            out |= fields(c)
        for a in r.actions:
            if isinstance(a, (SetField, Increment, Append)):
                out.add(a.field)
            elif isinstance(a, LogTemplate):
                out |= set(a.fields)
            elif isinstance(a, UpdateFact):
                out |= {a.id_field, *a.updates}
            elif isinstance(a, DeleteFact):
                out.add(a.id_field)
            elif isinstance(a, CreateFact):
                out |= {m[1] for v in a.data.values() if isinstance(v, str) and (m := TEMPLATE.match(v))}
            elif isinstance(a, Calculate):
                out |= {v for v in a.inputs.values() if isinstance(v, str)} | {a.output}
            elif isinstance(a, Formula):
                out |= {*variables(parse(a.expression)), a.output}
    return sorted(out - set(HEAD))


def widen(facts: DataFrame, rules: Iterable[Rule], cells: str = "fields") -> DataFrame:
    """Ragged facts with a column of cells for each field that the rules touch; the map stays."""
    names = touched(rules)
    if clash := set(names) & {cells}:
        raise RuleError("schema", f"a field is named like the map: {sorted(clash)}")
    return facts.select(*facts.columns, *(F.col(cells)[n].alias(n) for n in names))


def fold(facts: DataFrame, cells: str = "fields") -> DataFrame:
    """What ``widen`` made, after changes, as ragged facts again: columns of cells go back into the map."""
    names = [c for c in facts.columns if c not in HEAD and c != cells]
    from ruleweft.functions import values as V

    pairs = F.array(*(F.struct(F.lit(n).alias("key"), V.converted(F.col(f"`{n}`"), facts.schema[n].dataType, V.CELL_TYPE).alias("value")) for n in names))
    new = F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))
    old = F.map_filter(F.coalesce(F.col(cells), F.create_map().cast(facts.schema[cells].dataType)), lambda k, _: ~k.isin(*names))
    return facts.select(*(c for c in facts.columns if c in HEAD), F.map_concat(old, new).alias(cells)) if names else facts
