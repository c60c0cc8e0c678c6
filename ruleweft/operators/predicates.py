"""Condition trees as two-valued Columns: every leaf is true or false, so negation never meets NULL."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweft.functions import values as V
from ruleweft.model import All, AnyOf, NoneOf, RuleError, Test

ORDER = {"gt": operator.gt, "lt": operator.lt, "ge": operator.ge, "le": operator.le}
#: Resolves a field's name to its Column and type.
Resolver = Callable[[str], tuple[Column, T.DataType]]


def resolver(schema: T.StructType, constants: dict[str, Any] | None = None) -> Resolver:
    """Fields of a schema; ``constants`` stand in for fields that it lacks."""
    names = {f.name: f.dataType for f in schema.fields}
    kinds = {"number": lambda v: T.LongType() if isinstance(v, int) else T.DoubleType(), "string": lambda v: T.StringType(), "boolean": lambda v: T.BooleanType(), "date": lambda v: T.TimestampType()}

    def own(name: str) -> tuple[Column, T.DataType]:
        if name in names:
            return F.col(f"`{name}`"), names[name]
        v = (constants or {}).get(name)
        k = V.literal_kind(v)
        return (V.lit(v), kinds[k](v)) if k in kinds else (F.lit(None), T.NullType())

    return own


def leaf(test: Test, resolve: Resolver) -> Column:
    """One test. A missing field makes ``ne`` true and all else false; classes that can't be compared are an error,
    but for equality (never equal) and text tests (false)."""
    c, t = resolve(test.field)
    if V.is_cell(t):
        return cell_test(test, c, c.isNotNull())
    k, lk, v = V.kind(t), V.literal_kind(test.value), test.value
    if k == "null":
        return F.lit(test.op == "ne" and lk != "null" or test.op == "eq" and lk == "null")
    if test.op in ("eq", "ne"):
        same = c.isNull() if lk == "null" else _equal(c, t, v) if k == lk else F.lit(False)
        same = F.coalesce(same, F.lit(False))
        return same if test.op == "eq" else ~same
    if test.op in ("gt", "lt", "ge", "le"):
        if not V.compatible(k, lk) or k in ("array", "object"):
            raise RuleError("type", f"{test.field} ({k}) can't be ordered against {lk}")
        x = ORDER[test.op](c, V.lit(v))
        # NaN counts as the largest number, so only these two can meet it
        x = x & ~F.isnan(c) if test.op in ("gt", "ge") and isinstance(t, (T.FloatType, T.DoubleType)) else x
        return F.coalesce(x, F.lit(False))
    if test.op == "contains" and k == "array":
        return F.coalesce(F.array_contains(c, V.lit(v).cast(t.elementType)), F.lit(False)) if V.compatible(V.kind(t.elementType), lk) else F.lit(False)
    if k != "string" or lk != "string":
        return F.lit(False)
    return F.coalesce({"contains": c.contains, "starts_with": c.startswith, "ends_with": c.endswith}[test.op](v), F.lit(False))


def _equal(c: Column, t: T.DataType, v: Any) -> Column:
    x = V.lit(v)
    if V.kind(t) in ("array", "object"):
        return F.to_json(c) == F.to_json(x)
    return (c == x) & ~F.isnan(c) if isinstance(t, (T.FloatType, T.DoubleType)) else c == x


def ragged_leaf(test: Test, fields: str = "fields") -> Column:
    """One test over a map of tagged cells. A missing field makes ``ne`` true and all else false; null is a value that
    equals null; 5 isn't equal to 5.0 but is ordered like it; values that can't be compared make the test false."""
    return cell_test(test, F.col(fields)[test.field], F.coalesce(F.map_contains_key(fields, test.field), F.lit(False)))


def cell_test(test: Test, cell: Column, here: Column) -> Column:
    """One test of a tagged cell; ``here``: the field is there."""
    v, lk = test.value, V.literal_kind(test.value)
    if test.op in ("eq", "ne"):
        same = V.cell_equal(cell, V.literal_cell(v))
        return here & same if test.op == "eq" else ~here | ~same
    if test.op in ("gt", "lt", "ge", "le"):
        part = {"number": V.cell_number(cell), "string": cell["s"], "boolean": cell["b"], "date": cell["ts"]}.get(lk)
        if part is None:
            return F.lit(False)
        return F.coalesce(ORDER[test.op](part, V.lit(v)), F.lit(False))
    if lk != "string":
        return F.coalesce(F.array_contains(F.from_json(cell["j"], "array<string>"), str(v)), F.lit(False)) if test.op == "contains" else F.lit(False)
    member = F.array_contains(F.from_json(cell["j"], "array<string>"), v) & (cell["t"] == "array")
    by = {"contains": F.coalesce(cell["s"].contains(v), member), "starts_with": cell["s"].startswith(v), "ends_with": cell["s"].endswith(v)}
    return F.coalesce(by[test.op], F.lit(False))


def compile_condition(condition: Any, resolve: Resolver, special: Callable[[Any], Column] | None = None, first_only: bool = False, test: Callable[[Test], Column] | None = None) -> Column:
    """A condition tree as a Column. ``special`` compiles conditions that need a plan of their own, ``test`` the leaves.

    ``first_only``: compatibility with the aggregator's NOT, which negates its first child and holds without any.
    """
    own = lambda cs: [compile_condition(c, resolve, special, first_only, test) for c in cs]
    if isinstance(condition, Test):
        return test(condition) if test else leaf(condition, resolve)
    if isinstance(condition, All):
        return reduce(and_, own(condition.conditions), F.lit(True))
    if isinstance(condition, AnyOf):
        return reduce(or_, own(condition.conditions), F.lit(False))
    if isinstance(condition, NoneOf):
        if first_only:
            return ~own(condition.conditions[:1])[0] if condition.conditions else F.lit(True)
        return ~reduce(or_, own(condition.conditions)) if condition.conditions else F.lit(False)
    if special is None:
        raise RuleError("condition", f"{type(condition).__name__} isn't allowed here")
    return special(condition)


def prefilter(condition: Any, resolve: Resolver) -> Column | None:
    """What every match satisfies, in the plain form that scans can take over; None if there is no such form."""
    if isinstance(condition, Test):
        c, t = resolve(condition.field)
        k, v = V.kind(t), condition.value
        if k not in ("number", "string", "date") or k != V.literal_kind(v) or condition.op in ("ne", "contains", "ends_with"):
            return None
        return c.startswith(V.lit(v)) if condition.op == "starts_with" else (operator.eq if condition.op == "eq" else ORDER[condition.op])(c, V.lit(v))
    if isinstance(condition, (All, AnyOf)):
        own = [prefilter(c, resolve) for c in condition.conditions]
        if isinstance(condition, All):
            return reduce(and_, some) if (some := [c for c in own if c is not None]) else None
        return reduce(or_, own) if own and all(c is not None for c in own) else None
    return None


def compile_rule(conditions: tuple, resolve: Resolver, special: Callable[[Any], Column] | None = None) -> Column:
    """All of a rule's conditions; a rule without any never fires."""
    return compile_condition(All(conditions), resolve, special) if conditions else F.lit(False)


def ragged_matches(facts, rules, fields: str = "fields", fact_id: str = "fact_id"):
    """(rule_id, fact_id) of matches over ragged facts; conditions are trees of tests."""
    cases = [F.when(compile_condition(All(r.conditions), lambda n: (F.lit(None), T.NullType()), test=lambda t: ragged_leaf(t, fields)), F.lit(r.id).cast("bigint")) for r in rules if r.conditions and r.enabled]
    return facts.select(F.explode(F.array_compact(F.array(*cases))).alias("rule_id"), F.col(fact_id).cast("bigint").alias("fact_id"))
