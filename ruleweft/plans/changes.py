"""Facts after their rules' actions: one projection, whose types follow from the rules.

All conditions and values read the facts as they were; of several values for one field the last by rule and action
stays. A field that the facts lack becomes a new column, one that gets values of another kind a column of tagged cells.
Only updates and deletions of other facts need a shuffle: their targets are grouped by id and joined once.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweft.functions import values as V
from ruleweft.functions.calculators import calculate
from ruleweft.functions.expr import compile_expression
from ruleweft.model import Append, Calculate, CreateFact, DeleteFact, Formula, Increment, Rule, RuleError, SetField, UpdateFact
from ruleweft.operators.actions import TEMPLATE, appended, calculator_inputs, id_of, incremented, ordered
from ruleweft.operators.frames import positions
from ruleweft.operators.predicates import Resolver


def value(action: Any, resolve: Resolver) -> tuple[str, Column, Column | None] | None:
    """The field that an action writes, its new value, and when there is one; None if it writes nothing."""
    if isinstance(action, SetField):
        return action.field, V.lit(action.value), None
    if isinstance(action, Increment):
        c, t = resolve(action.field)
        if V.kind(t) == "null":
            return action.field, V.lit(action.by), None
        if V.is_cell(t):
            new = incremented(c, action.by)
            return action.field, new, new.isNotNull()
        if V.kind(t) != "number" or isinstance(action.by, int) != isinstance(t, V.WHOLE):
            return None
        return action.field, F.coalesce(c.cast("bigint") if isinstance(t, V.WHOLE) else c, F.lit(0)) + V.lit(action.by), None
    if isinstance(action, Append):
        c, t = resolve(action.field)
        if V.kind(t) == "null":
            return action.field, F.array(V.lit(action.value)), None
        if V.is_cell(t):
            none = lambda k: F.lit(None).cast(k)
            new = F.struct(F.lit("array").alias("t"), none("string").alias("s"), none("bigint").alias("i"), none("double").alias("d"), none("boolean").alias("b"), none("timestamp").alias("ts"), appended(c, action.value).alias("j"))
            return action.field, new, F.coalesce(c["t"] == "array", F.lit(True))
        if V.kind(t) != "array":
            return None
        if not V.compatible(V.kind(t.elementType), V.literal_kind(action.value)):
            raise RuleError("type", f"'{action.field}' holds {V.kind(t.elementType)}, not {V.literal_kind(action.value)}")
        return action.field, F.concat(F.coalesce(c, F.array().cast(t)), F.array(V.lit(action.value).cast(t.elementType))), None
    if isinstance(action, Calculate):
        try:
            got = calculate(action.calculator, calculator_inputs(action, resolve))
        except RuleError:
            return None  # the firing says why
        return action.output, got, got.isNotNull()
    if isinstance(action, Formula):
        return action.output, compile_expression(action.expression, resolve).col, None
    return None


def applied(base: DataFrame, columns: list[str], rules: list[Rule], holds: dict[int, Column], resolve: Resolver, fact_id: str) -> DataFrame:
    """``columns`` of ``base`` after the actions of ``rules``; ``holds``: each rule's condition over ``base``."""
    rules = sorted(rules, key=lambda r: r.id)
    flag = {r.id: f"_holds{i}" for i, r in enumerate(rules)}
    base = base.withColumns({flag[r.id]: holds[r.id] for r in rules})
    own: dict[str, list[tuple[int, Column, Column]]] = defaultdict(list)  # by field: place, condition, value
    gone: list[Column] = []
    other: list[tuple[int, Column, Column, dict[str, Any] | None]] = []  # place, condition, target, updates
    place = 0
    for r in rules:
        on = F.col(flag[r.id])
        for _, a in ordered(r.actions):
            place += 1
            if isinstance(a, (UpdateFact, DeleteFact)):
                updates = a.updates if isinstance(a, UpdateFact) else None
                if a.id_field != fact_id:
                    c, t = resolve(a.id_field)
                    if V.is_cell(t) or V.kind(t) in ("number", "string"):
                        other.append((place, on, id_of(c, t), updates))
                elif updates is None:
                    gone.append(on)
                else:
                    for f, v in sorted(updates.items()):
                        own[f].append((place, on, V.lit(v)))
            elif got := value(a, resolve):
                f, v, ok = got
                own[f].append((place, on if ok is None else on & ok, v))
    told: dict[str, list[tuple[int, Any]]] = defaultdict(list)
    for k, _, _, updates in other:
        for f, v in (updates or {}).items():
            told[f].append((k, v))
    if other:
        rows = base.select(F.explode(F.array(*(F.when(on, F.struct(t.alias("t"), F.lit(k).alias("k"))) for k, on, t, _ in other))).alias("_x")).where("_x.t IS NOT NULL").select("_x.*")
        at = lambda ks: F.max(F.when(F.col("k").isin(*ks), F.col("k")))
        targets = rows.groupBy(F.col("t").alias("_target")).agg(at([k for k, _, _, u in other if u is None] or [-1]).alias("_gone"), *(at([k for k, _ in ks]).alias(f"_told{i}") for i, ks in enumerate(told.values())))
        base = base.join(targets, F.col(f"`{fact_id}`").cast("bigint") == F.col("_target"), "left").where("_gone IS NULL")
    # one analysis tells the types of all new values
    names = list(dict.fromkeys([*own, *told]))
    every = [(f, v) for f in names for v in [*(v for _, _, v in own[f]), *(V.lit(v) for _, v in told[f])]]
    types = [x.dataType for x in base.select(*(v.alias(f"_{i}") for i, (_, v) in enumerate(every))).schema.fields] if every else []
    of = defaultdict(list)
    for (f, _), t in zip(every, types, strict=True):
        of[f].append(t)
    new: dict[str, Column] = {}
    for f in names:
        old, t0 = resolve(f) if f in columns else (F.lit(None), base.select(F.lit(None).alias("x")).schema[0].dataType)
        to = V.unified([t0, *of[f]])
        as_to = [V.converted(v, t, to) for (_, v), t in zip([x for x in every if x[0] == f], of[f], strict=True)]
        out, turn = V.converted(old, t0, to), F.lit(-1)
        for (k, on, _), v in zip(own[f], as_to, strict=False):
            out, turn = F.when(on, v).otherwise(out), F.when(on, F.lit(k)).otherwise(turn)
        if told[f]:
            said = F.col(f"_told{list(told).index(f)}")
            late = reduce(lambda w, kv: w.when(said == kv[0][0], kv[1]), zip(told[f], as_to[len(own[f]) :], strict=True), F.when(F.lit(False), F.lit(None).cast(to)))
            out = F.when(F.coalesce(said, F.lit(-2)) > turn, late).otherwise(out)
        new[f] = out.alias(f)
    if gone:
        base = base.where(~reduce(or_, gone))
    return base.select(*(new.pop(c) if c in new else F.col(f"`{c}`") for c in columns), *new.values())


def created(base: DataFrame, rules: list[Rule], holds: dict[int, Column], resolve: Resolver, fact_id: str, first_id: int) -> DataFrame | None:
    """Facts that rules create, numbered from ``first_id`` in order of rule, fact and action; None if no rule does."""
    every: list[tuple[int, int, dict[str, Column]]] = []
    for r in rules:
        for seq, a in ordered(r.actions):
            if isinstance(a, CreateFact):
                cols = {k: resolve(m[1])[0] if isinstance(v, str) and (m := TEMPLATE.match(v)) else V.lit(v) for k, v in sorted(a.data.items())}
                every.append((r.id, seq, cols))
    if not every:
        return None
    flat = [(i, k, c) for i, (_, _, cols) in enumerate(every) for k, c in cols.items()]
    types = dict(zip(((i, k) for i, k, _ in flat), (x.dataType for x in base.select(*(c.alias(f"_{n}") for n, (_, _, c) in enumerate(flat))).schema.fields), strict=True)) if flat else {}
    names = sorted({k for _, k, _ in flat})
    to = {n: V.unified([t for (_, k), t in types.items() if k == n]) for n in names}
    cases = []
    for i, (rule, seq, cols) in enumerate(every):
        part = [V.converted(cols[n], types[i, n], to[n]) if n in cols else F.lit(None).cast(to[n]) for n in names]
        cases.append(F.when(holds[rule], F.struct(F.lit(rule).cast("bigint").alias("_rule"), F.lit(seq).alias("_seq"), *(c.alias(n) for n, c in zip(names, part, strict=True)))))
    rows = base.select(F.col(f"`{fact_id}`").cast("bigint").alias("_fact"), F.explode(F.array(*cases)).alias("_x")).where("_x IS NOT NULL").select("_fact", "_x.*")
    return positions(rows, ["_rule", "_fact", "_seq"]).select((F.col("_pos") + first_id).cast("bigint").alias(fact_id), *(F.col(f"`{n}`") for n in names))
