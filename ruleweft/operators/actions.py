"""Actions as rows of firings: each becomes a struct expression over the fact that fired the rule."""

from __future__ import annotations

import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweft.functions import values as V
from ruleweft.functions.calculators import calculate
from ruleweft.functions.expr import Typed, compile_expression, taken, typed
from ruleweft.model import Alert, Append, Calculate, CreateFact, DeleteFact, Formula, Increment, Log, LogTemplate, Notify, RuleError, SetField, UpdateFact
from ruleweft.operators.predicates import Resolver

FIRING = f"rule_id bigint, fact_id bigint, action_seq int, kind string, field string, value {V.CELL}, message string, target_fact_id bigint, extra map<string,string>"
TEMPLATE = re.compile(r"^\{\{\s*(\w+)\s*\}\}$")


def _row(kind: str | Column, field: str | None = None, value: Column | None = None, message: Column | str | None = None, target: Column | None = None, extra: dict[str, Column | str] | None = None) -> dict[str, Column]:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [y for k, x in (extra or {}).items() for y in (F.lit(k), text(x).cast("string"))]
    return {
        "kind": text(kind), "field": F.lit(field).cast("string"), "value": F.expr(V.NO_CELL) if value is None else value, "message": text(message).cast("string"),
        "target_fact_id": (F.lit(None) if target is None else target).cast("bigint"), "extra": F.create_map(*pairs).cast("map<string,string>") if pairs else F.lit(None).cast("map<string,string>"),
    }


def _either(ok: Column, good: dict[str, Column], message: str) -> dict[str, Column]:
    """``good`` where ``ok`` holds, else a log row that says what failed: one bad fact never stops a batch."""
    bad = _row("logged", message=message)
    return {k: F.when(ok, good[k]).otherwise(bad[k]) for k in good}


def _json(x: Any) -> str:
    import json

    return json.dumps(x, default=str, sort_keys=True)


def appended(cell: Column, value: Any) -> Column:
    """The JSON text of a cell's array with one more item; a missing field becomes an array of one."""
    item = _json(value)
    return F.when(cell.isNull(), F.lit(f"[{item}]")).when(cell["j"] == "[]", F.lit(f"[{item}]")).otherwise(F.concat(F.left(cell["j"], F.length(cell["j"]) - 1), F.lit(f",{item}]")))


def _typed_cell(x: Typed) -> Column:
    """A cell of an expression's value."""
    if x.kind == "cell":
        return x.col
    k, null = x.kind, lambda t: F.lit(None).cast(t)
    whole = k == "number" and x.whole
    name = {"number": "integer" if whole else "float"}.get(k, k)
    part = lambda when, t, c=x.col: c.cast(t) if when else null(t)
    json = part(k in ("array", "object"), "string", F.to_json(x.col)) if k in ("array", "object") else null("string")
    return F.struct(
        F.when(x.col.isNull(), "null").otherwise(name).alias("t"), part(k == "string", "string").alias("s"), part(whole, "bigint").alias("i"), part(k == "number" and not whole, "double").alias("d"),
        part(k == "boolean", "boolean").alias("b"), part(k == "date", "timestamp").alias("ts"), json.alias("j"),
    )


def _input(x: Any, resolve: Resolver) -> Typed | None:
    """A calculator's input: a field's name, else a literal. A field that the table lacks is left out."""
    if isinstance(x, str):
        c, t = resolve(x)
        return None if V.kind(t) == "null" else taken(typed(c, t), "number")
    return Typed(V.lit(x), V.literal_kind(x), isinstance(x, int))


def id_of(c: Column, t) -> Column:
    """The fact id that a field holds; NULL if it holds none."""
    if V.is_cell(t):
        return F.coalesce(c["i"], c["s"].try_cast("bigint"))
    return c.try_cast("bigint") if V.kind(t) in ("number", "string") else F.lit(None).cast("bigint")


def incremented(cell: Column, by: int | float) -> Column:
    """A cell after an increment; NULL if it holds another type."""
    part, name = ("i", "integer") if isinstance(by, int) else ("d", "float")
    new = F.struct(F.lit(name).alias("t"), *((cell[p] + V.lit(by) if p == part else cell[p]).alias(p) for p in ("s", "i", "d", "b", "ts", "j")))
    return F.when(cell.isNull(), V.literal_cell(by)).when(cell["t"] == name, new)


def calculator_inputs(action: Calculate, resolve: Resolver) -> dict[str, Typed]:
    return {k: x for k, v in action.inputs.items() if (x := _input(v, resolve)) is not None}


def compile_action(action: Any, resolve: Resolver) -> dict[str, Column]:
    """The parts of an action's firing row."""
    if isinstance(action, SetField):
        return _row("field_set", action.field, V.literal_cell(action.value))
    if isinstance(action, Log):
        return _row("logged", message=action.message)
    if isinstance(action, LogTemplate):
        parts = action.template.split("{}")
        args = [F.coalesce(V.as_string(*resolve(f)), F.lit("null")) for f in action.fields][: len(parts) - 1]
        pieces = [F.lit(parts[0])]
        for i, p in enumerate(parts[1:]):
            pieces += [args[i] if i < len(args) else F.lit("{}"), F.lit(p)]
        return _row("logged", message=F.concat(*pieces))
    if isinstance(action, Alert):
        return _row("logged", message=f"Alert [{action.type}]: {action.message}", extra={"severity": action.severity, **{k: str(v) for k, v in action.metadata.items()}})
    if isinstance(action, Notify):
        return _row("notification_sent", message=action.subject, extra={"recipient": action.recipient, "channel": action.channel, "message": action.message, **{k: str(v) for k, v in action.metadata.items()}})
    if isinstance(action, (UpdateFact, DeleteFact)):
        c, t = resolve(action.id_field)
        target = id_of(c, t)
        if isinstance(action, DeleteFact):
            return _either(target.isNotNull(), _row("fact_deleted", action.id_field, target=target), f"Delete failed: no fact id in '{action.id_field}'")
        good = _row("fact_updated", ",".join(sorted(action.updates)), target=target, extra={"updates": _json(action.updates)})
        return _either(target.isNotNull(), good, f"Update failed: no fact id in '{action.id_field}'")
    if isinstance(action, Increment):
        c, t = resolve(action.field)
        if V.is_cell(t):
            new = incremented(c, action.by)
            good = _row("field_incremented", action.field, new, extra={"old": F.coalesce(V.as_string(c, t), F.lit("0"))})
            return _either(new.isNotNull(), good, f"Increment failed: '{action.field}' is of another type")
        k, whole = V.kind(t), isinstance(action.by, int)
        if k == "null":
            return _row("field_incremented", action.field, V.literal_cell(action.by), extra={"old": "0"})
        if k != "number" or whole != isinstance(t, V.WHOLE):
            return _row("logged", message=f"Increment failed: '{action.field}' is of another type")
        new = F.coalesce(c, F.lit(0)) + V.lit(action.by)
        return _row("field_incremented", action.field, _typed_cell(Typed(new, "number", whole)), extra={"old": F.coalesce(c, F.lit(0)).cast("string")})
    if isinstance(action, Append):
        c, t = resolve(action.field)
        if V.is_cell(t):
            n = F.size(F.from_json(appended(c, action.value), "array<string>"))
            return _either(F.coalesce(c["t"] == "array", F.lit(True)), _row("array_appended", action.field, V.literal_cell(action.value), extra={"new_length": n}), f"Append failed: '{action.field}' is not an array")
        if V.kind(t) not in ("array", "null"):
            return _row("logged", message=f"Append failed: '{action.field}' is not an array")
        n = F.coalesce(V.size(c, t), F.lit(0)) + 1 if V.kind(t) == "array" else F.lit(1)
        return _row("array_appended", action.field, V.literal_cell(action.value), extra={"new_length": n})
    if isinstance(action, CreateFact):
        cols = []
        for k, v in sorted(action.data.items()):
            m = TEMPLATE.match(v) if isinstance(v, str) else None
            cols.append((resolve(m[1])[0] if m else V.lit(v)).alias(k))
        return _row("fact_created", extra={"data": F.to_json(F.struct(*cols)) if cols else "{}"})
    if isinstance(action, Calculate):
        try:
            got = calculate(action.calculator, calculator_inputs(action, resolve))
        except RuleError as e:
            return _row("logged", message=f"Calculator '{action.calculator}' failed: {e}")
        from ruleweft.functions.calculators import REGISTRY

        cell = _typed_cell(Typed(got, REGISTRY[action.calculator].gives))
        good = _row("calculated", action.output, cell, message=action.calculator)
        return _either(got.isNotNull(), good, f"Calculator '{action.calculator}' failed: an input is missing")
    if isinstance(action, Formula):
        x = compile_expression(action.expression, resolve)
        return _row("calculated", action.output, _typed_cell(x), message=action.expression)
    raise RuleError("action", f"unknown action {type(action).__name__}")


def firing(rule_id: int, seq: int, action: Any, resolve: Resolver) -> Column:
    """One firing as a struct, without the fact's id."""
    parts = compile_action(action, resolve)
    return F.struct(F.lit(rule_id).cast("bigint").alias("rule_id"), F.lit(seq).cast("int").alias("action_seq"), *(parts[k].alias(k) for k in ("kind", "field", "value", "message", "target_fact_id", "extra")))


#: Arrow's view of a firing without the fact's id.
FIRING_TYPE = pa.struct(
    [
        ("rule_id", pa.int64()), ("action_seq", pa.int32()), ("kind", pa.string()), ("field", pa.string()),
        ("value", pa.struct([("t", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("d", pa.float64()), ("b", pa.bool_()), ("ts", pa.timestamp("us", "UTC")), ("j", pa.string())])),
        ("message", pa.string()), ("target_fact_id", pa.int64()), ("extra", pa.map_(pa.string(), pa.string())),
    ]
)


def literal_firing(rule_id: int, seq: int, action: Any) -> dict:
    """One firing of an action that doesn't read the fact, as Python values."""
    row = dict.fromkeys(("field", "value", "message", "target_fact_id", "extra")) | {"rule_id": rule_id, "action_seq": seq}
    if isinstance(action, SetField):
        return row | {"kind": "field_set", "field": action.field, "value": V.plain_cell(action.value)}
    if isinstance(action, Log):
        return row | {"kind": "logged", "message": action.message}
    more = [(k, str(v)) for k, v in action.metadata.items()]
    if isinstance(action, Alert):
        return row | {"kind": "logged", "message": f"Alert [{action.type}]: {action.message}", "extra": [("severity", action.severity), *more]}
    return row | {"kind": "notification_sent", "message": action.subject, "extra": [("recipient", action.recipient), ("channel", action.channel), ("message", action.message), *more]}


def ordered(actions: tuple) -> list[tuple[int, Any]]:
    """Actions with their numbers: created facts follow all others."""
    first = [a for a in actions if not isinstance(a, CreateFact)]
    return list(enumerate(first + [a for a in actions if isinstance(a, CreateFact)]))
