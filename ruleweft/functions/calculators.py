"""Named calculators: functions of Columns that rules call by name. Users register their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweft.functions.expr import FUNCTIONS, Typed
from ruleweft.model import RuleError


@dataclass
class Calculator:
    """``takes``: argument names in order, with their class (number, string, array or any); ``optional`` may be left out."""

    name: str
    build: Callable[..., Column]
    takes: dict[str, str]
    optional: tuple[str, ...] = ()
    gives: str = "number"
    aliases: dict[str, str] = field(default_factory=dict)


REGISTRY: dict[str, Calculator] = {}


def register(name: str, takes: dict[str, str], build: Callable[..., Column], optional: tuple[str, ...] = (), gives: str = "number", aliases: dict[str, str] | None = None) -> Calculator:
    """Adds a calculator, to rules and to the expression language (arguments by place)."""
    c = REGISTRY[name] = Calculator(name, build, takes, optional, gives, aliases or {})

    def call(*args: Typed) -> Typed:
        return Typed(calculate(name, dict(zip(takes, args, strict=False))), gives)

    FUNCTIONS[name] = (len(takes) - len(optional), len(takes), call)
    return c


def calculate(name: str, inputs: dict[str, Typed]) -> Column:
    """A calculator's Column; names other than its own are taken by its aliases."""
    if name not in REGISTRY:
        raise RuleError("calculator", f"calculator '{name}' not found")
    c = REGISTRY[name]
    got = {c.aliases.get(k, k): v for k, v in inputs.items()}
    for k, want in c.takes.items():
        if k not in got:
            if k in c.optional:
                continue
            raise RuleError("calculator", f"Missing argument '{k}'")
        if want != "any" and got[k].kind not in (want, "null"):
            raise RuleError("calculator", f"Invalid argument '{k}': expected {want}")
    return c.build(**{k: (got[k].col.cast("double") if want == "number" else got[k].col) for k, want in c.takes.items() if k in got})


NUM2 = {"a": "number", "b": "number"}
register("add", NUM2, lambda a, b: a + b, aliases={"addend1": "a", "addend2": "b", "left": "a", "right": "b"})
register("multiply", NUM2, lambda a, b: a * b, aliases={"multiplicand": "a", "multiplier": "b", "left": "a", "right": "b"})
PERCENT = {"amount": "number", "percentage": "number"}
register("percentage_add", PERCENT, lambda amount, percentage: amount + amount * percentage, aliases={"base_amount": "amount", "base": "amount", "percent": "percentage"})
register("percentage_deduct", PERCENT, lambda amount, percentage: amount - amount * percentage, aliases={"base_amount": "amount", "total_amount": "amount", "percent": "percentage"})
register(
    "proportional_allocator",
    {"total_amount": "number", "individual_value": "number", "total_value": "number"},
    lambda total_amount, individual_value, total_value: F.when(total_value == 0, F.lit(0.0)).otherwise(F.try_divide(total_amount * individual_value, total_value)),
    aliases={"individual": "individual_value", "total": "total_value"},
)


def time_between(start_datetime: Column, finish_datetime: Column, units: Column | None = None, workday: Column | None = None, part: Column | None = None) -> Column:
    """Whole seconds between two RFC 3339 times, in seconds, minutes or hours (default).

    With ``workday`` ({"hours": h, "minutes": m}) a boundary lies at that time on the start's date, or on the next day
    if that isn't after the start; ``part`` time_before or time_after gives the share before or after it.
    """
    start, finish = F.to_timestamp(start_datetime), F.to_timestamp(finish_datetime)
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b).cast("double")
    total = seconds(start, finish)
    if workday is not None:
        at = lambda k: F.coalesce(F.get_json_object(workday, f"$.{k}").try_cast("int"), F.lit(0))
        edge = F.timestamp_add("SECOND", at("hours") * 3600 + at("minutes") * 60, F.date_trunc("day", start))
        edge = F.when(edge <= start, F.timestamp_add("DAY", F.lit(1), edge)).otherwise(edge)
        edge = F.least(F.greatest(edge, start), finish)
        total = F.when(part == "time_before", seconds(start, edge)).when(part == "time_after", seconds(edge, finish)).otherwise(total)
    by = F.lit(3600.0) if units is None else F.when(units == "seconds", F.lit(1.0)).when(units == "minutes", F.lit(60.0)).otherwise(F.lit(3600.0))
    return total / by


TIMES = {"start_datetime": "any", "finish_datetime": "any", "units": "string", "workday": "string", "part": "string"}
register("time_between_datetime", TIMES, time_between, ("units", "workday", "part"), aliases={"start_field": "start_datetime", "finish_field": "finish_datetime", "start": "start_datetime", "finish": "finish_datetime", "unit": "units"})
register(
    "weighted_average",
    {"items": "array"},
    lambda items: F.aggregate(
        items, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), lambda s, x: F.struct((s["v"] + x["value"].cast("double") * x["weight"].cast("double")).alias("v"), (s["w"] + x["weight"].cast("double")).alias("w")), lambda s: F.when(s["w"] == 0, F.lit(0.0)).otherwise(F.try_divide(s["v"], s["w"]))
    ),
)
LIMITS = {"value": "number", "min": "number", "max": "number"}
register("limit_validator", LIMITS, lambda value, min, max: (value >= min) & (value <= max), gives="boolean", aliases={"min_limit": "min", "max_limit": "max"})
register("threshold_check", {"value": "number", "threshold": "number"}, lambda value, threshold: value > threshold, gives="boolean", aliases={"limit": "threshold"})
register(
    "limit_validate",
    {"value": "number", "warning_threshold": "number", "critical_threshold": "number", "max_threshold": "number"},
    lambda value, warning_threshold, critical_threshold, max_threshold: F.when(value > max_threshold, "Breach").when(value >= critical_threshold, "Critical").when(value >= warning_threshold, "Warning").otherwise("Ok"),
    gives="string",
    aliases={"warning": "warning_threshold", "critical": "critical_threshold", "max": "max_threshold"},
)


def threshold_violation(value: Column, threshold: Column, operator: Column) -> Column:
    """{passes, status, violation_amount} of a comparison named by ``operator``."""
    ops = {"LessThanOrEqual": value <= threshold, "LessThan": value < threshold, "GreaterThanOrEqual": value >= threshold, "GreaterThan": value > threshold, "Equal": value == threshold}
    first, *rest = ops.items()
    ok = reduce(lambda w, x: w.when(operator == x[0], x[1]), rest, F.when(operator == first[0], first[1]))
    return F.struct(ok.alias("passes"), F.when(ok, "Ok").otherwise("Breach").alias("status"), F.when(ok, F.lit(0.0)).otherwise(F.abs(value - threshold)).alias("violation_amount"))


register("threshold_violation", {"value": "number", "threshold": "number", "operator": "string"}, threshold_violation, gives="object")
register("apply_percentage", {"amount": "number", "percentage": "number"}, lambda amount, percentage: amount * percentage)
register("apply_flat", {"amount": "number", "flat": "number"}, lambda amount, flat: amount + flat)


def tiered_rate(amount: Column, tiers: list[tuple[float, float]]) -> Column:
    """Rate of the highest threshold that ``amount`` reaches; 0 below all."""
    order = sorted(tiers, reverse=True)
    out = reduce(lambda w, t: w.when(amount >= t[0], F.lit(float(t[1]))), order[1:], F.when(amount >= order[0][0], F.lit(float(order[0][1]))))
    return out.otherwise(F.lit(0.0))


def conditional_rate(key: Column, rates: dict[str, float], default: float = 0.0) -> Column:
    """Rate by key."""
    table = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit(float(default)))
