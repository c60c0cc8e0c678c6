"""Group aggregates in three modes that differ at the edges, and conditions on them without a self-join per fact.

``rule``: non-numbers are ignored, count counts facts that have the field, empty groups give 0 or an infinity.
``strict``: every fact must have the field (strings that parse are numbers), percentiles take the floor index, an
empty group is NULL. ``lazy``: like ``rule``, but count counts numbers only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweft.functions import values as V
from ruleweft.model import AGGREGATES, CUSTOM_AGGREGATES, Aggregate, RuleError
from ruleweft.operators.frames import framed
from ruleweft.operators.predicates import compile_condition, resolver

MODES = ("rule", "strict", "lazy")


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """Adds an aggregate to rules: ``build`` makes an aggregate Column of a double Column (a composition of built-in
    aggregates, or a grouped-aggregate pandas UDF)."""
    if name in AGGREGATES:
        raise RuleError("aggregate", f"'{name}' is built in")
    CUSTOM_AGGREGATES[name] = build


def value(function: str, c: Column, t: T.DataType, mode: str = "rule", percent: float | None = None, over=None) -> Column:
    """The aggregate of a column, over a window if one is given."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    at = (lambda a: a) if over is None else (lambda a: a.over(over))
    x = V.number(c, t)
    if mode == "strict":
        x = c.cast("double") if V.kind(t) in ("number", "string") else F.raise_error(F.lit("Field is not numeric")).cast("double")
        x = F.when(c.isNull(), F.raise_error(F.lit("Field is missing")).cast("double")).otherwise(x)
    if function in CUSTOM_AGGREGATES:
        return at(CUSTOM_AGGREGATES[function](x))
    inf = float("inf")
    if function == "count":
        return at(F.count(c if mode == "rule" else x))
    if function == "percentile" and mode == "strict":
        xs = F.array_sort(at(F.collect_list(x)))
        return F.when(F.size(xs) > 0, F.element_at(xs, (F.floor(F.lit(float(percent) / 100) * (F.size(xs) - 1)) + 1).cast("int")))
    plain = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "percentile": lambda y: F.percentile(y, F.lit(float(percent) / 100))}[function]
    empty = {"min": inf, "max": -inf}.get(function, 0.0)
    return at(plain(x)) if mode == "strict" else F.coalesce(at(plain(x)), F.lit(empty))


def sample_variance(c: Column) -> tuple[Column, Column]:
    """Variance and standard deviation of a sample; 0 for fewer than two values."""
    return F.coalesce(F.var_samp(c), F.lit(0.0)), F.coalesce(F.stddev_samp(c), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def weighted_average(v: Column, w: Column) -> Column:
    """Of rows; 0 without weight."""
    return F.coalesce(F.when(F.sum(w) != 0, F.sum(v * w) / F.sum(w)), F.lit(0.0))


def grouped(df: DataFrame, spec: Aggregate, mode: str = "rule", first_only: bool = False) -> DataFrame:
    """The aggregate by group: filter, group, aggregate, having."""
    resolve = resolver(df.schema)
    if spec.filter is not None:
        df = df.where(compile_condition(spec.filter, resolve, first_only=first_only))
    keys = [F.col(f"`{k}`") if k in df.columns else F.lit(None).cast("string").alias(k) for k in spec.group_by]
    out = df.groupBy(*keys).agg(value(spec.function, *resolve(spec.source), mode, spec.percent).alias(spec.alias), F.count(resolve(spec.source)[0]).alias("_present"))
    return out.where(having(spec, out)).drop("_present")


def having(spec: Aggregate, df: DataFrame) -> Column:
    if spec.having is None:
        return F.col("_present") > 0
    return compile_condition(spec.having, resolver(df.schema))


def attach(facts: DataFrame, store: DataFrame, spec: Aggregate, flag: str, mode: str = "rule", with_value: bool = False) -> DataFrame:
    """``facts`` with a boolean column that says whether the aggregate over each fact's group in ``store`` qualifies.

    Grouped once and joined back on null-safe keys.
    """
    own = grouped(store, spec, mode)
    if not spec.group_by:
        got = own.select(F.lit(True).alias(flag), spec.alias)
        # one row at most
        out = facts.join(F.broadcast(got), F.lit(True), "left")
    else:
        got = own.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(spec.group_by)), F.lit(True).alias(flag), spec.alias)
        on = None
        for i, k in enumerate(spec.group_by):
            own_key = facts[k] if k in facts.columns else F.lit(None).cast("string")
            on = own_key.eqNullSafe(got[f"_k{i}"]) if on is None else on & own_key.eqNullSafe(got[f"_k{i}"])
        out = facts.join(got, on, "left").drop(*(f"_k{i}" for i in range(len(spec.group_by))))
    out = out.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out if with_value else out.drop(spec.alias)


def attach_framed(facts: DataFrame, history: DataFrame | None, spec: Aggregate, flag: str, mode: str = "rule") -> DataFrame:
    """The same for an aggregate over a frame, which is relative to the fact and uses window functions."""
    return framed(facts, history, spec, flag, lambda c, t, over=None: value(spec.function, c, t, mode, spec.percent, over))


def to_facts(groups: DataFrame, spec: Aggregate, target: str) -> DataFrame:
    """Aggregate rows as facts: target, aggregation_type, source_field, group_key and the value under ``target``."""
    key = F.concat_ws("|", *(F.col(f"`{k}`").cast("string") for k in spec.group_by)) if spec.group_by else F.lit("")
    return groups.select(key.alias("group_key"), F.lit(spec.function).alias("aggregation_type"), F.lit(spec.source).alias("source_field"), F.lit(target).alias("target"), F.col(spec.alias).alias(target))


def accumulate(df: DataFrame, c: str, by: list[str], order: list[str], reset: Column, function: str = "sum") -> DataFrame:
    """Running aggregate of ``c`` that starts anew at rows where ``reset`` holds, as ``accumulated``."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_run", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))
    w = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("accumulated", {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}[function](c).over(w)).drop("_run")
