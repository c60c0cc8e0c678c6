"""Stages of rules in order of their dependencies; what one stage makes, the next one sees."""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleweft.functions import values as V
from ruleweft.model import Rule, RuleError
from ruleweft.plans.engine import Engine
from ruleweft.sources.shared import durable


@dataclass(frozen=True)
class Stage:
    """Rules that run together, after the stages that ``after`` names."""

    name: str
    rules: tuple[Rule, ...]
    after: tuple[str, ...] = ()


def ordered(stages: list[Stage]) -> list[Stage]:
    by = {s.name: s for s in stages}
    if missing := {a for s in stages for a in s.after} - set(by):
        raise RuleError("pipeline", f"unknown stages {sorted(missing)}")
    try:
        return [by[n] for n in TopologicalSorter({s.name: s.after for s in stages}).static_order()]
    except CycleError as e:
        raise RuleError("pipeline", f"circular dependency: {e.args[1]}") from e


def latest(facts: DataFrame, key: str = "fact_id", order: str = "event_ts") -> DataFrame:
    """One fact for each key: the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def run(stages: list[Stage], facts: DataFrame, checkpoint: bool | None = None, first_id: int = 1 << 40, constants: dict[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
    """The facts after all stages and every firing, with the stage's name.

    Fields that a stage adds, and facts that it creates, are there for the next ones. ``constants`` are the same in all
    stages. Stages that change one fact at a time add a projection to the plan; after any other stage lineage is cut, so
    each stage adds a scan, not a factor. ``checkpoint`` cuts it after all stages (True) or none (False).
    """
    fired = None
    for s in ordered(stages):
        engine = Engine(s.rules, constants=constants)
        own = engine.evaluate(facts).withColumn("stage", F.lit(s.name))
        fired = own if fired is None else fired.unionByName(own)
        made = engine.creations(facts, first_id=first_id)
        facts = engine.apply(facts)
        if made is not None:
            facts, first_id = widened(facts, made), first_id + made.count()
        if checkpoint or checkpoint is None and not engine.local():
            facts = durable(facts)
    return facts, fired


def widened(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables' rows; a field of two types gets the one that holds both."""
    types = {n: V.unified([d.schema[n].dataType for d in (a, b) if n in d.columns]) for n in [*a.columns, *b.columns]}
    cast = lambda d: d.select(*(V.converted(F.col(f"`{n}`"), d.schema[n].dataType, types[n]).alias(n) for n in d.columns))
    return cast(a).unionByName(cast(b), allowMissingColumns=True)


def to_fixpoint(engine: Engine, facts: DataFrame, most: int = 10, first_id: int = 1 << 40) -> tuple[DataFrame, int]:
    """Evaluates created facts again until none are new; all facts and the rounds taken.

    Raises if facts still appear after ``most`` rounds. Created facts with equal fields count as one. Each round is
    checkpointed.
    """
    fresh = facts
    for i in range(most + 1):
        made = engine.creations(fresh, first_id=first_id)
        if made is None:
            return facts, i
        names = [n for n in made.columns if n != engine.fact_id]
        made = made.dropDuplicates(names)
        have = facts.select(*((F.col(f"`{n}`") if n in facts.columns else F.lit(None).cast(made.schema[n].dataType)).alias(f"_{n}") for n in names))
        new = durable(made.join(have, [F.col(f"`{n}`").eqNullSafe(F.col(f"`_{n}`")) for n in names], "left_anti"))
        top = new.agg(F.max(engine.fact_id)).first()[0]
        if top is None:
            return facts, i
        if i == most:
            raise RuleError("pipeline", f"facts are still created after {most} rounds")
        first_id = top + 1
        facts, fresh = durable(widened(facts, new)), widened(facts.limit(0), new)
    return facts, most
