"""A store of facts over DataFrames: scans, lookups, inserts, updates and deletes, each a plan and never in place."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.functions import values as V
from ruleweft.operators.frames import positions


class FactStore:
    """Immutable: changes return a new store."""

    def __init__(self, facts: DataFrame, fact_id: str = "fact_id", external_id: str = "external_id", event_ts: str = "event_ts") -> None:
        self.facts, self.fact_id, self.external_id, self.event_ts = facts, fact_id, external_id, event_ts

    def _new(self, facts: DataFrame) -> FactStore:
        return FactStore(facts, self.fact_id, self.external_id, self.event_ts)

    def scan(self) -> DataFrame:
        return self.facts

    def insert(self, more: DataFrame) -> FactStore:
        """Adds facts; those without an id get the ids after the highest one, in order of their time."""
        have = more.where(F.col(self.fact_id).isNotNull()) if self.fact_id in more.columns else more.limit(0).withColumn(self.fact_id, F.lit(None).cast("bigint"))
        lack = more.where(F.col(self.fact_id).isNull()).drop(self.fact_id) if self.fact_id in more.columns else more
        top = F.coalesce(self.facts.agg(F.max(self.fact_id)).scalar(), F.lit(0))
        order = [c for c in (self.event_ts, self.external_id) if c in lack.columns] or lack.columns[:1]
        numbered = positions(lack, order).withColumn(self.fact_id, (F.col("_pos") + top + 1).cast("bigint")).drop("_pos")
        return self._new(self.facts.unionByName(have, allowMissingColumns=True).unionByName(numbered, allowMissingColumns=True))

    def get(self, fact_id: int) -> DataFrame:
        return self.facts.where(F.col(self.fact_id) == fact_id)

    def by_external_id(self, external_id: str) -> DataFrame:
        return self.facts.where(F.col(self.external_id) == external_id)

    def field_of(self, external_id: str, field: str) -> DataFrame:
        return self.by_external_id(external_id).select(field)

    def find(self, **criteria: Any) -> DataFrame:
        """Facts whose fields all equal the given values."""
        out = self.facts
        for name, v in criteria.items():
            out = out.where(F.col(name).isNull() if v is None else F.col(name) == V.lit(v))
        return out

    def between(self, start, end) -> DataFrame:
        """Facts of a closed range of time."""
        return self.facts.where(F.col(self.event_ts).between(F.lit(start), F.lit(end)))

    def update(self, changes: DataFrame, nulls: bool = False) -> FactStore:
        """Takes the fields of ``changes`` by id; nulls count as no change unless ``nulls`` says that they are values."""
        names = [c for c in changes.columns if c != self.fact_id]
        new = changes.select(F.col(self.fact_id).alias("_id"), *(F.col(c).alias(f"_new_{c}") for c in names))
        out = self.facts.join(new, self.facts[self.fact_id] == new["_id"], "left")
        took = lambda c: F.when(F.col("_id").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"_new_{c}", c)
        return self._new(out.select(*(took(c).alias(c) if c in names else F.col(c) for c in self.facts.columns)))

    def delete(self, ids: DataFrame) -> FactStore:
        """Without the facts whose id is in ``ids``; unknown ids are ignored."""
        return self._new(self.facts.join(ids.select(self.fact_id).distinct(), self.fact_id, "left_anti"))

    def clear(self) -> FactStore:
        return self._new(self.facts.limit(0))

    def count(self) -> int:
        """Distinct facts."""
        return self.facts.select(self.fact_id).distinct().count()

    def is_empty(self) -> bool:
        return self.facts.isEmpty()

    def partitioned_by(self, *fields: str) -> FactStore:
        """Dealt by the fields that lookups use."""
        return self._new(self.facts.repartition(*fields))
