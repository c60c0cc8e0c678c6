"""Joins between facts: conditions across two facts, keys by name, and lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweft.functions import values as V
from ruleweft.model import RuleError

#: Pairs of names that mean the same id. Fixed values.
ID_PAIRS = (("customer_id", "id"), ("user_id", "id"), ("order_id", "id"), ("product_id", "id"))


@dataclass(frozen=True)
class JoinTest:
    """A field of the new fact against one of the earlier fact: op is eq, ne, gt, lt, ge or le."""

    field: str
    earlier: str
    op: str = "eq"


def _compare(a: Column, ta, b: Column, tb, op: str) -> Column:
    if op in ("eq", "ne"):
        same = F.coalesce(a == b, F.lit(False)) if V.compatible(V.kind(ta), V.kind(tb)) else F.lit(False)
        return same if op == "eq" else ~same & a.isNotNull() & b.isNotNull()
    if V.kind(ta) != "string" or V.kind(tb) != "string":
        a, b = V.comparable(a, ta), V.comparable(b, tb)
    return F.coalesce({"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b}[op], F.lit(False))


def join(facts: DataFrame, earlier: DataFrame, tests: list[JoinTest], how: str = "inner", prefix: str = "earlier_", product: bool = False) -> DataFrame:
    """Pairs of facts for which all tests hold; the earlier fact's columns get a prefix. Missing fields never match.

    Equalities become hash or merge keys; the other tests filter the pairs. Without an equality every pair has to be
    looked at, which only ``product`` allows.
    """
    if not product and all(t.op != "eq" for t in tests):
        raise RuleError("join", "no equality among the tests: every pair would be compared (product=True allows it)")
    right = earlier.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in earlier.columns))
    on = reduce(and_, (_compare(facts[t.field], facts.schema[t.field].dataType, right[f"{prefix}{t.earlier}"], earlier.schema[t.earlier].dataType, t.op) if t.op != "eq" else facts[t.field] == right[f"{prefix}{t.earlier}"] for t in tests))
    return facts.join(right, on, how)


def inferred(facts: DataFrame, earlier: DataFrame) -> list[JoinTest]:
    """Keys by name: equal names, else a pair that means the same id."""
    both = [JoinTest(c, c) for c in facts.columns if c in earlier.columns and c not in ("fact_id", "external_id", "event_ts")]
    return both or [JoinTest(a, b) for x, y in ID_PAIRS for a, b in ((x, y), (y, x)) if a in facts.columns and b in earlier.columns]


def join_any(facts: DataFrame, earlier: DataFrame, pairs: list[tuple[str, str]], fact_id: str = "fact_id") -> DataFrame:
    """Pairs of ids that agree in any of the field pairs: a union of equi-joins, without repeats."""
    out = None
    for a, b in pairs:
        got = facts.select(F.col(fact_id).alias("fact_id"), F.col(a).alias("_a")).join(earlier.select(F.col(fact_id).alias("earlier_id"), F.col(b).alias("_b")), F.col("_a") == F.col("_b")).select("fact_id", "earlier_id")
        out = got if out is None else out.unionByName(got)
    return out.dropDuplicates()


def lookup(facts: DataFrame, other: DataFrame, key: str, field: str, name: str, default=None, other_key: str = "fact_id") -> DataFrame:
    """A field of the fact that ``key`` names, as ``name``; ``default`` where there is none."""
    got = other.select(F.col(other_key).alias("_key"), F.col(field).alias(name)).dropDuplicates(["_key"])
    out = facts.join(got, facts[key] == F.col("_key"), "left").drop("_key")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))
