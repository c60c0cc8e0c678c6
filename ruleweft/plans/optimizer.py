"""Order of a rule's conditions by estimated selectivity and cost.

Conjuncts inside one filter are evaluated in the order they are written, so the order is set when rules compile.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from ruleweft.functions.values import literal_kind
from ruleweft.model import All, AnyOf, NoneOf, Rule, Test

#: Estimated shares of facts that pass, and costs, by kind of test. Fixed values.
EQUAL = {"boolean": 0.5, "integer": 0.2, "float": 0.15, "short": 0.3, "long": 0.1}
RANGE, OR_EQUAL, TEXT, OTHER = 0.4, 0.5, 0.3, 0.5


def selectivity(c) -> float:
    if isinstance(c, Test):
        if c.op in ("eq", "ne"):
            k = literal_kind(c.value)
            name = {"number": "integer" if isinstance(c.value, int) else "float", "string": "long" if isinstance(c.value, str) and len(c.value) > 10 else "short"}.get(k, k)
            s = EQUAL.get(name, OTHER)
            return s if c.op == "eq" else 1 - s
        return RANGE if c.op in ("gt", "lt") else OR_EQUAL if c.op in ("ge", "le") else TEXT
    if isinstance(c, All):
        out = 1.0
        for x in c.conditions:
            out *= selectivity(x)
        return out
    if isinstance(c, AnyOf):
        return min(1.0, sum(map(selectivity, c.conditions)))
    if isinstance(c, NoneOf):
        return max(0.0, 1 - min(1.0, sum(map(selectivity, c.conditions))))
    return OTHER


def cost(c) -> float:
    if isinstance(c, Test):
        return {"eq": 1.0, "ne": 1.0, "gt": 2.0, "lt": 2.0, "ge": 2.0, "le": 2.0}.get(c.op, 5.0)
    if isinstance(c, (All, NoneOf)):
        return sum(map(cost, c.conditions))
    if isinstance(c, AnyOf):
        return 0.5 * sum(map(cost, c.conditions))
    return 10.0


def expected_cost(conditions: tuple) -> float:
    """Cost of a conjunction that stops at the first false condition."""
    out, reach = 0.0, 1.0
    for c in conditions:
        out += reach * cost(c)
        reach *= selectivity(c)
        if reach < 0.01:
            break
    return out


@dataclass(frozen=True)
class Optimized:
    rule: Rule
    before: float
    after: float

    @property
    def gain(self) -> float:
        return 0.0 if not self.before else 1 - self.after / self.before


def optimize(rule: Rule) -> Optimized:
    """The rule with its conditions by (1 - selectivity) per cost, if that lowers the expected cost."""
    best = tuple(sorted(rule.conditions, key=lambda c: cost(c) / max(1e-9, 1 - selectivity(c))))
    before, after = expected_cost(rule.conditions), expected_cost(best)
    return Optimized(dataclasses.replace(rule, conditions=best), before, after) if after < before else Optimized(rule, before, before)


def shared(rules: list[Rule]) -> dict:
    """Conditions that more than one rule has."""
    by: dict = {}
    for r in rules:
        for c in r.conditions:
            by.setdefault(c, []).append(r.id)
    return {c: ids for c, ids in by.items() if len(ids) > 1}
