"""Rules as data: conditions, actions and rules, with a JSON form."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

OPERATORS = ("eq", "ne", "gt", "lt", "ge", "le", "contains", "starts_with", "ends_with")
AGGREGATES = ("count", "sum", "avg", "min", "max", "stddev", "percentile")
#: Aggregates that users registered, by name.
CUSTOM_AGGREGATES: dict[str, Any] = {}
CHANNELS = ("email", "sms", "push", "webhook", "slack", "teams", "in_app")


class RuleError(ValueError):
    """A rule that can't be compiled; ``kind`` says why."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Test:
    """One field against a literal. A missing field satisfies ``ne`` only."""

    __test__ = False  # not a test case for pytest
    field: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise RuleError("condition", f"unknown operator {self.op!r}")


@dataclass(frozen=True)
class All:
    """Every condition holds; true if there are none."""

    conditions: tuple = ()


@dataclass(frozen=True)
class AnyOf:
    """Some condition holds; false if there are none."""

    conditions: tuple = ()


@dataclass(frozen=True)
class NoneOf:
    """No condition holds; false if there are none."""

    conditions: tuple = ()


@dataclass(frozen=True)
class Frame:
    """Which facts an aggregate sees: kind time (ms), last (facts), block (facts) or session (gap in ms)."""

    kind: str
    size: int

    def __post_init__(self) -> None:
        if self.kind not in ("time", "last", "block", "session") or self.size <= 0:
            raise RuleError("condition", f"unknown frame {self.kind} of {self.size}")


@dataclass(frozen=True)
class Aggregate:
    """An aggregate over the facts of the trigger's group, with an optional condition on its alias.

    Without ``having`` it holds if any fact of the group has the source field.
    """

    function: str
    source: str
    alias: str
    group_by: tuple[str, ...] = ()
    having: Any = None
    filter: Any = None
    frame: Frame | None = None
    percent: float | None = None

    def __post_init__(self) -> None:
        if self.function not in AGGREGATES and self.function not in CUSTOM_AGGREGATES:
            raise RuleError("condition", f"unknown aggregate {self.function!r}")
        if self.function == "percentile" and not 0 <= (self.percent if self.percent is not None else -1) <= 100:
            raise RuleError("condition", "a percentile needs percent from 0 to 100")


@dataclass(frozen=True)
class StreamTest:
    """Facts that lie in event-time windows whose aggregate satisfies ``having``."""

    window: Any
    function: str
    source: str | None
    alias: str
    having: Any
    filter: Any = None
    group_by: tuple[str, ...] = ()
    percent: float | None = None


@dataclass(frozen=True)
class SetField:
    field: str
    value: Any


@dataclass(frozen=True)
class Log:
    message: str


@dataclass(frozen=True)
class LogTemplate:
    """``{}`` in the template stand for the fields, in order."""

    template: str
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Alert:
    type: str
    message: str
    severity: str = "medium"
    metadata: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class UpdateFact:
    id_field: str
    updates: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class DeleteFact:
    id_field: str


@dataclass(frozen=True)
class Increment:
    field: str
    by: int | float


@dataclass(frozen=True)
class Append:
    field: str
    value: Any


@dataclass(frozen=True)
class Notify:
    recipient: str
    channel: str
    subject: str
    message: str = ""
    metadata: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.channel not in CHANNELS:
            raise RuleError("action", f"unknown channel {self.channel!r}")


@dataclass(frozen=True)
class CreateFact:
    """A new fact; ``{{name}}`` as a whole value takes the trigger's field."""

    data: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Calculate:
    calculator: str
    inputs: dict = field(default_factory=dict, hash=False)
    output: str = "result"


@dataclass(frozen=True)
class Formula:
    output: str
    expression: str


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    conditions: tuple = ()
    actions: tuple = ()
    priority: int = 0
    salience: int = 0
    enabled: bool = True
    tags: tuple[str, ...] = ()


KINDS = {c.__name__: c for c in (Test, All, AnyOf, NoneOf, Frame, Aggregate, StreamTest, SetField, Log, LogTemplate, Alert, UpdateFact, DeleteFact, Increment, Append, Notify, CreateFact, Calculate, Formula, Rule)}


def to_plain(x: Any) -> Any:
    """JSON-ready form; dataclasses carry their name as ``is``."""
    if dataclasses.is_dataclass(x):
        return {"is": type(x).__name__} | {f.name: to_plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, (list, tuple)):
        return [to_plain(v) for v in x]
    if isinstance(x, dict):
        return {k: to_plain(v) for k, v in x.items()}
    return x


def from_plain(x: Any) -> Any:
    if isinstance(x, dict) and x.get("is") in KINDS:
        return KINDS[x["is"]](**{k: from_plain(v) for k, v in x.items() if k != "is"})
    if isinstance(x, dict):
        return {k: from_plain(v) for k, v in x.items()}
    return tuple(from_plain(v) for v in x) if isinstance(x, list) else x


def dumps(rules: list[Rule]) -> str:
    return json.dumps([to_plain(r) for r in rules])


def loads(text: str) -> list[Rule]:
    return list(from_plain(json.loads(text)))


def tests(condition: Any) -> list[Test]:
    """All leaves of a condition tree."""
    if isinstance(condition, Test):
        return [condition]
    if isinstance(condition, (All, AnyOf, NoneOf)):
        return [t for c in condition.conditions for t in tests(c)]
    return []


def fields(condition: Any) -> set[str]:
    """Fields that a condition reads."""
    if isinstance(condition, (Aggregate, StreamTest)):
        own = {condition.source, *condition.group_by} - {None}
        return own | (fields(condition.filter) if condition.filter is not None else set())
    return {t.field for t in tests(condition)}
