"""Rule sets over DataFrames of facts: compiled to one pass, with lookups for rules that test equality only.

Rules whose only condition is an equality, and whose actions don't read the fact, are rows of a small table that is
joined on the field: work follows the facts, not the rules. All others become predicates in one projection, a bit for
each rule; only where some bit of a chunk is set is there an array of that chunk's matches, and what is exploded is the
arrays' concatenation. Aggregates are grouped once and joined back as flags; equal ones are shared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from operator import or_
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweft.functions import values as V
from ruleweft.model import Aggregate, Alert, All, CreateFact, DeleteFact, Log, Notify, Rule, RuleError, SetField, StreamTest, Test, UpdateFact
from ruleweft.operators.actions import FIRING, FIRING_TYPE, firing, literal_firing, ordered
from ruleweft.operators.aggregates import attach, attach_framed
from ruleweft.operators.predicates import Resolver, compile_rule, prefilter, resolver
from ruleweft.plans import changes
from ruleweft.plans.optimizer import optimize
from ruleweft.sources.ragged import fold, widen

#: Rules on one field from which the lookup table is used, and predicates in one chunk of bits.
INDEX_FROM, CHUNK = 8, 32
#: Rules from which generated methods may outgrow what the JVM compiles (8,000 bytes); Spark then splits them, if told so.
MANY, METHOD_BYTES = 16, 8000
#: Rules up to which what any of them needs becomes a filter of the scan.
NARROW_MOST = 16
#: Rules up to which a lookup table is broadcast; larger tables are joined by a shuffle of both sides.
BROADCAST_RULES = 100_000
FIRING_STRUCT = f"struct<rule_id:bigint,action_seq:int,kind:string,field:string,value:{V.CELL},message:string,target_fact_id:bigint,extra:map<string,string>>"
COLUMNS = ["rule_id", "fact_id", "action_seq", "kind", "field", "value", "message", "target_fact_id", "extra"]
LITERAL = (SetField, Log, Alert, Notify)


def indexable(rule: Rule, facts: DataFrame) -> str | None:
    """The field by which a rule can be looked up."""
    if len(rule.conditions) != 1 or not isinstance(t := rule.conditions[0], Test) or t.op != "eq" or t.value is None:
        return None
    if t.field not in facts.columns or not all(isinstance(a, LITERAL) for a in rule.actions):
        return None
    k = V.kind(facts.schema[t.field].dataType)
    if V.is_cell(facts.schema[t.field].dataType):
        return t.field if isinstance(t.value, str) else None
    return t.field if k == V.literal_kind(t.value) and k in ("string", "number", "boolean") else None


def collect_special(condition: Any) -> list[Any]:
    if isinstance(condition, (Aggregate, StreamTest)):
        return [condition]
    return [x for c in getattr(condition, "conditions", ()) for x in collect_special(c)]


def narrow(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Facts that some rule may match, by conditions that reach the scan; all of them if a rule has no such condition."""
    if not 0 < len(rules) <= NARROW_MOST:
        return facts
    own = [prefilter(All(r.conditions), resolver(facts.schema)) if r.conditions else F.lit(False) for r in rules]
    return facts if any(c is None for c in own) else facts.where(reduce(or_, own))


def exploded(facts: DataFrame, holds: list[Column], payloads: list[Column], kind: str, keep: list[Column], name: str) -> DataFrame:
    """``keep`` and the payload (of type ``kind``) of each rule that holds: one row for each match."""
    if len(holds) == 1:
        return facts.where(holds[0]).select(*keep, payloads[0].alias(name))
    limit = "spark.sql.codegen.hugeMethodLimit"
    if len(holds) >= MANY and int(facts.sparkSession.conf.get(limit)) > METHOD_BYTES:
        facts.sparkSession.conf.set(limit, str(METHOD_BYTES))
    chunks = [range(i, min(i + CHUNK, len(holds))) for i in range(0, len(holds), CHUNK)]
    bit = lambda i: F.lit(1 << i % CHUNK).cast("bigint")
    none = F.lit(0).cast("bigint")
    masks = [reduce(lambda x, y: x.bitwiseOR(y), (F.when(holds[i], bit(i)).otherwise(none) for i in own)) for own in chunks]
    marked = facts.select("*", *(m.alias(f"_bits{k}") for k, m in enumerate(masks)))
    parts = []
    for k, own in enumerate(chunks):
        bits = F.col(f"_bits{k}")
        found = F.array(*(F.when(bits.bitwiseAND(bit(i)) != 0, payloads[i]) for i in own))
        parts.append(F.when(bits != 0, found).otherwise(F.array().cast(f"array<{kind}>")))
    every = parts[0] if len(parts) == 1 else F.concat(*parts)
    # rows that didn't match are dropped after the explosion: all of it stays in generated code, lambdas would not
    return marked.select(*keep, F.explode(every).alias(name)).where(F.col(name).isNotNull())


class Engine:
    """Rules by id, in a session of their own; compiled against a table's schema when they are evaluated."""

    def __init__(self, rules: Iterable[Rule] = (), fact_id: str = "fact_id", mode: str = "rule", constants: dict[str, Any] | None = None) -> None:
        """``constants`` stand in for fields that the facts lack, in conditions and actions alike."""
        self.fact_id, self.mode, self.constants = fact_id, mode, constants or {}
        self.rules: dict[int, Rule] = {}
        self.add(*rules)

    def add(self, *rules: Rule) -> None:
        for r in rules:
            if r.id in self.rules:
                raise RuleError("rule", f"rule {r.id} exists; use update")
            self.rules[r.id] = r

    def update(self, rule: Rule) -> None:
        self.remove(rule.id)
        self.rules[rule.id] = rule

    def remove(self, rule_id: int) -> Rule:
        if rule_id not in self.rules:
            raise RuleError("rule", f"rule {rule_id} not found")
        return self.rules.pop(rule_id)

    def enabled(self) -> list[Rule]:
        return [r for r in self.rules.values() if r.enabled]

    def resolver(self, df: DataFrame) -> Resolver:
        return resolver(df.schema, self.constants)

    def validate(self, facts: DataFrame) -> list[RuleError]:
        """What can't be compiled against the facts' schema."""
        out = []
        for r in self.rules.values():
            try:
                compile_rule(r.conditions, self.resolver(facts), lambda c: F.lit(True))
                for seq, a in ordered(r.actions):
                    firing(r.id, seq, a, self.resolver(facts))
            except RuleError as e:
                out.append(e)
        return out

    def _flags(self, facts: DataFrame, history: DataFrame | None, rules: list[Rule], narrowed: bool = True) -> tuple[DataFrame, dict[Any, str]]:
        """``facts`` that some rule may match, with a flag for each aggregate and stream condition."""
        special = list(dict.fromkeys(x for r in rules for c in r.conditions for x in collect_special(c)))
        flags = {c: f"_flag{i}" for i, c in enumerate(special)}
        store = facts if history is None else history.unionByName(facts, allowMissingColumns=True)
        for c in special:  # frames need all facts in place
            if isinstance(c, Aggregate) and c.frame is not None:
                facts = attach_framed(facts, history, c, flags[c], self.mode)
        if narrowed:
            facts = narrow(facts, rules)
        for c in special:
            if isinstance(c, Aggregate) and c.frame is None:
                facts = attach(facts, store, c, flags[c], self.mode)
            elif isinstance(c, StreamTest):
                from ruleweft.streaming.windows import attach_stream

                facts = attach_stream(facts, store, c, flags[c])
        return facts, flags

    def _holds(self, rule: Rule, resolve: Resolver, flags: dict[Any, str]) -> Column:
        """A rule's condition, cheap and selective tests first: conjuncts are evaluated in the order they are written."""
        return compile_rule(optimize(rule).rule.conditions, resolve, lambda c: F.col(flags[c]))

    def matches(self, facts: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(rule_id, fact_id) of every match."""
        rules = self.enabled()
        facts, flags = self._flags(facts, history, rules)
        resolve = self.resolver(facts)
        if not rules:
            return facts.sparkSession.createDataFrame([], "rule_id bigint, fact_id bigint")
        out = exploded(facts, [self._holds(r, resolve, flags) for r in rules], [F.lit(r.id).cast("bigint") for r in rules], "bigint", [F.col(self.fact_id).cast("bigint").alias("fact_id")], "rule_id")
        return out.select("rule_id", "fact_id")

    def apply(self, facts: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """``facts`` after all rules' actions on them; facts that rules create are not in it (see ``creations``)."""
        rules = [r for r in self.enabled() if r.actions]
        columns = facts.columns
        base, flags = self._flags(facts, history, rules, narrowed=False)
        resolve = self.resolver(base)
        return changes.applied(base, columns, rules, {r.id: self._holds(r, resolve, flags) for r in rules}, resolve, self.fact_id)

    def creations(self, facts: DataFrame, history: DataFrame | None = None, first_id: int = 1 << 40) -> DataFrame | None:
        """Facts that rules create, with ids from ``first_id`` on; their types follow from the rules."""
        rules = [r for r in self.enabled() if any(isinstance(a, CreateFact) for a in r.actions)]
        base, flags = self._flags(facts, history, rules)
        resolve = self.resolver(base)
        return changes.created(base, rules, {r.id: self._holds(r, resolve, flags) for r in rules}, resolve, self.fact_id, first_id)

    def evaluate_ragged(self, facts: DataFrame, history: DataFrame | None = None, cells: str = "fields") -> DataFrame:
        """All firings over ragged facts, whose fields are a map of tagged cells."""
        rules = self.enabled()
        return self.evaluate(widen(facts, rules, cells), None if history is None else widen(history, rules, cells))

    def apply_ragged(self, facts: DataFrame, history: DataFrame | None = None, cells: str = "fields") -> DataFrame:
        """Ragged facts after all rules' actions on them."""
        rules = self.enabled()
        return fold(self.apply(widen(facts, rules, cells), None if history is None else widen(history, rules, cells)), cells)

    def statistics(self, firings: DataFrame) -> DataFrame:
        """Real counters: rules, enabled rules, firings, facts and rules that fired."""
        return firings.agg(
            F.lit(len(self.rules)).cast("bigint").alias("rules"), F.lit(len(self.enabled())).cast("bigint").alias("enabled"), F.count("*").alias("firings"),
            F.count_distinct("fact_id").alias("facts_fired"), F.count_distinct("rule_id").alias("rules_fired"),
        )

    def local(self) -> bool:
        """True if all rules read and change one fact at a time: what they do to facts is a projection."""
        far = lambda a: isinstance(a, CreateFact) or isinstance(a, (UpdateFact, DeleteFact)) and a.id_field != self.fact_id
        return not any(collect_special(c) for r in self.enabled() for c in r.conditions) and not any(far(a) for r in self.enabled() for a in r.actions)

    def evaluate(self, facts: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """All firings: one row for each action of each match. Aggregates see ``history`` and ``facts``."""
        spark = facts.sparkSession
        rules = [r for r in self.enabled() if r.actions]
        by_field: dict[str, list[Rule]] = defaultdict(list)
        for r in rules:
            if f := indexable(r, facts):
                by_field[f].append(r)
        by_field = {f: rs for f, rs in by_field.items() if len(rs) >= INDEX_FROM}
        looked_up = {r.id for rs in by_field.values() for r in rs}
        rest = [r for r in rules if r.id not in looked_up]
        plain = [r for r in rest if all(isinstance(a, LITERAL) for a in r.actions)]
        # many rules of either sort are worth a pass of their own: the plain ones' matches are just numbers
        groups = [plain, [r for r in rest if r not in plain]] if len(plain) >= MANY else [rest]
        out = [self._lookup(spark, facts, by_field)] if by_field else []
        out += [self._one_pass(facts, history, g) for g in groups if g]
        return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], FIRING)

    def _one_pass(self, facts: DataFrame, history: DataFrame | None, rules: list[Rule]) -> DataFrame:
        facts, flags = self._flags(facts, history, rules)
        resolve = self.resolver(facts)
        holds, keep = [self._holds(r, resolve, flags) for r in rules], [F.col(self.fact_id).cast("bigint").alias("fact_id")]
        if len(rules) >= MANY and all(isinstance(a, LITERAL) for r in rules for a in r.actions):
            # what doesn't read the fact comes from a table of the rules, bounded by their number
            fired = exploded(facts, holds, [F.lit(r.id).cast("bigint") for r in rules], "bigint", keep, "_rule")
            table = pa.table({"_id": pa.array([r.id for r in rules], pa.int64()), "_fired": pa.array([[literal_firing(r.id, seq, a) for seq, a in ordered(r.actions)] for r in rules], pa.list_(FIRING_TYPE))})
            own = facts.sparkSession.createDataFrame(table)
            return fired.join(F.broadcast(own) if len(rules) <= BROADCAST_RULES else own, F.col("_rule") == F.col("_id")).select("fact_id", F.inline("_fired")).select(*COLUMNS)
        single = all(len(r.actions) == 1 for r in rules)
        rows = [[firing(r.id, seq, a, resolve) for seq, a in ordered(r.actions)] for r in rules]
        kind = FIRING_STRUCT if single else f"array<{FIRING_STRUCT}>"
        fired = exploded(facts, holds, [r[0] if single else F.array(*r) for r in rows], kind, keep, "_fired")
        return (fired.select("fact_id", "_fired.*") if single else fired.select("fact_id", F.inline("_fired"))).select(*COLUMNS)

    def _lookup(self, spark: SparkSession, facts: DataFrame, by_field: dict[str, list[Rule]]) -> DataFrame:
        """Facts meet the tables of rules by hash joins; sides of up to ``BROADCAST_RULES`` rules are broadcast."""
        cell = {f: V.is_cell(facts.schema[f].dataType) for f in by_field}
        wide, arrays = facts.select(F.col(self.fact_id).cast("bigint").alias("fact_id"), *((F.col(f"`{f}`")["s"] if cell[f] else F.col(f"`{f}`")).alias(f) for f in by_field)), []
        for i, (f, rules) in enumerate(by_field.items()):
            by_value: dict[Any, list[dict]] = defaultdict(list)
            for r in rules:
                by_value[r.conditions[0].value] += [literal_firing(r.id, seq, a) for seq, a in ordered(r.actions)]
            rows = pa.table({"k": pa.array(list(by_value)), "v": pa.array(list(by_value.values()), pa.list_(FIRING_TYPE))})
            table = spark.createDataFrame(rows).select(F.col("k").cast("string" if cell[f] else facts.schema[f].dataType).alias(f"_k{i}"), F.col("v").alias(f"_v{i}"))
            wide = wide.join(F.broadcast(table) if len(rules) <= BROADCAST_RULES else table, F.col(f"`{f}`") == F.col(f"_k{i}"), "left")
            arrays.append(F.col(f"_v{i}"))
        fired = arrays[0] if len(arrays) == 1 else F.flatten(F.array_compact(F.array(*arrays)))
        return wide.select("fact_id", F.inline(fired)).select(*COLUMNS)

    def created(self, firings: DataFrame, schema: str, first_id: int) -> DataFrame:
        """Facts that firings create, with ids from ``first_id`` on; ``schema``: DDL of their fields."""
        from ruleweft.operators.frames import positions

        rows = firings.where("kind = 'fact_created'").select("rule_id", "fact_id", "action_seq", F.from_json(F.col("extra")["data"], schema).alias("data"))
        return positions(rows, ["rule_id", "fact_id", "action_seq"]).select((F.col("_pos") + first_id).cast("bigint").alias("fact_id"), "data.*")

    def explain_firing(self, facts: DataFrame, fact_id: int) -> DataFrame:
        """For one fact, each rule's conditions and whether they hold."""
        facts, flags = self._flags(facts, None, self.enabled(), narrowed=False)
        facts, resolve = facts.where(F.col(self.fact_id) == fact_id), self.resolver(facts)
        rows = [
            F.struct(F.lit(r.id).alias("rule_id"), F.lit(i).alias("condition"), F.lit(str(c)).alias("text"), compile_rule((c,), resolve, lambda x: F.col(flags[x])).alias("holds"))
            for r in self.enabled()
            for i, c in enumerate(r.conditions)
        ]
        return facts.select(F.inline(F.array(*rows)))


def evaluate(rules: Iterable[Rule], facts: DataFrame, **options) -> DataFrame:
    """One-shot evaluation."""
    return Engine(rules, **options).evaluate(facts)


def retracted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Firings that a change of facts took away."""
    keys = ["rule_id", "fact_id", "action_seq"]
    return before.select(*keys).exceptAll(after.select(*keys))


def apply(facts: DataFrame, rules: Iterable[Rule], **options) -> DataFrame:
    """``facts`` after the actions of ``rules``, in one shot."""
    return Engine(rules, **options).apply(facts)


def top_rules(firings: DataFrame, n: int = 10) -> DataFrame:
    """The rules that fired for most facts, with how many."""
    counts = firings.groupBy("rule_id").agg(F.count_distinct("fact_id").alias("facts"), F.count("*").alias("actions"))
    return counts.orderBy(F.desc("facts"), "rule_id").limit(n)
