"""Rules, actions, aggregates, order, dependencies, pipelines, windows and the store on small facts."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from ruleweft import model as M
from ruleweft.model import Aggregate, All, AnyOf, Append, Calculate, CreateFact, DeleteFact, Frame, Increment, Log, NoneOf, Rule, RuleError, SetField, StreamTest, Test, UpdateFact
from ruleweft.operators import aggregates as A
from ruleweft.operators import conflict, frames, joins
from ruleweft.operators.predicates import compile_condition, resolver
from ruleweft.plans import dependency, optimizer
from ruleweft.plans.engine import Engine, apply, evaluate
from ruleweft.plans.pipeline import Stage, ordered, run, to_fixpoint
from ruleweft.sources import json_io
from ruleweft.sources.store import FactStore
from ruleweft.streaming import windows as W
from ruleweft.streaming.run import drain

PEOPLE = "fact_id bigint, name string, balance double, score bigint, tags array<string>, target bigint"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Alice", 1000.0, 50, ["active"], 1), (2, "Bob", 2000.0, 75, ["active"], 2), (3, "Charlie", 1500.0, None, None, None)], PEOPLE)


def ids(df) -> list[int]:
    return sorted(r["fact_id"] for r in df.collect())


def test_missing_fields_and_types(people):
    m = lambda *c: ids(Engine([Rule(1, "r", c)]).matches(people))
    assert m(Test("score", "gt", 0)) == [1, 2]
    assert m(Test("score", "ne", 50)) == [2, 3]
    assert m(NoneOf((Test("score", "gt", 60),))) == [1, 3]
    assert m(Test("nowhere", "eq", 1)) == [] and m(Test("nowhere", "ne", 1)) == [1, 2, 3]
    assert m(Test("score", "eq", 50.0)) == [1] and m(Test("score", "contains", "5")) == []
    assert m(Test("tags", "contains", "active")) == [1, 2] and m(Test("name", "lt", "B")) == [1]
    with pytest.raises(RuleError):
        m(Test("name", "gt", 1))


def test_actions(people):
    acts = (Increment("score", 10), Increment("balance", 500.5), Increment("fresh", 2), Append("tags", "premium"), UpdateFact("target", {"status": "x"}), DeleteFact("target"), CreateFact({"who": "{{name}}", "n": 1}), Log("done"), Calculate("add", {"a": "score", "b": 1.0}, "sum"), Calculate("nope", {}, "x"), Increment("name", 1))
    rows = {(r["fact_id"], r["action_seq"]): r for r in evaluate([Rule(1, "all", (Test("fact_id", "ge", 1),), acts)], people).collect()}
    kinds = [rows[1, i]["kind"] for i in range(len(acts))]
    assert kinds == ["field_incremented"] * 3 + ["array_appended", "fact_updated", "fact_deleted", "logged", "calculated", "logged", "logged", "fact_created"]
    assert rows[1, 0]["value"]["i"] == 60 and rows[3, 0]["value"]["i"] == 10 and rows[1, 1]["value"]["d"] == 1500.5 and rows[1, 2]["value"]["i"] == 2
    assert rows[1, 3]["extra"]["new_length"] == "2" and rows[3, 3]["extra"]["new_length"] == "1"
    assert rows[2, 4]["target_fact_id"] == 2 and rows[3, 4]["kind"] == "logged" and rows[2, 5]["target_fact_id"] == 2
    assert json.loads(rows[2, 10]["extra"]["data"]) == {"n": 1, "who": "Bob"}
    assert rows[1, 7]["value"]["d"] == 51.0 and rows[3, 7]["kind"] == "logged" and "not found" in rows[1, 8]["message"]


def test_apply(people):
    rules = [Rule(1, "a", (Test("score", "ge", 75),), (SetField("name", "Top"), Increment("score", 1))), Rule(2, "b", (Test("name", "eq", "Alice"),), (DeleteFact("target"),))]
    got = {r["fact_id"]: r for r in apply(people, rules).collect()}
    assert sorted(got) == [2, 3] and got[2]["name"] == "Top" and got[2]["score"] == 76 and got[3]["score"] is None


def test_lookup_equals_one_pass(spark):
    df = spark.range(1000).select(F.col("id").alias("fact_id"), F.concat(F.lit("v"), (F.col("id") % 37).cast("string")).alias("k"), (F.col("id") % 11).alias("n"))
    rules = [Rule(i, f"r{i}", (Test("k", "eq", f"v{i}"),), (SetField("x", i), Log(f"l{i}"))) for i in range(30)] + [Rule(100 + i, f"n{i}", (Test("n", "eq", i),), (SetField("y", "z"),)) for i in range(11)]
    e = Engine(rules)
    fast, slow = e.evaluate(df), e._one_pass(df, None, rules)
    key = lambda x: sorted((r["rule_id"], r["fact_id"], r["action_seq"], r["kind"], r["field"] or "", str(r["value"]), r["message"] or "") for r in x.collect())
    assert key(fast) == key(slow)
    assert "BroadcastHashJoin" in fast._jdf.queryExecution().executedPlan().toString()


def holds(c, row: dict) -> bool:
    """A row-by-row reading of conditions, to compare with."""
    if isinstance(c, Test):
        v = row.get(c.field)
        if v is None:
            return c.op == "ne"
        return {"eq": v == c.value, "ne": v != c.value, "gt": v > c.value, "lt": v < c.value, "ge": v >= c.value, "le": v <= c.value}[c.op]
    own = [holds(x, row) for x in c.conditions]
    return all(own) if isinstance(c, All) else any(own) if isinstance(c, AnyOf) else bool(own) and not any(own)


def test_random_conditions(spark):
    rnd = random.Random(5)
    rows = [{"fact_id": i, "a": rnd.choice([None, 1, 2, 3]), "b": rnd.choice([None, 1, 2, 3])} for i in range(40)]
    df = spark.createDataFrame([(r["fact_id"], r["a"], r["b"]) for r in rows], "fact_id bigint, a bigint, b bigint")

    def tree(depth: int):
        if depth == 0 or rnd.random() < 0.3:
            return Test(rnd.choice("abc"), rnd.choice(["eq", "ne", "gt", "lt", "ge", "le"]), rnd.choice([1, 2, 3]))
        return rnd.choice([All, AnyOf, NoneOf])(tuple(tree(depth - 1) for _ in range(rnd.randint(0, 3))))

    rules = [Rule(i, f"r{i}", (tree(3),)) for i in range(60)]
    got = {(r["rule_id"], r["fact_id"]) for r in Engine(rules).matches(df).collect()}
    assert got == {(r.id, row["fact_id"]) for r in rules for row in rows if holds(r.conditions[0], row)}
    assert M.loads(M.dumps(rules)) == rules


def test_aggregate_modes(spark):
    df = spark.createDataFrame([("A", None), ("A", 100.0), ("B", 42.0), ("C", None)], "k string, v double")
    c, t = F.col("v"), df.schema["v"].dataType
    got = {r["k"]: r for r in df.groupBy("k").agg(*(A.value(f, c, t, "rule", 95).alias(f) for f in M.AGGREGATES)).collect()}
    assert got["C"]["sum"] == 0.0 and got["C"]["min"] == float("inf") and got["C"]["max"] == float("-inf") and got["C"]["avg"] == 0.0 and got["B"]["percentile"] == 42.0 and got["B"]["stddev"] == 0.0
    with pytest.raises(Exception, match="missing"):
        df.groupBy("k").agg(A.value("sum", c, t, "strict")).collect()
    s = spark.createDataFrame([("1",), ("2",), ("10",)], "v string")
    assert s.agg(A.value("percentile", F.col("v"), s.schema["v"].dataType, "strict", 75)).first()[0] == 2.0


def test_aggregate_condition_with_null_keys(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 6.0), (3, "x", 1.0)], "fact_id bigint, k string, v double")
    spec = Aggregate("sum", "v", "s", ("k",), having=Test("s", "gt", 10))
    assert ids(Engine([Rule(1, "r", (spec,))]).matches(df)) == [1, 2]
    assert ids(Engine([Rule(1, "r", (NoneOf((spec,)),))]).matches(df)) == [3]
    assert ids(Engine([Rule(1, "r", (Aggregate("count", "v", "n", ("missing",)),))]).matches(df)) == [1, 2, 3]
    assert ids(Engine([Rule(1, "r", (spec,))]).matches(df.limit(0))) == []


def times(spark, *rows):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    return spark.createDataFrame([(i, at(s), k, float(v)) for i, (s, k, v) in enumerate(rows)], "fact_id bigint, event_ts timestamp, k string, v double")


def test_frames(spark):
    df = times(spark, (0, "a", 1), (1, "a", 2), (2, "b", 4), (10, "a", 8), (11, "b", 16))
    m = lambda frame, over: ids(Engine([Rule(1, "r", (Aggregate("sum", "v", "s", ("k",), having=Test("s", "ge", over), frame=frame),))]).matches(df))
    assert m(Frame("time", 1000), 3.0) == [1, 2, 3, 4]
    assert m(Frame("last", 2), 16.0) == [2, 4]
    assert m(Frame("block", 2), 3.0) == [0, 1, 2, 3, 4]
    assert m(Frame("session", 5000), 8.0) == [3, 4]
    many = times(spark, *((s, "a", 1) for s in [*range(0, 300, 3), *range(400, 700, 3), 710, 900]))
    numbered = {r["fact_id"]: r["_session"] for r in frames.sessions(many.repartition(4), [], 10_000).collect()}
    assert [numbered[i] for i in range(len(numbered))] == [0] * 100 + [1] * 100 + [2, 3]
    got = {r["fact_id"]: r["_pos"] for r in frames.positions(df, ["event_ts", "fact_id"]).collect()}
    assert got == {i: i for i in range(5)}


def test_windows(spark):
    e = times(spark, (1, "a", 100), (5, "a", 200), (15, "a", 300)).withColumnRenamed("fact_id", "event_id")
    n = {"n": W.aggregate("count", None)}
    got = sorted((r["window_start"].second, r["n"]) for r in W.windowed(e, W.EventWindow("tumbling", 10_000), n, watermark="2024-01-01 00:00:20").collect())
    assert got == [(0, 2), (10, 1)]
    assert W.windowed(e, W.EventWindow("tumbling", 10_000), n, watermark="2024-01-01 00:00:10", lateness_ms=6000).collect()[0]["n"] == 1  # one event is late
    got = sorted((r["window_start"].second, r["n"]) for r in W.windowed(e, W.EventWindow("sliding", 10_000, 5_000), n).collect())
    assert got == [(0, 2), (5, 1), (10, 1), (15, 1), (55, 1)]
    s = times(spark, (0, "u", 1), (1, "u", 1), (2, "u", 1), (12, "u", 1), (13, "u", 1), (14, "u", 1)).withColumnRenamed("fact_id", "event_id")
    assert sorted(r["n"] for r in W.windowed(s, W.EventWindow("session", 5_000), n).collect()) == [3, 3]
    assert len(W.windowed(s, W.EventWindow("session", 10_000), n).collect()) == 1  # a gap of the full length joins
    assert sorted(r["n"] for r in W.windowed(s, W.EventWindow("count_tumbling", 4), n).collect()) == [2, 4]
    v = spark.createDataFrame([(float(x),) for x in (5, 10, 15, 20, 25, 35)], "v double")
    agg = lambda f, **m: W.aggregate(f, F.col("v"), v.schema["v"].dataType, **m)
    r = v.agg(agg("distinct"), agg("stddev"), agg("variance"), agg("median"), agg("percentile", percent=75)).first()
    assert r[0] == 6 and r[1] == pytest.approx(9.860132971832694) and r[2] == pytest.approx(97.2222, abs=1e-3) and r[3] == 17.5 and r[4] == 23.75


def test_stream_condition(spark):
    df = times(spark, (0, "a", 10), (1, "a", 20), (20, "a", 5), (0, "b", 1))
    c = StreamTest(W.EventWindow("tumbling", 10_000), "sum", "v", "s", Test("s", "gt", 25), group_by=("k",))
    assert ids(Engine([Rule(1, "r", (c,))]).matches(df)) == [0, 1]


def test_streams_equal_batch(spark, tmp_path):
    df = times(spark, *((s, "ab"[s % 2], s) for s in range(0, 600, 7)))
    df.write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    agg = {"n": F.count(F.lit(1)), "s": F.sum("v")}
    last = df.agg(F.max("event_ts")).first()[0] - datetime.timedelta(seconds=60)
    for name, w, keys in (("t", W.EventWindow("tumbling", 60_000), ()), ("s", W.EventWindow("sliding", 60_000, 30_000), ("k",))):
        got = {tuple(r) for r in drain(W.stream(src(), w, agg, keys), f"d_{name}").collect()}
        want = {tuple(r) for r in W.windowed(df, w, agg, keys, ids="fact_id").where(F.col("window_end") <= F.lit(last)).select(*keys, "window_start", "window_end", "n", "s").collect()}
        assert got == want and got
    got = {tuple(r) for r in drain(W.count_windows(src(), "k", "v", 10), "d_c").collect()}
    assert len(got) == sum(r["count"] // 10 for r in df.groupBy("k").count().collect()) and all(r[2] == 10 for r in got)
    with pytest.raises(RuleError):
        W.stream(src(), W.EventWindow("session", 1000), agg)


def test_joins(spark):
    a = spark.createDataFrame([(1, 7, 10), (2, 8, 20), (3, None, 30)], "fact_id bigint, user_id bigint, v bigint")
    b = spark.createDataFrame([(11, 7, 5), (12, 8, 50)], "fact_id bigint, user_id bigint, v bigint")
    got = joins.join(a, b, [joins.JoinTest("user_id", "user_id"), joins.JoinTest("v", "v", "gt")]).select("fact_id", "earlier_fact_id").collect()
    assert [tuple(r) for r in got] == [(1, 11)]
    assert joins.inferred(a, b)[0] == joins.JoinTest("user_id", "user_id")
    assert joins.lookup(a, b.withColumn("fact_id", F.col("user_id")), "user_id", "v", "w", 0).orderBy("fact_id").select("w").collect()[2][0] == 0


def test_conflict(spark):
    rules = [Rule(1, "b", priority=1), Rule(2, "a", priority=9, salience=1), Rule(3, "c", (Test("x", "eq", 1), Test("y", "eq", 1)), priority=9)]
    done = spark.createDataFrame([(r, 5, r) for r in (1, 2, 3)], "rule_id bigint, fact_id bigint, triggered_at bigint").join(conflict.metadata(spark, rules), "rule_id")
    first = lambda *a, **k: [r["rule_id"] for r in conflict.resolve(done, *a, **k).orderBy("rank").collect()]
    assert first() == [3, 2, 1] and first("salience", "name") == [2, 1, 3] and first("name") == [2, 1, 3] and first("specificity", "priority") == [3, 2, 1] and first(most=1, conflict_set=["fact_id"]) == [3]


def test_dependencies():
    a = Rule(1, "a", (Test("x", "gt", 1),), (SetField("y", 1),))
    b = Rule(2, "b", (Test("y", "eq", 1),), (SetField("z", 1),))
    c = Rule(3, "c", (Test("z", "eq", 1), Test("y", "eq", 2)), (SetField("z", 2),))
    d = Rule(4, "d", (Test("q", "eq", 1),))
    order = dependency.order([c, b, a, d])
    assert order.index(1) < order.index(2) < order.index(3) and 4 in order
    kinds = {(x.source, x.target, x.kind) for x in dependency.dependencies([a, b, c])}
    assert {(1, 2, "data_flow"), (2, 3, "data_flow"), (2, 3, "field_conflict")} <= kinds
    assert dependency.critical_path([a, b, c]) == [1, 2, 3]
    back = Rule(5, "e", (Test("z", "eq", 1),), (SetField("x", 1),))
    with pytest.raises(RuleError, match="circular"):
        dependency.order([a, b, back])
    assert dependency.cycles([a, b, back, d]) == [{"rules": [1, 2, 5], "severity": "medium"}]
    assert "r1 -> r2" in dependency.draw([a, b]) and "r1 -->" in dependency.draw([a, b], "mermaid") and json.loads(dependency.draw([a, b], "json"))["rules"]
    assert dependency.usage([a, b])["y"] == {"read_by": [2], "written_by": [1]}


def test_optimizer():
    r = Rule(1, "r", (Test("s", "contains", "x"), Test("n", "eq", 5)))
    got = optimizer.optimize(r)
    assert got.rule.conditions[0].field == "n" and got.gain > 0.2 and optimizer.optimize(got.rule).gain == 0
    assert list(optimizer.shared([r, Rule(2, "q", (Test("n", "eq", 5),))]).values()) == [[1, 2]]


def test_pipeline_and_fixpoint(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(1, 1), (2, 5)], "fact_id bigint, level bigint")
    one = Stage("one", (Rule(1, "a", (Test("level", "lt", 3),), (SetField("level", 3), CreateFact({"level": 9}))),))
    two = Stage("two", (Rule(2, "b", (Test("level", "ge", 9),), (Log("high"),)),), after=("one",))
    facts, fired = run([two, one], df, checkpoint=True)
    assert sorted(r["level"] for r in facts.collect()) == [3, 5, 9] and fired.where("stage = 'two'").count() == 1
    with pytest.raises(RuleError):
        ordered([Stage("x", (), ("y",)), Stage("y", (), ("x",))])
    e = Engine([Rule(i, f"r{i}", (Test("level", "eq", i),), (CreateFact({"level": i + 1}),)) for i in range(1, 4)])
    every, rounds = to_fixpoint(e, df)
    assert sorted(r["level"] for r in every.collect()) == [1, 2, 3, 4, 5] and rounds == 3


def test_registry(people):
    e = Engine([Rule(1, "a", (Test("score", "gt", 60),), (Log("x"),))])
    with pytest.raises(RuleError):
        e.add(Rule(1, "again"))
    e.update(Rule(1, "a", (Test("score", "gt", 1),), (Log("x"),)))
    assert e.matches(people).count() == 2
    assert [r["holds"] for r in e.explain_firing(people, 3).collect()] == [False]
    e.remove(1)
    with pytest.raises(RuleError):
        e.remove(1)
    assert e.evaluate(people).count() == 0 and e.matches(people).count() == 0
    assert [x.kind for x in Engine([Rule(1, "bad", (Test("name", "gt", 3),))]).validate(people)] == ["type"]


def test_store_and_json(spark, people, tmp_path):
    s = FactStore(people.withColumn("external_id", F.concat(F.lit("x"), F.col("fact_id").cast("string"))))
    assert s.field_of("x2", "name").first()[0] == "Bob" and s.find(name="Alice", score=50).count() == 1 and s.find(score=None).count() == 1
    assert s.delete(s.get(1)).count() == 2 and s.clear().is_empty() and s.update(spark.createDataFrame([(3, 9)], "fact_id bigint, score bigint")).get(3).first()["score"] == 9
    assert ids(s.insert(spark.createDataFrame([("x9", "Dora")], "external_id string, name string")).scan()) == [1, 2, 3, 4]
    lines = spark.createDataFrame([('{"id": "7", "timestamp": "2024-01-01T00:00:00Z", "data": {"a": 1, "b": 1.0, "c": "1", "d": null, "e": true, "f": [1, 2]}}',), ('{"id": "abc", "data": {}}',)], "value string")
    got = {r["fact_id"]: r for r in json_io.parse(lines).collect()}
    assert [got[7]["fields"][k]["t"] for k in "abcdef"] == ["integer", "float", "string", "null", "boolean", "array"]
    assert got[0]["external_id"] == "abc" and got[7]["fields"]["a"]["i"] == 1 and got[7]["fields"]["b"]["d"] == 1.0 and got[7]["fields"]["f"]["j"] == "[1,2]"
    assert json_io.parse(lines).select(json_io.present("d"), json_io.present("zz")).first()[:] == (True, False)
    json_io.write(people.select("fact_id", "name"), str(tmp_path / "out"))
    assert json_io.promote(json_io.read(spark, str(tmp_path / "out")), {"name": "string"}).where("name = 'Bob'").count() == 1


def test_first_only_not(people):
    c = NoneOf((Test("score", "gt", 60), Test("score", "gt", 0)))
    assert ids(people.where(compile_condition(c, resolver(people.schema), first_only=True))) == [1, 3]


def test_apply_changes(spark):
    df = spark.createDataFrame([(1, 5, "a", [1]), (2, 7, "b", None), (3, None, "c", [2])], "fact_id bigint, n int, s string, xs array<bigint>")
    rules = [
        Rule(1, "new", (Test("n", "ge", 5),), (SetField("tier", "x"), Increment("n", 1), Append("xs", 9))), Rule(2, "mixed", (Test("s", "eq", "b"),), (SetField("s", 4), SetField("tier", None))),
        Rule(3, "other", (Test("fact_id", "eq", 1),), (UpdateFact("n", {"tier": "told"}), UpdateFact("fact_id", {"seen": True}))), Rule(4, "far", (Test("s", "eq", "c"),), (Calculate("add", {"a": "n", "b": 1.0}, "sum"),)),
    ]
    got = {r["fact_id"]: r.asDict(True) for r in apply(df.unionByName(spark.createDataFrame([(5, None, "z", None)], df.schema)), rules).collect()}
    assert got[1]["tier"] == "x" and got[1]["n"] == 6 and got[1]["xs"] == [1, 9] and got[1]["seen"] is True and got[1]["s"]["s"] == "a"
    assert got[2]["tier"] is None and got[2]["n"] == 8 and got[2]["xs"] == [9] and got[2]["s"]["i"] == 4
    assert got[3]["n"] is None and got[3]["sum"] is None and got[5]["tier"] == "told" and got[5]["seen"] is None
    gone = apply(df, [Rule(1, "d", (Test("s", "eq", "a"),), (DeleteFact("n"),)), Rule(2, "own", (Test("s", "eq", "c"),), (DeleteFact("fact_id"),))])
    assert ids(gone) == [1, 2]
    assert ids(apply(df.limit(0), rules)) == []
    with pytest.raises(RuleError, match="type"):
        apply(df, [Rule(1, "bad", (Test("n", "ge", 5),), (Append("xs", "text"),))])


def test_stages_stay_one_scan(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "fact_id bigint, n bigint")
    stages = [Stage(f"s{i}", (Rule(i, f"r{i}", (Test(f"f{i}" if i else "n", "ge", 0),), (SetField(f"f{i + 1}", i),)),), (f"s{i - 1}",) if i else ()) for i in range(4)]
    facts, fired = run(stages, df)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    assert facts.where("f4 = 3").count() == 20 and fired.count() == 80


def test_repeated_ids_in_frames(spark):
    df = times(spark, (0, "a", 1), (1, "a", 2)).withColumn("fact_id", F.lit(7).cast("bigint"))
    spec = Aggregate("sum", "v", "s", ("k",), having=Test("s", "ge", 3), frame=Frame("time", 1000))
    assert ids(Engine([Rule(1, "r", (spec,))]).matches(df)) == [7]
    assert ids(Engine([Rule(1, "r", (NoneOf((spec,)),))]).matches(df)) == [7]


def test_many_rules(spark):
    df = spark.range(300).select(F.col("id").alias("fact_id"), (F.col("id") % 13).alias("n"))
    rules = [Rule(i, f"r{i}", (Test("n", "gt", i % 13), Test("fact_id", "lt", i * 3)), (Log(f"l{i}"), SetField("x", i)) if i % 2 else (Increment("n", 1),)) for i in range(90)]
    got = {(r["rule_id"], r["fact_id"], r["action_seq"]) for r in evaluate(rules, df).collect()}
    assert got == {(i, k, s) for i in range(90) for k in range(300) if k % 13 > i % 13 and k < 3 * i for s in range(2 if i % 2 else 1)}
    assert Engine(rules).matches(df).count() == len({(a, b) for a, b, _ in got})


def test_constants_and_custom_aggregates(spark, people):
    got = Engine([Rule(1, "r", (Test("limit", "gt", 5), Test("score", "ge", 50)), (M.Formula("x", "balance * rate"),))], constants={"limit": 6, "rate": 0.5}).apply(people)
    assert {r["fact_id"]: r["x"] for r in got.collect()} == {1: 500.0, 2: 1000.0, 3: None}
    with pytest.raises(RuleError):
        A.register_aggregate("sum", F.sum)


def test_refusals(spark, people):
    with pytest.raises(RuleError, match="equality"):
        joins.join(people, people, [joins.JoinTest("score", "score", "gt")])
    assert joins.join(people, people, [joins.JoinTest("score", "score", "gt")], product=True).count() == 1
    loop = Engine([Rule(1, "grow", (Test("n", "ge", 0),), (CreateFact({"n": "{{m}}", "m": 1}),))])
    df = spark.createDataFrame([(1, 1, 2)], "fact_id bigint, n bigint, m bigint")
    assert to_fixpoint(loop, df)[1] == 2
    with pytest.raises(RuleError, match="still created"):
        to_fixpoint(loop, df, most=1)
    assert dependency.draw([Rule(1, "a<b")], "svg").count("a&lt;b") == 1
