"""The rules engine's queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweft.functions import values as V
from ruleweft.functions.calculators import conditional_rate, tiered_rate
from ruleweft.functions.expr import compile_expression
from ruleweft.model import Aggregate, Alert, All, AnyOf, Append, Calculate, CreateFact, DeleteFact, Formula, Frame, Increment, Log, LogTemplate, NoneOf, Notify, Rule, SetField, StreamTest, Test, UpdateFact
from ruleweft.operators import aggregates as A
from ruleweft.operators import conflict, joins
from ruleweft.operators.frames import positions
from ruleweft.operators.predicates import compile_condition, ragged_matches, resolver
from ruleweft.plans.engine import Engine, apply, retracted, top_rules
from ruleweft.plans.pipeline import Stage, latest, run
from ruleweft.sources import json_io, wire
from ruleweft.sources.store import FactStore
from ruleweft.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _all() -> None:
    from ruleweft.plans import catalogue_engine, catalogue_language  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)


def facts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A driver table as facts: its key is the fact's id."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("fact_id", F.col(key).cast("bigint"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "orders", "o_orderkey").withColumn("event_ts", F.col("o_orderdate").cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "events", "event_id").withColumn("event_ts", F.col("ts").cast("timestamp"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "lineitem", "l_orderkey").withColumn("fact_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def match(rules: list[Rule], df: DataFrame) -> DataFrame:
    return Engine(rules).matches(df)


def fire(rules: list[Rule], df: DataFrame) -> DataFrame:
    """Firings with plain value columns."""
    return Engine(rules).evaluate(df).select("rule_id", "fact_id", "action_seq", "kind", "field", F.col("value.s").alias("value_s"), F.col("value.i").alias("value_i"), F.round("value.d", 4).alias("value_d"), "message", "target_fact_id")


FIRE = "CAST({rule} AS BIGINT) AS rule_id, {id} AS fact_id, CAST({seq} AS INTEGER) AS action_seq, {kind} AS kind, {field} AS field, CAST({s} AS VARCHAR) AS value_s, CAST({i} AS BIGINT) AS value_i, CAST({d} AS DOUBLE) AS value_d, CAST({message} AS VARCHAR) AS message, CAST({target} AS BIGINT) AS target_fact_id"


def fired(rule: int, id_: str, kind: str, field: str = "NULL", seq: int = 0, s="NULL", i="NULL", d="NULL", message="NULL", target="NULL") -> str:
    return FIRE.format(rule=rule, id=id_, seq=seq, kind=f"'{kind}'", field=f"'{field}'" if field != "NULL" else "CAST(NULL AS VARCHAR)", s=s, i=i, d=d, message=message, target=target)


# predicates


@query("SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def entry_rule(spark, sf_dir):
    return match([Rule(1, "high value", (Test("o_orderstatus", "eq", "F"), Test("o_totalprice", "gt", 100000.0)), (SetField("tier", "gold"),))], orders(spark, sf_dir))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, p_partkey AS fact_id FROM part WHERE p_size = 5")
def rule_eq(spark, sf_dir):
    return match([Rule(1, "size", (Test("p_size", "eq", 5),))], facts(spark, sf_dir, "part", "p_partkey"))


@query("""SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000
UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderpriority > '3' UNION ALL SELECT 3, o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'""")
def rule_range(spark, sf_dir):
    import datetime

    return match([Rule(1, "band", (Test("o_totalprice", "ge", 50000), Test("o_totalprice", "lt", 150000))), Rule(2, "text", (Test("o_orderpriority", "gt", "3"),)), Rule(3, "date", (Test("o_orderdate", "le", datetime.datetime(1996, 6, 30)),))], orders(spark, sf_dir))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, c_custkey AS fact_id FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' UNION ALL SELECT 2, c_custkey FROM customer")
def rule_not_equal(spark, sf_dir):
    return match([Rule(1, "other", (Test("c_mktsegment", "ne", "BUILDING"),)), Rule(2, "missing", (Test("no_such_field", "ne", 1),))], facts(spark, sf_dir, "customer", "c_custkey"))


@query("""SELECT CAST(1 AS BIGINT) AS rule_id, p_partkey AS fact_id FROM part WHERE contains(p_name, 'a') UNION ALL SELECT 2, p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')
UNION ALL SELECT 3, p_partkey FROM part WHERE suffix(p_type, 'L') UNION ALL SELECT 4, p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL')""")
def rule_string_ops(spark, sf_dir):
    part = facts(spark, sf_dir, "part", "p_partkey").withColumn("words", F.split("p_type", " "))
    return match([Rule(1, "contains", (Test("p_name", "contains", "a"),)), Rule(2, "starts", (Test("p_brand", "starts_with", "Brand#1"),)), Rule(3, "ends", (Test("p_type", "ends_with", "L"),)), Rule(4, "member", (Test("words", "contains", "STEEL"),))], part)


@query("""SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE ((o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice < 20000)) AND NOT (o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW')""")
def rule_nested_bool(spark, sf_dir):
    a = All((Test("o_orderstatus", "eq", "F"), Test("o_totalprice", "gt", 200000)))
    b = All((Test("o_orderstatus", "eq", "O"), Test("o_totalprice", "lt", 20000)))
    return match([Rule(1, "nested", (AnyOf((a, b)), NoneOf((Test("o_orderpriority", "eq", "1-URGENT"), Test("o_orderpriority", "eq", "5-LOW")))))], orders(spark, sf_dir))


@query("SELECT CAST(4 AS BIGINT) AS rule_id, c_custkey AS fact_id FROM customer UNION ALL SELECT 5, c_custkey FROM customer WHERE c_acctbal > 0")
def rule_not_empty(spark, sf_dir):
    rules = [Rule(1, "no conditions"), Rule(2, "empty none", (NoneOf(),)), Rule(3, "empty any", (AnyOf(),)), Rule(4, "empty all", (All(),)), Rule(5, "mixed", (All(), Test("c_acctbal", "gt", 0)))]
    return match(rules, facts(spark, sf_dir, "customer", "c_custkey"))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, c_custkey AS fact_id FROM customer WHERE NOT (c_acctbal > 0) UNION ALL SELECT 2, c_custkey FROM customer")
def rule_not_first_only(spark, sf_dir):
    df = facts(spark, sf_dir, "customer", "c_custkey")
    own = compile_condition(NoneOf((Test("c_acctbal", "gt", 0), Test("c_custkey", "gt", 0))), resolver(df.schema), first_only=True)
    none = compile_condition(NoneOf(), resolver(df.schema), first_only=True)
    return df.where(own).select(F.lit(1).cast("bigint").alias("rule_id"), "fact_id").unionByName(df.where(none).select(F.lit(2).cast("bigint").alias("rule_id"), "fact_id"))


MULTI = [Rule(i, f"quantity {q}", (Test("l_quantity", "gt", float(q)), Test("l_returnflag", "eq", f))) for i, (q, f) in enumerate([(q, f) for q in range(5, 45, 10) for f in "ARN"])]


@query(" UNION ALL ".join(f"SELECT CAST({r.id} AS BIGINT) AS rule_id, l_orderkey * 10 + l_linenumber AS fact_id FROM lineitem WHERE l_quantity > {r.conditions[0].value} AND l_returnflag = '{r.conditions[1].value}'" for r in MULTI))
def multi_rule_one_pass(spark, sf_dir):
    return match(MULTI, lineitem(spark, sf_dir))


SIZES = [Rule(i, f"size {i}", (Test("p_size", "eq", i),), (SetField("band", f"b{i % 5}"),)) for i in range(1, 41)]
BRANDS = [Rule(100 + i, f"brand {i}", (Test("p_brand", "eq", f"Brand#{10 + i}"),), (Log(f"brand {i}"),)) for i in range(50)]


@query(
    f"SELECT CAST(p_size AS BIGINT) AS rule_id, p_partkey AS fact_id, 0 AS action_seq, 'field_set' AS kind, 'band' AS field, 'b' || (p_size % 5) AS value_s, CAST(NULL AS BIGINT) AS value_i, CAST(NULL AS DOUBLE) AS value_d, NULL AS message, CAST(NULL AS BIGINT) AS target_fact_id FROM part WHERE p_size BETWEEN 1 AND 40 UNION ALL SELECT CAST(substr(p_brand, 7) AS BIGINT) - 10 + 100, p_partkey, 0, 'logged', NULL, NULL, NULL, NULL, 'brand ' || (CAST(substr(p_brand, 7) AS BIGINT) - 10), NULL FROM part WHERE CAST(substr(p_brand, 7) AS BIGINT) BETWEEN 10 AND 59"
)
def rule_equality_index(spark, sf_dir):
    return fire(SIZES + BRANDS, facts(spark, sf_dir, "part", "p_partkey"))


@query("SELECT CAST(2 AS BIGINT) AS rule_id, c_custkey AS fact_id FROM customer WHERE c_acctbal < 0")
def rule_enabled_and_priority(spark, sf_dir):
    return match([Rule(1, "off", (Test("c_acctbal", "gt", 0),), enabled=False), Rule(2, "on", (Test("c_acctbal", "lt", 0),), priority=5)], facts(spark, sf_dir, "customer", "c_custkey"))


# values


@query("""SELECT p_partkey AS fact_id, CAST(p_size AS DOUBLE) AS size_num, CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS DOUBLE) AS flag_num, p_size <> 0 AS truthy, 'string' AS name_type, CAST(trunc(p_retailprice) AS BIGINT) AS price_int, CAST(substr(p_brand, 7) AS DOUBLE) AS brand_num, TRY_CAST(p_name AS BIGINT) AS name_int FROM part""")
def value_coercions(spark, sf_dir):
    p = facts(spark, sf_dir, "part", "p_partkey").withColumn("flag", F.col("p_size") > 25).withColumn("num", F.substring("p_brand", 7, 10))
    t = lambda n: p.schema[n].dataType
    return p.select(
        "fact_id", V.comparable(F.col("p_size"), t("p_size")).alias("size_num"), V.comparable(F.col("flag"), t("flag")).alias("flag_num"), V.truthy(F.col("p_size"), t("p_size")).alias("truthy"), V.type_name(F.col("p_name"), t("p_name")).alias("name_type"),
        V.as_integer(F.col("p_retailprice"), t("p_retailprice")).alias("price_int"), V.as_float(F.col("num"), t("num")).alias("brand_num"), V.as_integer(F.col("p_name"), t("p_name")).alias("name_int"),
    )


# actions


@query("SELECT " + fired(1, "c_custkey", "field_incremented", "c_acctbal", d="round(c_acctbal + 10.5, 4)") + " FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT " + fired(1, "c_custkey", "field_incremented", "visits", seq=1, i="1") + " FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT " + fired(1, "c_custkey", "logged", seq=2, message="'Increment failed: ''c_name'' is of another type'") + " FROM customer WHERE c_mktsegment = 'BUILDING'")
def action_increment(spark, sf_dir):
    return fire([Rule(1, "inc", (Test("c_mktsegment", "eq", "BUILDING"),), (Increment("c_acctbal", 10.5), Increment("visits", 1), Increment("c_name", 1)))], facts(spark, sf_dir, "customer", "c_custkey"))


@query("SELECT o_orderkey AS fact_id, 'array_appended' AS kind, 'premium' AS value_s, len(string_split(o_orderpriority, '-')) + 1 AS new_length FROM orders WHERE o_totalprice > 150000")
def action_append_array(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("tags", F.split("o_orderpriority", "-"))
    got = Engine([Rule(1, "append", (Test("o_totalprice", "gt", 150000),), (Append("tags", "premium"),))]).evaluate(df)
    return got.select("fact_id", "kind", F.col("value.s").alias("value_s"), F.col("extra")["new_length"].cast("bigint").alias("new_length"))


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1 + 1000000) AS fact_id, o_custkey AS customer, 'review' AS status FROM orders WHERE o_totalprice > 180000")
def action_create_fact(spark, sf_dir):
    e = Engine([Rule(1, "create", (Test("o_totalprice", "gt", 180000),), (CreateFact({"customer": "{{o_custkey}}", "status": "review"}),))])
    return e.created(e.evaluate(orders(spark, sf_dir)), "customer bigint, status string", 1_000_000)


@query("SELECT " + fired(1, "o_orderkey", "fact_updated", "status", target="o_custkey") + " FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT " + fired(1, "o_orderkey", "fact_deleted", "o_custkey", seq=1, target="o_custkey") + " FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT " + fired(1, "o_orderkey", "logged", seq=2, message="'Delete failed: no fact id in ''o_orderpriority'''") + " FROM orders WHERE o_orderstatus = 'F'")
def action_update_delete(spark, sf_dir):
    return fire([Rule(1, "change", (Test("o_orderstatus", "eq", "F"),), (UpdateFact("o_custkey", {"status": "done"}), DeleteFact("o_custkey"), DeleteFact("o_orderpriority")))], orders(spark, sf_dir))


@query("SELECT " + fired(1, "c_custkey", "logged", message="'Alert [credit]: low balance'") + " FROM customer WHERE c_acctbal < 0 UNION ALL SELECT " + fired(1, "c_custkey", "notification_sent", seq=1, message="'Balance'") + " FROM customer WHERE c_acctbal < 0 UNION ALL SELECT " + fired(1, "c_custkey", "logged", seq=2, message="'name=' || c_name || ' segment=' || c_mktsegment") + " FROM customer WHERE c_acctbal < 0")
def action_alert_notify_log(spark, sf_dir):
    acts = (Alert("credit", "low balance", "high"), Notify("ops", "email", "Balance"), LogTemplate("name={} segment={}", ("c_name", "c_mktsegment")))
    return fire([Rule(1, "alert", (Test("c_acctbal", "lt", 0),), acts)], facts(spark, sf_dir, "customer", "c_custkey"))


@query("SELECT c_custkey AS fact_id, c_name, round(c_acctbal + 100, 4) AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'WATCH' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT c_acctbal > 9000")
def action_apply(spark, sf_dir):
    df = facts(spark, sf_dir, "customer", "c_custkey").select("fact_id", "c_name", "c_acctbal", "c_mktsegment")
    rules = [Rule(1, "watch", (Test("c_acctbal", "lt", 0),), (SetField("c_mktsegment", "WATCH"),)), Rule(2, "bonus", (Test("c_acctbal", "ge", -1e9),), (Increment("c_acctbal", 100.0),)), Rule(3, "drop", (Test("c_acctbal", "gt", 9000),), (DeleteFact("fact_id"),))]
    return apply(df, rules).withColumn("c_acctbal", F.round("c_acctbal", 4))


# calculators and expressions


def calculated(name: str, sql: str, inputs: dict, **more):
    """A query that runs a calculator over lineitem, and its SQL."""

    def f(spark, sf_dir):
        df = lineitem(spark, sf_dir)
        got = Engine([Rule(1, name, (Test("l_quantity", "gt", 0),), (Calculate(more.get("calculator", name), inputs, "result"),))]).evaluate(df)
        v = F.col("value")
        return got.select("fact_id", "kind", F.coalesce(F.round(v["d"], 4), v["b"].cast("double")).alias("result"), v["s"].alias("status"))

    f.__name__ = more.get("query", f"calc_{name}")
    return query(f"SELECT l_orderkey * 10 + l_linenumber AS fact_id, 'calculated' AS kind, {sql} FROM lineitem WHERE l_quantity > 0")(f)


num = lambda e: f"CAST(round({e}, 4) AS DOUBLE) AS result, CAST(NULL AS VARCHAR) AS status"
calculated("add", num("l_extendedprice + l_tax"), {"a": "l_extendedprice", "b": "l_tax"})
calculated("multiply", num("l_quantity * l_tax"), {"multiplicand": "l_quantity", "multiplier": "l_tax"})
calculated("percentage_add", num("l_extendedprice + l_extendedprice * l_tax"), {"amount": "l_extendedprice", "percentage": "l_tax"})
calculated("percentage_deduct", num("l_extendedprice - l_extendedprice * l_discount"), {"amount": "l_extendedprice", "percentage": "l_discount"})
calculated("proportional_allocator", num("CASE WHEN l_discount = 0 THEN 0.0 ELSE 100.0 * l_quantity / l_discount END"), {"total_amount": 100.0, "individual_value": "l_quantity", "total_value": "l_discount"}, query="calc_proportional")
calculated("threshold_check", "CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS DOUBLE) AS result, CAST(NULL AS VARCHAR) AS status", {"value": "l_quantity", "threshold": 25.0}, query="calc_threshold")
calculated("limit_validator", "CAST(CASE WHEN l_quantity BETWEEN 10 AND 30 THEN 1 ELSE 0 END AS DOUBLE) AS result, CAST(NULL AS VARCHAR) AS status", {"value": "l_quantity", "min": 10.0, "max": 30.0}, query="calc_limit")
calculated("limit_validate", "CAST(NULL AS DOUBLE) AS result, CASE WHEN l_quantity > 45 THEN 'Breach' WHEN l_quantity >= 40 THEN 'Critical' WHEN l_quantity >= 30 THEN 'Warning' ELSE 'Ok' END AS status", {"value": "l_quantity", "warning_threshold": 30.0, "critical_threshold": 40.0, "max_threshold": 45.0}, query="calc_limit_severity")
calculated("apply_percentage", num("l_extendedprice * l_discount"), {"amount": "l_extendedprice", "percentage": "l_discount"})
calculated("apply_flat", num("l_extendedprice + 2.5"), {"amount": "l_extendedprice", "flat": 2.5})


@query("SELECT o_orderkey AS fact_id, CAST(date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) AS DOUBLE) / 3600.0 AS hours, CAST(date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) AS DOUBLE) / 60.0 AS minutes FROM orders")
def calc_time_between(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("finish", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("start", F.lit("1995-01-01T00:00:00Z")).withColumn("unit", F.lit("minutes"))
    c = lambda text: compile_expression(text, resolver(df.schema)).col
    return df.select("fact_id", c("time_between_datetime(start, finish)").alias("hours"), c("time_between_datetime(start, finish, unit)").alias("minutes"))


@query("""SELECT event_id AS fact_id, date_diff('second', ts0, least(greatest(CASE WHEN edge <= ts0 THEN edge + INTERVAL 1 DAY ELSE edge END, ts0), te)) / 3600.0 AS before_hours, date_diff('second', least(greatest(CASE WHEN edge <= ts0 THEN edge + INTERVAL 1 DAY ELSE edge END, ts0), te), te) / 3600.0 AS after_hours
FROM (SELECT event_id, date_trunc('second', ts) AS ts0, date_trunc('second', ts) + INTERVAL 8 HOUR AS te, date_trunc('day', ts) + INTERVAL 1350 MINUTE AS edge FROM events)""")
def calc_workday_split(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("start", F.date_trunc("second", "event_ts")).withColumn("finish", F.expr("start + INTERVAL 8 HOURS"))
    df = df.withColumn("workday", F.lit('{"hours": 22, "minutes": 30}')).withColumn("unit", F.lit("hours")).withColumn("a", F.lit("time_before")).withColumn("b", F.lit("time_after"))
    c = lambda text: compile_expression(text, resolver(df.schema)).col
    return df.select("fact_id", c("time_between_datetime(start, finish, unit, workday, a)").alias("before_hours"), c("time_between_datetime(start, finish, unit, workday, b)").alias("after_hours"))


TIERS = [(0.0, 0.01), (50000.0, 0.02), (100000.0, 0.03), (200000.0, 0.05)]


@query("SELECT o_orderkey AS fact_id, CAST(CASE WHEN o_totalprice >= 200000 THEN 0.05 WHEN o_totalprice >= 100000 THEN 0.03 WHEN o_totalprice >= 50000 THEN 0.02 WHEN o_totalprice >= 0 THEN 0.01 ELSE 0 END AS DOUBLE) AS tier, CAST(CASE o_orderstatus WHEN 'F' THEN 0.1 WHEN 'O' THEN 0.2 ELSE 0 END AS DOUBLE) AS by_status FROM orders")
def calc_tiered_rate(spark, sf_dir):
    return orders(spark, sf_dir).select("fact_id", tiered_rate(F.col("o_totalprice"), TIERS).alias("tier"), conditional_rate(F.col("o_orderstatus"), {"F": 0.1, "O": 0.2}).alias("by_status"))


@query("SELECT l_orderkey * 10 + l_linenumber AS fact_id, CASE WHEN l_quantity > 40 THEN 'bulk' WHEN l_quantity > 20 THEN 'medium' ELSE 'small' END AS size, round(CASE WHEN l_discount > 0.05 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END, 4) AS price FROM lineitem")
def dsl_conditional(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    c = lambda text: compile_expression(text, resolver(df.schema)).col
    return df.select("fact_id", c('cond when l_quantity > 40 then "bulk" when l_quantity > 20 then "medium" default "small"').alias("size"), F.round(c("if l_discount > 0.05 then l_extendedprice * (1 - l_discount) else l_extendedprice"), 4).alias("price"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS fact_id, greatest(l_quantity, l_discount * 100, 10) AS most, least(l_quantity, 10) AS fewest, CAST(sign(l_tax * 100) * floor(abs(l_tax * 100) + 0.5) AS DOUBLE) AS rounded, l_linenumber % 3 AS rest, CAST(l_linenumber AS BIGINT) * l_linenumber AS square, -l_linenumber AS minus, l_returnflag || '-' || l_linestatus AS code,
contains(l_returnflag, 'A') AND NOT starts_with(l_linestatus, 'O') AS flags, [1, 2, 3][1 + l_linenumber % 3] AS item, l_linenumber IN (1, 3) AS listed FROM lineitem""")
def dsl_functions(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    c = lambda text: compile_expression(text, resolver(df.schema)).col
    return df.select(
        "fact_id", c("max(l_quantity, l_discount * 100, 10)").cast("double").alias("most"), c("min(l_quantity, 10)").cast("double").alias("fewest"), c("round(l_tax * 100)").alias("rounded"), c("l_linenumber % 3").cast("int").alias("rest"), c("l_linenumber ** 2").alias("square"), c("-l_linenumber").alias("minus"),
        c('l_returnflag ++ "-" ++ l_linestatus').alias("code"), c('l_returnflag contains "A" && !(l_linestatus starts_with "O")').alias("flags"), c("[1, 2, 3][l_linenumber % 3]").cast("int").alias("item"), c("l_linenumber in [1, 3]").alias("listed"),
    )


@query("SELECT " + fired(1, "l_orderkey * 10 + l_linenumber", "calculated", "net", d="round(l_extendedprice * (1 - l_discount), 4)", message="'l_extendedprice * (1 - l_discount)'") + " FROM lineitem WHERE l_quantity > 30")
def formula(spark, sf_dir):
    return fire([Rule(1, "net", (Test("l_quantity", "gt", 30),), (Formula("net", "l_extendedprice * (1 - l_discount)"),))], lineitem(spark, sf_dir))


# aggregates


def having(name: str, sql: str, test: Test, function: str, percent: float | None = None) -> None:
    def f(spark, sf_dir):
        spec = Aggregate(function, "o_totalprice", "agg", ("o_custkey",), having=test, percent=percent)
        return match([Rule(1, name, (spec, Test("o_orderstatus", "eq", "F")))], orders(spark, sf_dir))

    f.__name__ = f"agg_having_{name}"
    query(f"SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders JOIN (SELECT o_custkey AS k FROM orders GROUP BY o_custkey HAVING {sql}) ON k = o_custkey WHERE o_orderstatus = 'F'")(f)


having("sum", "sum(o_totalprice) > 1000000", Test("agg", "gt", 1000000.0), "sum")
having("count", "count(o_totalprice) >= 12", Test("agg", "ge", 12), "count")
having("avg", "avg(o_totalprice) > 120000", Test("agg", "gt", 120000.0), "avg")
having("min", "min(o_totalprice) < 5000", Test("agg", "lt", 5000.0), "min")
having("max", "max(o_totalprice) > 190000", Test("agg", "gt", 190000.0), "max")
having("stddev", "stddev_pop(o_totalprice) > 60000", Test("agg", "gt", 60000.0), "stddev")
having("percentile", "quantile_cont(o_totalprice, 0.9) > 180000", Test("agg", "gt", 180000.0), "percentile", 90)


@query("SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE (SELECT sum(o_totalprice) FROM orders) > 0 AND o_orderstatus = 'O'")
def agg_whole_store(spark, sf_dir):
    return match([Rule(1, "total", (Aggregate("sum", "o_totalprice", "agg", having=Test("agg", "gt", 0)), Test("o_orderstatus", "eq", "O")))], orders(spark, sf_dir))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)")
def agg_history(spark, sf_dir):
    df = orders(spark, sf_dir)
    cut = F.lit("1997-01-01").cast("timestamp")
    spec = Aggregate("count", "o_orderkey", "n", ("o_custkey",), having=Test("n", "gt", 10))
    return Engine([Rule(1, "frequent", (spec,))]).matches(df.where(F.col("event_ts") >= cut), history=df.where(F.col("event_ts") < cut))


@query("SELECT o_custkey AS group_key, round(list_sort(list(o_totalprice))[CAST(floor(0.75 * (count(*) - 1)) AS BIGINT) + 1], 4) AS p75, round(quantile_cont(o_totalprice, 0.75), 4) AS p75_linear FROM orders GROUP BY o_custkey")
def agg_percentile_floor(spark, sf_dir):
    df = orders(spark, sf_dir)
    c, t = F.col("o_totalprice"), df.schema["o_totalprice"].dataType
    return df.groupBy(F.col("o_custkey").alias("group_key")).agg(F.round(A.value("percentile", c, t, "strict", 75), 4).alias("p75"), F.round(A.value("percentile", c, t, "rule", 75), 4).alias("p75_linear"))


@query("SELECT l_returnflag, round(var_samp(l_quantity), 6) AS variance, round(stddev_samp(l_quantity), 6) AS deviation, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS large, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY l_returnflag")
def agg_variance_sample(spark, sf_dir):
    v, s = A.sample_variance(F.col("l_quantity"))
    return lineitem(spark, sf_dir).groupBy("l_returnflag").agg(F.round(v, 6).alias("variance"), F.round(s, 6).alias("deviation"), A.count_where(F.col("l_quantity") > 25).alias("large"), F.round(A.weighted_average(F.col("l_tax"), F.col("l_quantity")), 6).alias("weighted"))


@query("SELECT CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus AS group_key, 'sum' AS aggregation_type, 'o_totalprice' AS source_field, 'total' AS target, round(sum(o_totalprice), 4) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey, o_orderstatus HAVING sum(o_totalprice) > 100000")
def agg_to_facts(spark, sf_dir):
    spec = Aggregate("sum", "o_totalprice", "s", ("o_custkey", "o_orderstatus"), having=Test("s", "gt", 100000), filter=Test("o_totalprice", "gt", 1000))
    return A.to_facts(A.grouped(orders(spark, sf_dir), spec, "lazy"), spec, "total").withColumn("total", F.round("total", 4))


@query("""SELECT o_orderkey AS fact_id, round(sum(o_totalprice) OVER (PARTITION BY o_custkey, run ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS accumulated
FROM (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders)""")
def agg_accumulate(spark, sf_dir):
    out = A.accumulate(orders(spark, sf_dir), "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")
    return out.select("fact_id", F.round("accumulated", 4).alias("accumulated"))


# frames


def framed(name: str, sql: str, frame: Frame, test: Test) -> None:
    def f(spark, sf_dir):
        spec = Aggregate("sum", "value", "s", ("user_id",), having=test, frame=frame)
        return match([Rule(1, name, (spec,))], events(spark, sf_dir))

    f.__name__ = f"frame_{name}"
    query(f"SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM ({sql})")(f)


framed("time_range", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS s FROM events QUALIFY s > 100", Frame("time", 86_400_000), Test("s", "gt", 100))
framed("last_n", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) GROUP BY user_id HAVING sum(value) > 100)", Frame("last", 200), Test("s", "gt", 100))
framed("count_tumbling", "SELECT event_id, sum(value) OVER (PARTITION BY b, user_id) AS s FROM (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS b FROM events) QUALIFY s > 50", Frame("block", 100), Test("s", "gt", 50))
framed("session", "SELECT event_id, sum(value) OVER (PARTITION BY user_id, g) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000 THEN 1 ELSE 0 END AS n FROM events)) QUALIFY s > 100", Frame("session", 3_600_000), Test("s", "gt", 100))


# event-time windows

MARK = "2024-01-20 00:00:00"


def win(e: DataFrame, name: str, **more):
    return W.aggregate(name, F.col("value"), e.schema["value"].dataType, **more)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 4) AS s, round(avg(value), 4) AS a, round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(stddev_pop(value), 4) AS sd, round(var_pop(value), 4) AS var FROM events GROUP BY ALL")
def win_tumbling(spark, sf_dir):
    e = events(spark, sf_dir)
    r = lambda n: F.round(win(e, n), 4)
    return ntz(W.windowed(e, W.EventWindow("tumbling", 86_400_000), {"n": win(e, "count"), "s": r("sum"), "a": r("avg"), "lo": r("min"), "hi": r("max"), "sd": r("stddev"), "var": r("variance")}))


def ntz(df: DataFrame) -> DataFrame:
    """Window times without a zone, as the SQL side has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end") if c in df.columns})


@query("SELECT s AS window_start, s + INTERVAL 1 DAY AS window_end, user_id, count(*) AS n FROM (SELECT user_id, ts, unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) FOR k IN range(4)]) AS s FROM events) WHERE s >= TIMESTAMP '1970-01-01' AND ts < s + INTERVAL 1 DAY GROUP BY ALL")
def win_sliding(spark, sf_dir):
    e = events(spark, sf_dir)
    return ntz(W.windowed(e, W.EventWindow("sliding", 86_400_000, 21_600_000), {"n": win(e, "count")}, ("user_id",)))


@query("""SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM (SELECT *, sum(n0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000 THEN 1 ELSE 0 END AS n0 FROM events)) GROUP BY user_id, g""")
def win_session(spark, sf_dir):
    e = events(spark, sf_dir)
    out = W.windowed(e, W.EventWindow("session", 3_600_000), {"n": win(e, "count"), "last": F.max("ts")}, ("user_id",))
    return ntz(out.withColumn("window_end", F.expr("last + INTERVAL 1 HOUR")).drop("last"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(DISTINCT user_id) AS users, round(median(value), 4) AS mid, round(quantile_cont(value, 0.9), 4) AS p90, count(*) * 3600000.0 / 86400000.0 AS per_hour FROM events GROUP BY ALL")
def win_distinct_median_rate(spark, sf_dir):
    e = events(spark, sf_dir)
    aggs = {"users": W.aggregate("distinct", F.col("user_id"), e.schema["user_id"].dataType), "mid": F.round(win(e, "median"), 4), "p90": F.round(win(e, "percentile", percent=90), 4), "per_hour": win(e, "rate", window_ms=86_400_000, unit_ms=3_600_000)}
    return ntz(W.windowed(e, W.EventWindow("tumbling", 86_400_000), aggs))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, round(arg_min(value, ts), 4) AS first, round(arg_max(value, ts), 4) AS last FROM events GROUP BY ALL")
def win_first_last(spark, sf_dir):
    e = events(spark, sf_dir)
    return ntz(W.windowed(e, W.EventWindow("tumbling", 86_400_000), {"first": F.round(win(e, "first"), 4), "last": F.round(win(e, "last"), 4)}, ("user_id",)))


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events WHERE ts + INTERVAL 5 DAY >= TIMESTAMP '{MARK}' AND time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= TIMESTAMP '{MARK}' GROUP BY ALL")
def late_drop(spark, sf_dir):
    e = events(spark, sf_dir)
    return ntz(W.windowed(e, W.EventWindow("tumbling", 86_400_000), {"n": win(e, "count")}, watermark=MARK, lateness_ms=5 * 86_400_000))


@query("SELECT user_id, b AS block, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n, round(sum(value), 4) AS s FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS b FROM events) GROUP BY ALL")
def win_count_tumbling(spark, sf_dir):
    e = W.assign(events(spark, sf_dir), W.EventWindow("count_tumbling", 20), ("user_id",), "event_ts", "event_id")
    return ntz(e.groupBy("user_id", F.col("_block").alias("block"), "window_start", "window_end").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")))


@query("SELECT user_id, k AS block, count(*) AS n, round(sum(value), 4) AS s FROM (SELECT *, unnest(range(greatest(0, CAST(floor((rn - 20) / 5.0) AS BIGINT) + 1), rn // 5 + 1)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)) GROUP BY ALL")
def win_count_sliding(spark, sf_dir):
    e = W.assign(events(spark, sf_dir), W.EventWindow("count_sliding", 20, 5), ("user_id",), "event_ts", "event_id")
    return e.groupBy("user_id", F.col("_block").alias("block")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM events WHERE (user_id, time_bucket(INTERVAL 1 DAY, ts)) IN (SELECT (user_id, time_bucket(INTERVAL 1 DAY, ts)) FROM events WHERE event_type <> 'view' GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts) HAVING sum(value) > 100) AND event_type <> 'view'")
def stream_condition(spark, sf_dir):
    c = StreamTest(W.EventWindow("tumbling", 86_400_000), "sum", "value", "s", Test("s", "gt", 100), filter=Test("event_type", "ne", "view"), group_by=("user_id",))
    return match([Rule(1, "busy day", (c,))], events(spark, sf_dir))


# joins, order, pipelines, store


@query("SELECT o_orderkey AS fact_id, c_custkey AS earlier_id, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_equi(spark, sf_dir):
    o, c = orders(spark, sf_dir).where("o_totalprice > 100000"), facts(spark, sf_dir, "customer", "c_custkey")
    return joins.join(o, c, [joins.JoinTest("o_custkey", "c_custkey")]).select("fact_id", F.col("earlier_fact_id").alias("earlier_id"), F.col("earlier_c_mktsegment").alias("segment"))


@query("SELECT a.o_orderkey AS fact_id, b.o_orderkey AS earlier_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate AND a.o_totalprice < b.o_totalprice AND a.o_orderstatus <> b.o_orderstatus")
def join_theta(spark, sf_dir):
    o = orders(spark, sf_dir)
    tests = [joins.JoinTest("o_custkey", "o_custkey"), joins.JoinTest("o_orderdate", "o_orderdate", "gt"), joins.JoinTest("o_totalprice", "o_totalprice", "lt"), joins.JoinTest("o_orderstatus", "o_orderstatus", "ne")]
    return joins.join(o, o, tests).select("fact_id", F.col("earlier_fact_id").alias("earlier_id"))


@query("SELECT DISTINCT c_custkey AS fact_id, s_suppkey AS earlier_id FROM customer JOIN supplier ON c_custkey = s_suppkey OR (c_nationkey = s_suppkey)")
def join_any_key(spark, sf_dir):
    c, s = facts(spark, sf_dir, "customer", "c_custkey"), facts(spark, sf_dir, "supplier", "s_suppkey")
    return joins.join_any(c, s, [("c_custkey", "s_suppkey"), ("c_nationkey", "s_suppkey")])


@query("SELECT l_orderkey * 10 + l_linenumber AS fact_id, coalesce(p_brand, 'none') AS brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25")
def join_lookup_default(spark, sf_dir):
    p = facts(spark, sf_dir, "part", "p_partkey").where("p_size > 25")
    return joins.lookup(lineitem(spark, sf_dir), p, "l_partkey", "p_brand", "brand", "none").select("fact_id", "brand")


RANKED = [Rule(1, "large", (Test("o_totalprice", "gt", 100000),), priority=5), Rule(2, "open", (Test("o_orderstatus", "eq", "O"),), priority=9), Rule(3, "urgent", (Test("o_orderpriority", "eq", "1-URGENT"), Test("o_totalprice", "gt", 0)), priority=9)]
EXECUTIONS = "SELECT 1 AS rule_id, 5 AS priority, 1 AS specificity, o_orderkey AS fact_id FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 2, 9, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 3, 9, 2, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 0"


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, fact_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY priority DESC, specificity DESC, rule_id) AS INTEGER) AS rank FROM ({EXECUTIONS})")
def conflict_priority(spark, sf_dir):
    done = match(RANKED, orders(spark, sf_dir)).join(F.broadcast(conflict.metadata(spark, RANKED)), "rule_id")
    return conflict.resolve(done, "priority", "specificity", conflict_set=["fact_id"]).select("rule_id", "fact_id", "rank")


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, fact_id, CAST(row_number() OVER (ORDER BY priority DESC, specificity DESC, rule_id, fact_id) AS INTEGER) AS rank FROM ({EXECUTIONS}) QUALIFY rank <= 100")
def conflict_topk(spark, sf_dir):
    done = match(RANKED, orders(spark, sf_dir)).join(F.broadcast(conflict.metadata(spark, RANKED)), "rule_id")
    return conflict.resolve(done, "priority", "specificity", most=100).select("rule_id", "fact_id", "rank")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 150000 THEN 'vip' ELSE o_orderpriority END AS p FROM orders) SELECT o_orderkey AS fact_id, p AS o_orderpriority, round(CASE WHEN p = 'vip' THEN o_totalprice * 0.9 ELSE o_totalprice END, 4) AS o_totalprice FROM a""")
def pipeline_two_stage(spark, sf_dir):
    df = orders(spark, sf_dir).select("fact_id", "o_orderpriority", "o_totalprice")
    one = Stage("grade", (Rule(1, "vip", (Test("o_totalprice", "gt", 150000),), (SetField("o_orderpriority", "vip"),)),))
    two = Stage("price", (Rule(2, "discount", (Test("o_orderpriority", "eq", "vip"),), (Formula("o_totalprice", "o_totalprice * 0.9"),)),), after=("grade",))
    return run([two, one], df)[0].withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT c_custkey AS fact_id, round(c_acctbal / t * 500 * 0.95, 4) AS share FROM customer, (SELECT sum(c_acctbal) AS t FROM customer WHERE c_acctbal > 0) WHERE c_acctbal > 0")
def pipeline_allocation(spark, sf_dir):
    """Shares of a pool after a fee, in proportion to a positive balance."""
    df = facts(spark, sf_dir, "customer", "c_custkey").where("c_acctbal > 0")
    df = A.attach(df, df, Aggregate("sum", "c_acctbal", "total"), "_ok", with_value=True)
    return df.select("fact_id", F.round(compile_expression("percentage_deduct(proportional_allocator(500, c_acctbal, total), 0.05)", resolver(df.schema)).col, 4).alias("share"))


@query("SELECT user_id AS fact_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def set_latest(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("fact_id", F.col("user_id").cast("bigint")).withColumn("_o", F.struct("ts", "event_id"))
    return latest(e, "fact_id", "_o").select("fact_id", "event_id", "event_type")


@query("SELECT o_orderkey AS fact_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 1 OR o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-31' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey = 7 UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'O'")
def store_lookups(spark, sf_dir):
    s = FactStore(orders(spark, sf_dir))
    a = s.find(o_orderstatus="F", o_custkey=1).select("fact_id").union(s.between("1996-01-01", "1996-01-31").select("fact_id")).distinct()
    gone = s.delete(s.find(o_orderstatus="O")).scan().where("o_totalprice > 150000").select("fact_id")
    return a.union(s.get(7).select("fact_id")).union(gone)


@query("SELECT c_custkey AS fact_id, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + s_suppkey, s_name FROM (SELECT row_number() OVER (ORDER BY s_name) AS s_suppkey, s_name FROM supplier)")
def store_update_insert(spark, sf_dir):
    c = facts(spark, sf_dir, "customer", "c_custkey").select("fact_id", "c_acctbal", "c_mktsegment")
    s = FactStore(c).update(c.where("c_acctbal < 0").select("fact_id", F.lit("DEBT").alias("c_mktsegment")))
    new = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("external_id"), F.col("s_name").alias("c_mktsegment"))
    return s.insert(new).scan().select("fact_id", "c_mktsegment")


@query("SELECT event_id AS fact_id, event_type, round(value, 4) AS value, user_id FROM events")
def json_round_trip(spark, sf_dir):
    e = events(spark, sf_dir).select("fact_id", "event_ts", "event_type", "value", F.col("user_id").cast("bigint").alias("user_id"))
    back = json_io.promote(json_io.parse(json_io.serialize(e)), {"event_type": "string", "value": "double", "user_id": "bigint"})
    return back.select("fact_id", "event_type", F.round("value", 4).alias("value"), "user_id")


@query("SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id, 0 AS action_seq FROM orders WHERE o_totalprice > 100000 AND NOT o_totalprice > 150000")
def retraction(spark, sf_dir):
    """Firings that vanish when orders above a price are marked down."""
    e, df = Engine([Rule(1, "large", (Test("o_totalprice", "gt", 100000),), (Log("large"),))]), orders(spark, sf_dir)
    after = df.withColumn("o_totalprice", F.when(F.col("o_totalprice") <= 150000, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return retracted(e.evaluate(df), e.evaluate(after))


@query("SELECT o_orderkey AS fact_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def global_positions(spark, sf_dir):
    return positions(orders(spark, sf_dir), ["o_orderdate", "o_orderkey"]).select("fact_id", F.col("_pos").cast("bigint").alias("pos"))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM events WHERE event_type = 'click' UNION ALL SELECT 2, event_id FROM events WHERE value > 50 UNION ALL SELECT 3, event_id FROM events UNION ALL SELECT 4, event_id FROM events WHERE user_id = 7")
def ragged_facts(spark, sf_dir):
    """Facts as maps of tagged cells: typed equality, missing fields."""
    e = events(spark, sf_dir).select("fact_id", "event_type", F.col("value").cast("double").alias("value"), F.col("user_id").cast("bigint").alias("user_id"))
    ragged = json_io.parse(json_io.serialize(e))
    rules = [Rule(1, "text", (Test("event_type", "eq", "click"),)), Rule(2, "order", (Test("value", "gt", 50),)), Rule(3, "missing", (Test("nothing", "ne", 1),)), Rule(4, "whole", (Test("user_id", "eq", 7),)), Rule(5, "typed", (Test("user_id", "eq", 7.0),))]
    return ragged_matches(ragged, rules)


@query("SELECT CAST(p_size AS BIGINT) AS rule_id, count(*) AS facts, count(*) AS actions FROM part WHERE p_size BETWEEN 1 AND 40 GROUP BY p_size ORDER BY facts DESC, rule_id LIMIT 5")
def top_firing_rules(spark, sf_dir):
    return top_rules(Engine(SIZES).evaluate(facts(spark, sf_dir, "part", "p_partkey")), 5)


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM events WHERE user_id = 7 UNION ALL SELECT 2, event_id FROM events WHERE event_type = 'view'")
def wire_ingest(spark, sf_dir):
    """Messages with one-of values, matched as ragged facts."""
    part = lambda **k: F.struct(*(k.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("string_value", "string"), ("number_value", "double"), ("bool_value", "boolean"), ("int_value", "bigint"))))
    data = F.create_map(F.lit("event_type"), part(string_value=F.col("event_type")), F.lit("value"), part(number_value=F.col("value")), F.lit("user_id"), part(int_value=F.col("user_id")))
    messages = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), data.alias("data"), F.unix_timestamp("event_ts").alias("created_at"))
    return ragged_matches(wire.from_messages(messages), [Rule(1, "user", (Test("user_id", "eq", 7),)), Rule(2, "view", (Test("event_type", "eq", "view"),))])


@query("SELECT '1' AS rule_id, CAST(c_custkey AS VARCHAR) AS fact_id, CAST(2 AS INTEGER) AS n FROM customer WHERE c_acctbal < 0")
def wire_results(spark, sf_dir):
    rules = [Rule(1, "low", (Test("c_acctbal", "lt", 0),), (Log("low"), SetField("state", "watch")))]
    return wire.to_messages(Engine(rules).evaluate(facts(spark, sf_dir, "customer", "c_custkey"))).select("rule_id", "fact_id", F.size("actions").alias("n"))
