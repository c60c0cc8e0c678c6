"""More of the catalogue: the expression language's edges, calculators, aggregate modes and orders of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweft.functions.calculators import calculate, register
from ruleweft.functions.expr import Typed, compile_expression, function, parse, variables
from ruleweft.model import Aggregate, All, CreateFact, Log, NoneOf, Rule, RuleError, SetField, Test
from ruleweft.operators import aggregates as A
from ruleweft.operators import conflict
from ruleweft.operators.predicates import resolver
from ruleweft.plans.catalogue import EXECUTIONS, RANKED, facts, lineitem, match, orders, query
from ruleweft.plans.engine import Engine


def compiler(df, **options):
    return lambda text: compile_expression(text, resolver(df.schema), **options).col


@query("""SELECT l_orderkey * 10 + l_linenumber AS fact_id, round(l_extendedprice / l_quantity, 4) AS unit_price, l_linenumber / 2 AS half, CAST(trunc(l_linenumber / 2) AS BIGINT) AS whole, abs(l_quantity - 25) AS distance,
abs(l_linenumber - 4) AS steps, l_discount = 0.05 AS near, l_discount + 0.01 > 0.05 AS above FROM lineitem""")
def dsl_arithmetic(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    c = compiler(df)
    return df.select(
        "fact_id", c("round(l_extendedprice / l_quantity, 4)").alias("unit_price"), c("l_linenumber / 2").alias("half"), c("div(l_linenumber, 2)").cast("bigint").alias("whole"), c("abs(l_quantity - 25)").alias("distance"),
        c("abs(l_linenumber - 4)").cast("int").alias("steps"), c("l_discount == 0.05").alias("near"), c("l_discount + 0.01 > 0.05").alias("above"),
    )


@query("""SELECT c_custkey AS fact_id, nullif(c_mktsegment, 'BUILDING') IS NULL AS is_null, nullif(c_mktsegment, 'BUILDING') IS NOT NULL AS is_not_null, false AS cross_type, c_mktsegment = 'FURNITURE' AS same,
c_name < 'Customer#000000050' AS before, c_name >= 'Customer#000000010' AS at_least FROM customer""")
def dsl_equality_and_order(spark, sf_dir):
    df = facts(spark, sf_dir, "customer", "c_custkey").withColumn("some", F.nullif("c_mktsegment", F.lit("BUILDING")))
    c = compiler(df)
    return df.select(
        "fact_id", c("some == null").alias("is_null"), c("some != null").alias("is_not_null"), c("c_custkey == c_name").alias("cross_type"), c('c_mktsegment == "FURNITURE"').alias("same"),
        c('c_name < "Customer#000000050"').alias("before"), c('c_name >= "Customer#000000010"').alias("at_least"),
    )


@query("""SELECT o_orderkey AS fact_id, array_to_string(list_append(string_split(o_orderpriority, '-'), o_orderstatus), ',') AS parts, list_append(string_split(o_orderpriority, '-'), o_orderstatus)[-1] AS last, len(string_split(o_orderpriority, '-')) AS n,
o_totalprice * 2 AS twice, o_custkey AS customer, o_orderdate < TIMESTAMP '1997-01-01' AS early, o_orderdate >= TIMESTAMP '1996-06-30' AS late FROM orders""")
def dsl_containers_and_dates(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("tags", F.split("o_orderpriority", "-"))
    c = compiler(df)
    return df.select(
        "fact_id", F.array_join(c("push(tags, o_orderstatus)"), ",").alias("parts"), c("push(tags, o_orderstatus)[-1]").alias("last"), c("length(tags)").alias("n"), c("{twice: o_totalprice * 2, who: o_custkey}.twice").alias("twice"),
        c('{twice: o_totalprice * 2, who: o_custkey}["who"]').alias("customer"), c('event_ts < date("1997-01-01T00:00:00Z")').alias("early"), c('event_ts >= date("1996-06-30T00:00:00Z")').alias("late"),
    )


@query("SELECT o_orderkey AS fact_id, c_mktsegment AS segment, round(o_totalprice + c_acctbal, 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey")
def dsl_fact_lookup(spark, sf_dir):
    """Another fact's fields by the id that a field holds: a join that the plan has already made."""
    c = facts(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").cast("string").alias("_key"), "c_mktsegment", "c_acctbal")
    df = orders(spark, sf_dir).withColumn("customer", F.col("o_custkey").cast("string"))
    both = df.join(c, df["customer"] == c["_key"])
    own = compiler(both, lookup=lambda _, name: (F.col(name), both.schema[name].dataType))
    return both.select("fact_id", own("customer.c_mktsegment").alias("segment"), F.round(own("o_totalprice + customer.c_acctbal"), 4).alias("total"))


@query("SELECT * FROM (VALUES ('a + b * max(c, 2)', 'a,b,c'), ('if x > 1 then y else \"z\"', 'x,y'), ('[p, q][0] ++ r', 'p,q,r')) AS t(expression, names)")
def dsl_variables(spark, sf_dir):
    texts = ["a + b * max(c, 2)", 'if x > 1 then y else "z"', "[p, q][0] ++ r"]
    return spark.createDataFrame([(t, ",".join(variables(parse(t)))) for t in texts], "expression string, names string")


@query("SELECT c_custkey AS fact_id, c_acctbal <= 5000 AS passes, CASE WHEN c_acctbal <= 5000 THEN 'Ok' ELSE 'Breach' END AS status, round(CASE WHEN c_acctbal <= 5000 THEN 0 ELSE abs(c_acctbal - 5000) END, 4) AS violation FROM customer")
def calc_threshold_violation(spark, sf_dir):
    df = facts(spark, sf_dir, "customer", "c_custkey")
    x = compiler(df)('threshold_violation(c_acctbal, 5000, "LessThanOrEqual")')
    return df.select("fact_id", x["passes"].alias("passes"), x["status"].alias("status"), F.round(x["violation_amount"], 4).alias("violation"))


@query("SELECT * FROM (VALUES ('add', 'calculator: Missing argument ''b'''), ('add', 'calculator: Invalid argument ''a'': expected number'), ('nothing', 'calculator: calculator ''nothing'' not found')) AS t(name, error)")
def calc_argument_errors(spark, sf_dir):
    one, text = Typed(F.lit(1.0), "number"), Typed(F.lit("x"), "string")
    out = []
    for name, inputs in (("add", {"a": one}), ("add", {"a": text, "b": one}), ("nothing", {})):
        try:
            calculate(name, inputs)
        except RuleError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "name string, error string")


@query("SELECT l_orderkey * 10 + l_linenumber AS fact_id, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge, upper(l_returnflag) || '!' AS loud FROM lineitem")
def registries(spark, sf_dir):
    """A user's calculator and a user's function of the language."""
    register("charge", {"price": "number", "discount": "number", "tax": "number"}, lambda price, discount, tax: price * (1 - discount) * (1 + tax))
    function("loud", 1, 1)(lambda x: Typed(F.concat(F.upper(x.col), F.lit("!")), "string"))
    df = lineitem(spark, sf_dir)
    c = compiler(df)
    return df.select("fact_id", F.round(c("charge(l_extendedprice, l_discount, l_tax)"), 4).alias("charge"), c("loud(l_returnflag)").alias("loud"))


@query("SELECT 'same' AS plan, 1 AS parsed")
def expression_cache(spark, sf_dir):
    """Equal texts are parsed once."""
    return spark.createDataFrame([("same", len({id(parse("a + b * 2")) for _ in range(5)}))], "plan string, parsed int")


# aggregates


@query("SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING exp(avg(ln(o_totalprice))) > 90000)")
def agg_custom(spark, sf_dir):
    """A user's aggregate in a rule: the geometric mean, as a composition of built-in aggregates."""
    A.register_aggregate("geometric_mean", lambda x: F.exp(F.avg(F.ln(x))))
    return match([Rule(1, "typical", (Aggregate("geometric_mean", "o_totalprice", "g", ("o_custkey",), having=Test("g", "gt", 90000.0)),))], orders(spark, sf_dir))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def agg_no_having(spark, sf_dir):
    """Without a condition on its value an aggregate holds where its group has the field."""
    df = orders(spark, sf_dir).withColumn("done", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    spec = Aggregate("sum", "done", "s", ("o_custkey",))
    return match([Rule(1, "some", (spec,)), Rule(2, "none", (NoneOf((spec,)),))], df)


@query("SELECT CAST(1 AS BIGINT) AS rule_id, CAST(0 AS BIGINT) AS fact_id WHERE false UNION ALL SELECT 2, o_orderkey FROM orders")
def agg_empty_store(spark, sf_dir):
    """Nothing qualifies over an empty store, so only the negation holds."""
    df = orders(spark, sf_dir)
    spec = Aggregate("count", "o_orderkey", "n", ("o_custkey",), having=Test("n", "ge", 0))
    none = df.limit(0)
    fired = Engine([Rule(1, "any", (spec,))]).matches(none)
    own = A.attach(df, none, spec, "_ok")
    return fired.unionByName(own.where("NOT _ok").select(F.lit(2).cast("bigint").alias("rule_id"), "fact_id"))


@query("SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS total, count(*) AS n, round(list_sort(list(o_totalprice))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1], 4) AS mid FROM orders GROUP BY 1")
def agg_strict_strings(spark, sf_dir):
    """Strict mode reads numbers from text."""
    df = orders(spark, sf_dir).withColumn("price", F.col("o_totalprice").cast("string"))
    v = lambda f, p=None: A.value(f, F.col("price"), df.schema["price"].dataType, "strict", p)
    return df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(v("sum"), 2).alias("total"), v("count").alias("n"), F.round(v("percentile", 50), 4).alias("mid"))


@query("SELECT * FROM (VALUES ('rule', true), ('strict', false), ('lazy', true)) AS t(mode, computed)")
def agg_missing_field_modes(spark, sf_dir):
    """A fact without the field is an error in strict mode only."""
    df = orders(spark, sf_dir).withColumn("done", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    out = []
    for mode in A.MODES:
        try:
            df.agg(A.value("sum", F.col("done"), df.schema["done"].dataType, mode).alias("s")).collect()
            out.append((mode, True))
        except Exception as e:
            out.append((mode, "Field is missing" not in str(e)))
    return spark.createDataFrame(out, "mode string, computed boolean")


@query("SELECT o_custkey AS customer, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'X'), 0) AS total, CAST(0 AS BIGINT) AS n, CAST('infinity' AS DOUBLE) AS least, CAST('-infinity' AS DOUBLE) AS most, 0.0 AS deviation FROM orders GROUP BY 1")
def agg_empty_groups(spark, sf_dir):
    """Groups in which no fact has a number."""
    df = orders(spark, sf_dir).withColumn("x", F.when(F.col("o_orderstatus") == "X", F.col("o_totalprice")))
    v = lambda f: A.value(f, F.col("x"), df.schema["x"].dataType)
    return df.groupBy(F.col("o_custkey").alias("customer")).agg(v("sum").alias("total"), v("count").alias("n"), v("min").alias("least"), v("max").alias("most"), v("stddev").alias("deviation"))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, o_orderkey AS fact_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12) UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def agg_shared(spark, sf_dir):
    """Equal aggregates of two rules are computed once."""
    spec = Aggregate("count", "o_orderkey", "n", ("o_custkey",), having=Test("n", "gt", 12))
    return match([Rule(1, "many", (spec,)), Rule(2, "many done", (Test("o_orderstatus", "eq", "F"), spec))], orders(spark, sf_dir))


@query("SELECT l_orderkey AS fact_id, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS average FROM lineitem GROUP BY l_orderkey")
def calc_weighted_average(spark, sf_dir):
    items = lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("fact_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("weight")))).alias("items"))
    return items.select("fact_id", F.round(compiler(items)("weighted_average(items)"), 4).alias("average"))


@query("SELECT o_orderkey AS fact_id, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 4) AS mean, min(o_totalprice) OVER w AS least, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def agg_accumulate_functions(spark, sf_dir):
    out, none = orders(spark, sf_dir), F.lit(False)
    for f, name in (("count", "n"), ("avg", "mean"), ("min", "least"), ("max", "most")):
        out = A.accumulate(out, "o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], none, f).withColumnRenamed("accumulated", name)
    return out.select("fact_id", "n", F.round("mean", 4).alias("mean"), "least", "most")


# orders of rules that fire together


def executions(spark, sf_dir):
    done = match(RANKED, orders(spark, sf_dir)).join(F.broadcast(conflict.metadata(spark, RANKED)), "rule_id")
    return done.withColumn("triggered_at", F.col("rule_id") * 7 % 5)


def ranked(name: str, order: str, primary: str | Callable[[], Column], tie: str) -> None:
    def f(spark, sf_dir):
        return conflict.resolve(executions(spark, sf_dir), primary if isinstance(primary, str) else primary(), tie, conflict_set=["fact_id"]).select("rule_id", "fact_id", "rank")

    f.__name__ = f"conflict_{name}"
    named = f"SELECT *, CASE rule_id WHEN 1 THEN 'large' WHEN 2 THEN 'open' ELSE 'urgent' END AS rule_name, 0 AS salience, rule_id * 7 % 5 AS triggered_at FROM ({EXECUTIONS})"
    query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, fact_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY {order}, rule_id) AS INTEGER) AS rank FROM ({named})")(f)


ranked("by_name", "rule_name, priority DESC", "name", "priority")
ranked("by_recency", "triggered_at DESC, rule_name", "recency", "name")
ranked("by_salience", "salience DESC, specificity DESC", "salience", "specificity")
ranked("default", "priority DESC, triggered_at DESC", "priority", "recency")
ranked("custom", "fact_id * rule_id % 7, rule_name", lambda: F.col("fact_id") * F.col("rule_id") % 7, "name")


@query("SELECT o_orderkey AS fact_id, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules FROM (SELECT CAST(rule_id AS BIGINT) AS rule_id, fact_id AS o_orderkey FROM (" + EXECUTIONS + ")) GROUP BY 1")
def set_distinct_rules(spark, sf_dir):
    return match(RANKED, orders(spark, sf_dir)).groupBy("fact_id").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


FLOW = [
    Rule(1, "a", (Test("x", "gt", 1),), (SetField("y", 1),)), Rule(2, "b", (Test("y", "eq", 1), Test("w", "gt", 0)), (SetField("z", 1),)), Rule(3, "c", (Test("z", "eq", 1), Test("y", "eq", 2)), (SetField("z", 2),)),
    Rule(4, "d", (Test("q", "eq", 1),), (CreateFact({"r": 1}),)), Rule(5, "e", (All((Test("y", "gt", 3), Test("w", "lt", 9))),), (Log("x"),)),
]


@query("""SELECT CAST(s AS BIGINT) AS source, CAST(t AS BIGINT) AS target, kind, CAST(strength AS DOUBLE) AS strength, f AS fields FROM (VALUES (1, 2, 'data_flow', 0.8, 'y'), (1, 3, 'data_flow', 0.8, 'y'), (1, 5, 'data_flow', 0.8, 'y'), (2, 3, 'data_flow', 0.8, 'z'),
(2, 5, 'condition_similarity', 1.0, 'w,y'), (2, 3, 'field_conflict', 0.6, 'z')) AS x(s, t, kind, strength, f)""")
def rule_dependencies(spark, sf_dir):
    from ruleweft.plans import dependency

    return spark.createDataFrame([(d.source, d.target, d.kind, d.strength, ",".join(d.fields)) for d in dependency.dependencies(FLOW)], "source bigint, target bigint, kind string, strength double, fields string")


@query("SELECT CAST(id AS BIGINT) AS rule_id, before, CAST(cluster AS BIGINT) AS cluster_size, critical FROM (VALUES (1, true, 1, true), (2, true, 1, true), (3, true, 1, true), (4, true, 1, false), (5, true, 1, false)) AS x(id, before, cluster, critical)")
def rule_order(spark, sf_dir):
    """Whether each rule follows all that write what it reads, the size of its cycle, and the critical path."""
    from ruleweft.plans import dependency

    order, size = dependency.order(FLOW), {k: len(c) for c in dependency.clusters(FLOW) for k in c}
    flows = [d for d in dependency.dependencies(FLOW) if d.kind == "data_flow"]
    path = dependency.critical_path(FLOW)
    rows = [(r.id, all(order.index(d.source) < order.index(d.target) for d in flows if d.target == r.id), size[r.id], r.id in path) for r in FLOW]
    return spark.createDataFrame(rows, "rule_id bigint, before boolean, cluster_size bigint, critical boolean")


@query("SELECT * FROM (VALUES ('dot', 5, 6), ('mermaid', 5, 6), ('svg', 5, 6), ('json', 5, 6)) AS t(form, boxes, lines)")
def rule_drawing(spark, sf_dir):
    import json

    from ruleweft.plans import dependency

    d = {f: dependency.draw(FLOW, f) for f in ("dot", "mermaid", "svg", "json")}
    plain = json.loads(d["json"])
    rows = [("dot", d["dot"].count('label="') - d["dot"].count("->"), d["dot"].count("->")), ("mermaid", d["mermaid"].count('["'), d["mermaid"].count("-->")), ("svg", d["svg"].count("<rect"), d["svg"].count("<line")), ("json", len(plain["rules"]), len(plain["dependencies"]))]
    return spark.createDataFrame(rows, "form string, boxes int, lines int")


@query("SELECT c_custkey AS fact_id, 1 AS n, 'integer' AS whole, typeof_value AS real FROM (SELECT c_custkey, 'float' AS typeof_value FROM customer)")
def expression_types(spark, sf_dir):
    df = facts(spark, sf_dir, "customer", "c_custkey")
    name = lambda text: (lambda x: F.lit("integer" if x.whole else "float"))(compile_expression(text, resolver(df.schema)))
    return df.select("fact_id", compile_expression("1", resolver(df.schema)).col.cast("int").alias("n"), name("c_custkey * 2").alias("whole"), name("c_custkey * 2.0").alias("real"))
