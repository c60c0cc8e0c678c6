"""More of the catalogue: what rules change, staged pipelines, the store, the engine's registry, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.model import Aggregate, Alert, Append, Calculate, CreateFact, Formula, Frame, Increment, Log, Notify, Rule, RuleError, SetField, StreamTest, Test, UpdateFact
from ruleweft.operators import joins
from ruleweft.plans.catalogue import events, facts, match, ntz, orders, query, win
from ruleweft.plans.engine import Engine, apply
from ruleweft.plans.pipeline import Stage, run, to_fixpoint
from ruleweft.sources import json_io
from ruleweft.sources.shared import new_folder
from ruleweft.sources.store import FactStore
from ruleweft.streaming import run as R
from ruleweft.streaming import windows as W

# changes and pipelines


@query("SELECT o_orderkey AS fact_id, CASE WHEN o_totalprice > 150000 THEN 'vip' END AS tier, CASE WHEN o_totalprice > 150000 THEN round(o_totalprice * 0.1, 4) END AS rebate, CASE WHEN o_totalprice > 180000 THEN 'call' END AS note FROM orders")
def pipeline_new_field(spark, sf_dir):
    """A field that one stage adds is tested and read by the next ones."""
    df = orders(spark, sf_dir).select("fact_id", "o_totalprice")
    stages = [
        Stage("grade", (Rule(1, "vip", (Test("o_totalprice", "gt", 150000),), (SetField("tier", "vip"),)),)),
        Stage("rebate", (Rule(2, "rebate", (Test("tier", "eq", "vip"),), (Formula("rebate", "o_totalprice * share"),)),), ("grade",)),
        Stage("note", (Rule(3, "note", (Test("rebate", "gt", 18000.0),), (SetField("note", "call"),)),), ("rebate",)),
    ]
    return run(stages, df, constants={"share": 0.1})[0].select("fact_id", "tier", F.round("rebate", 4).alias("rebate"), "note")


@query("""SELECT c_custkey AS fact_id, CASE WHEN k.t IS NOT NULL THEN 'reviewed' ELSE c_mktsegment END AS c_mktsegment, k.t IS NOT NULL AS checked FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS t FROM orders WHERE o_totalprice > 180000) k ON c_custkey = k.t
UNION ALL SELECT o_orderkey + 10000000, NULL, false FROM orders""")
def action_update_applied(spark, sf_dir):
    """Orders update the customers that they name; a field that customers lacked is new."""
    c = facts(spark, sf_dir, "customer", "c_custkey").select("fact_id", "c_mktsegment")
    o = orders(spark, sf_dir).select((F.col("o_orderkey") + 10_000_000).alias("fact_id"), F.col("o_custkey").alias("customer"), "o_totalprice")
    both = c.unionByName(o, allowMissingColumns=True)
    out = apply(both, [Rule(1, "review", (Test("o_totalprice", "gt", 180000),), (UpdateFact("customer", {"c_mktsegment": "reviewed", "checked": True}),))])
    return out.select("fact_id", "c_mktsegment", F.coalesce("checked", F.lit(False)).alias("checked"))


@query("SELECT o_orderkey AS fact_id, array_to_string(CASE WHEN o_totalprice > 150000 THEN list_append(string_split(o_orderpriority, '-'), 'premium') ELSE string_split(o_orderpriority, '-') END, ',') AS tags, CASE WHEN o_totalprice > 150000 THEN 7 END AS seen FROM orders")
def action_append_applied(spark, sf_dir):
    df = orders(spark, sf_dir).select("fact_id", "o_totalprice", F.split("o_orderpriority", "-").alias("tags"))
    out = apply(df, [Rule(1, "append", (Test("o_totalprice", "gt", 150000),), (Append("tags", "premium"), Append("seen", 7)))])
    return out.select("fact_id", F.array_join("tags", ",").alias("tags"), F.element_at("seen", 1).cast("int").alias("seen"))


@query("SELECT c_custkey AS fact_id, CASE WHEN c_acctbal < 0 THEN 'none' ELSE CAST(c_custkey AS VARCHAR) END AS code, c_acctbal < 0 AS is_text FROM customer")
def action_type_change(spark, sf_dir):
    """A field that gets values of another kind keeps both kinds, as tagged cells."""
    df = facts(spark, sf_dir, "customer", "c_custkey").select("fact_id", "c_acctbal", F.col("c_custkey").alias("code"))
    out = apply(df, [Rule(1, "text", (Test("c_acctbal", "lt", 0),), (SetField("code", "none"),))])
    again = Engine([Rule(2, "is text", (Test("code", "eq", "none"),), (SetField("is_text", True),))]).apply(out)
    return again.select("fact_id", F.coalesce("code.s", F.col("code.i").cast("string")).alias("code"), F.coalesce("is_text", F.lit(False)).alias("is_text"))


@query("""WITH made AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 + 1000000 AS fact_id, o_custkey AS customer FROM orders WHERE o_totalprice > 180000)
SELECT o_orderkey AS fact_id, NULL AS customer, NULL AS state FROM orders UNION ALL SELECT fact_id, customer, CASE WHEN customer > 50 THEN 'queued' END FROM made""")
def pipeline_created_facts(spark, sf_dir):
    """Facts that one stage creates are facts of the next one; their types follow from the rule."""
    df = orders(spark, sf_dir).select("fact_id", "o_totalprice", "o_custkey")
    one = Stage("open", (Rule(1, "case", (Test("o_totalprice", "gt", 180000),), (CreateFact({"customer": "{{o_custkey}}"}),)),))
    two = Stage("queue", (Rule(2, "queue", (Test("customer", "gt", 50),), (SetField("state", "queued"),)),), ("open",))
    return run([one, two], df, first_id=1_000_000)[0].select("fact_id", "customer", "state")


@query("SELECT CAST(x AS BIGINT) AS level, CAST(2 AS BIGINT) AS rounds FROM (VALUES (0), (1), (2), (3)) AS t(x)")
def fixpoint(spark, sf_dir):
    e = Engine([Rule(i, f"r{i}", (Test("level", "eq", i),), (CreateFact({"level": i + 1}),)) for i in (1, 2)])
    out, rounds = to_fixpoint(e, spark.createDataFrame([(1, 0), (2, 1)], "fact_id bigint, level bigint"))
    return out.select("level", F.lit(rounds).cast("bigint").alias("rounds"))


@query("SELECT event_id AS fact_id, event_type = 'click' AS clicked, CAST(user_id + CASE WHEN event_type = 'click' THEN 100 ELSE 0 END AS BIGINT) AS user_id FROM events")
def ragged_apply(spark, sf_dir):
    """Ragged facts through the full engine: an equality, an increment, a new field, and back into the map."""
    e = events(spark, sf_dir).select("fact_id", "event_type", F.col("user_id").cast("bigint").alias("user_id"))
    rules = [Rule(1, "click", (Test("event_type", "eq", "click"),), (SetField("clicked", True), Increment("user_id", 100)))]
    out = json_io.promote(Engine(rules).apply_ragged(json_io.parse(json_io.serialize(e))), {"clicked": "boolean", "user_id": "bigint"})
    return out.select("fact_id", F.coalesce("clicked", F.lit(False)).alias("clicked"), "user_id")


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING sum(value) > 2000) UNION ALL SELECT 2, event_id FROM events WHERE event_type = 'view' AND value > 50")
def ragged_aggregate(spark, sf_dir):
    """Aggregates and looked-up equalities over ragged facts."""
    e = events(spark, sf_dir).select("fact_id", "event_type", F.col("value").cast("double").alias("value"), F.col("user_id").cast("bigint").alias("user_id"))
    rules = [Rule(1, "busy", (Aggregate("sum", "value", "s", ("user_id",), having=Test("s", "gt", 2000)),), (Log("busy"),)), Rule(2, "view", (Test("event_type", "eq", "view"), Test("value", "gt", 50)), (Log("view"),))]
    return Engine(rules).evaluate_ragged(json_io.parse(json_io.serialize(e))).select("rule_id", "fact_id")


# frames without keys


def keyless(name: str, sql: str, frame: Frame, over: float) -> None:
    def f(spark, sf_dir):
        return match([Rule(1, name, (Aggregate("sum", "value", "s", having=Test("s", "gt", over), frame=frame),))], events(spark, sf_dir))

    f.__name__ = f"frame_keyless_{name}"
    query(f"SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM ({sql})")(f)


keyless("time", "SELECT event_id, sum(value) OVER (ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS s FROM events QUALIFY s > 150", Frame("time", 3_600_000), 150.0)
keyless("session", "SELECT event_id, sum(value) OVER (PARTITION BY g) AS s FROM (SELECT *, sum(n) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (ORDER BY ts, event_id) > 600000 THEN 1 ELSE 0 END AS n FROM events)) QUALIFY s > 200", Frame("session", 600_000), 200.0)


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM (SELECT event_id, sum(value) OVER (PARTITION BY b) AS s FROM (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS b FROM events) QUALIFY s > 2000)")
def frame_missing_group(spark, sf_dir):
    """A group field that no fact has counts as null for all."""
    return match([Rule(1, "block", (Aggregate("sum", "value", "s", ("nowhere",), having=Test("s", "gt", 2000), frame=Frame("block", 50)),))], events(spark, sf_dir))


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM (SELECT event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS s FROM events QUALIFY s > 100) WHERE ts >= TIMESTAMP '2024-01-10'")
def frame_history(spark, sf_dir):
    """A frame that reaches into earlier facts."""
    e, cut = events(spark, sf_dir), F.lit("2024-01-10").cast("timestamp")
    spec = Aggregate("sum", "value", "s", ("user_id",), having=Test("s", "gt", 100), frame=Frame("time", 86_400_000))
    return Engine([Rule(1, "day", (spec,))]).matches(e.where(F.col("event_ts") >= cut), history=e.where(F.col("event_ts") < cut))


# the store


@query("SELECT c_custkey AS fact_id, c_name AS external_id, c_mktsegment AS segment FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000011')")
def store_external_id(spark, sf_dir):
    """Facts and single fields by external id."""
    s = FactStore(facts(spark, sf_dir, "customer", "c_custkey").withColumn("external_id", F.col("c_name")))
    one = s.by_external_id("Customer#000000007").select("fact_id", "external_id", F.col("c_mktsegment").alias("segment"))
    other = s.by_external_id("Customer#000000011").select("fact_id", "external_id").crossJoin(F.broadcast(s.field_of("Customer#000000011", "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")))
    return one.unionByName(other)


@query("SELECT (SELECT count(*) FROM customer) AS facts, CAST(0 AS BIGINT) AS after_clear, false AS empty, true AS empty_after, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS of_customer")
def store_size(spark, sf_dir):
    """Counts, clearing, and lookups in a store dealt by the field that they use."""
    s = FactStore(facts(spark, sf_dir, "customer", "c_custkey"))
    own = FactStore(orders(spark, sf_dir)).partitioned_by("o_custkey").find(o_custkey=7).count()
    none = s.clear()
    return spark.createDataFrame([(s.count(), none.count(), s.is_empty(), none.is_empty(), own)], "facts bigint, after_clear bigint, empty boolean, empty_after boolean, of_customer bigint")


@query("SELECT c_custkey AS fact_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def store_update_null(spark, sf_dir):
    """An update may write a null."""
    c = facts(spark, sf_dir, "customer", "c_custkey").select("fact_id", "c_acctbal", "c_mktsegment")
    return FactStore(c).update(c.where("c_acctbal < 0").select("fact_id", F.lit(None).cast("string").alias("c_mktsegment")), nulls=True).scan().select("fact_id", "c_mktsegment")


# joins


@query("SELECT o_orderkey AS fact_id, c_custkey AS earlier_id FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inferred(spark, sf_dir):
    """Keys by name: both tables call the customer's id the same."""
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "customer_id").drop("event_ts")
    c = facts(spark, sf_dir, "customer", "c_custkey").withColumn("customer_id", F.col("c_custkey"))
    return joins.join(o, c, joins.inferred(o, c)).select("fact_id", F.col("earlier_fact_id").alias("earlier_id"))


@query("SELECT a.o_orderkey AS fact_id, b.o_orderkey AS earlier_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate >= b.o_orderdate AND a.o_totalprice <= b.o_totalprice")
def join_or_equal(spark, sf_dir):
    o = orders(spark, sf_dir)
    return joins.join(o, o, [joins.JoinTest("o_custkey", "o_custkey"), joins.JoinTest("o_orderdate", "o_orderdate", "ge"), joins.JoinTest("o_totalprice", "o_totalprice", "le")]).select("fact_id", F.col("earlier_fact_id").alias("earlier_id"))


CHAIN = "SELECT a.user_id, a.event_id AS id0, b.event_id AS id1, c.event_id AS id2 FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 7200 SECOND JOIN events c ON c.user_id = b.user_id AND c.ts >= b.ts AND c.ts <= a.ts + INTERVAL 7200 SECOND WHERE a.event_type = 'view' AND b.event_type = 'click' AND c.event_type = 'purchase'"


@query(CHAIN)
def match_chain(spark, sf_dir):
    """Views, clicks and purchases of one user in this order, within two hours of the first."""
    e = events(spark, sf_dir)
    return W.chained([e.where(F.col("event_type") == t) for t in ("view", "click", "purchase")], "user_id", 7_200_000).select("user_id", "id0", "id1", "id2")


# the registry


@query("SELECT * FROM (VALUES ('duplicate refused', true), ('update replaces', true), ('remove forgets', true), ('sessions apart', true), ('unknown refused', true)) AS t(what, holds)")
def engine_registry(spark, sf_dir):
    df = facts(spark, sf_dir, "customer", "c_custkey")
    high, low = Rule(1, "r", (Test("c_acctbal", "gt", 0),)), Rule(1, "r", (Test("c_acctbal", "lt", 0),))
    e, other = Engine([high]), Engine()

    def refused(f) -> bool:
        try:
            f()
        except RuleError:
            return True
        return False

    out = [("duplicate refused", refused(lambda: e.add(low)))]
    e.update(low)
    out.append(("update replaces", e.matches(df).count() == df.where("c_acctbal < 0").count()))
    out.append(("sessions apart", other.matches(df).count() == 0))
    e.remove(1)
    out += [("remove forgets", e.matches(df).count() == 0), ("unknown refused", refused(lambda: e.remove(1)))]
    return spark.createDataFrame(out, "what string, holds boolean")


@query("SELECT CAST(r AS BIGINT) AS rule_id, c AS condition, h AS holds FROM (SELECT 1 AS r, 0 AS c, c_acctbal > 0 AS h FROM customer WHERE c_custkey = 7 UNION ALL SELECT 1, 1, c_mktsegment = 'BUILDING' FROM customer WHERE c_custkey = 7 UNION ALL SELECT 2, 0, (SELECT sum(c_acctbal) > 100 FROM customer b WHERE b.c_nationkey = a.c_nationkey) FROM customer a WHERE c_custkey = 7)")
def explain_firing(spark, sf_dir):
    rules = [Rule(1, "a", (Test("c_acctbal", "gt", 0), Test("c_mktsegment", "eq", "BUILDING"))), Rule(2, "b", (Aggregate("sum", "c_acctbal", "s", ("c_nationkey",), having=Test("s", "gt", 100)),))]
    return Engine(rules).explain_firing(facts(spark, sf_dir, "customer", "c_custkey"), 7).select("rule_id", "condition", "holds")


@query("SELECT CAST(3 AS BIGINT) AS rules, CAST(2 AS BIGINT) AS enabled, (SELECT count(*) FILTER (WHERE c_acctbal < 0) * 2 + count(*) FILTER (WHERE c_acctbal > 5000) FROM customer) AS firings, (SELECT count(*) FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000) AS facts_fired, CAST(2 AS BIGINT) AS rules_fired")
def engine_statistics(spark, sf_dir):
    e = Engine([Rule(1, "low", (Test("c_acctbal", "lt", 0),), (Log("a"), Log("b"))), Rule(2, "high", (Test("c_acctbal", "gt", 5000),), (Log("c"),)), Rule(3, "off", (Test("c_acctbal", "gt", 0),), (Log("d"),), enabled=False)])
    return e.statistics(e.evaluate(facts(spark, sf_dir, "customer", "c_custkey")))


@query("SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'type'), (CAST(3 AS BIGINT), 'expression')) AS t(rule_id, error)")
def validate_only(spark, sf_dir):
    df = facts(spark, sf_dir, "customer", "c_custkey")
    rules = [Rule(1, "good", (Test("c_acctbal", "gt", 0),), (Log("x"),)), Rule(2, "order", (Test("c_name", "gt", 3),)), Rule(3, "unknown", (Test("c_acctbal", "gt", 0),), (Formula("x", "no_such + 1"),))]
    return spark.createDataFrame([(r.id, Engine([r]).validate(df)[0].kind) for r in rules if Engine([r]).validate(df)], "rule_id bigint, error string")


# streams


def event_stream(spark, sf_dir) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir).withColumn("event_ts", F.col("ts").cast("timestamp")).withColumn("fact_id", F.col("event_id"))


CLOSED = "(SELECT max(ts) - INTERVAL 60 SECOND FROM events)"
DAILY = f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2) WHERE window_end <= {CLOSED}"


@query(DAILY)
def stream_tumbling_drained(spark, sf_dir):
    """A file stream drained once; the windows that the watermark closes."""
    out = W.stream(event_stream(spark, sf_dir), W.EventWindow("tumbling", 86_400_000), {"n": F.count(F.lit(1)), "s": F.sum("value")})
    return ntz(R.drain(out, "tumbling")).withColumn("s", F.round("s", 4))


@query(f"SELECT * FROM (SELECT s AS window_start, s + INTERVAL 1 DAY AS window_end, user_id, count(*) AS n FROM (SELECT user_id, ts, unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) FOR k IN range(4)]) AS s FROM events) WHERE ts < s + INTERVAL 1 DAY GROUP BY 1, 2, 3) WHERE window_end <= {CLOSED}")
def stream_sliding_drained(spark, sf_dir):
    return ntz(R.drain(W.stream(event_stream(spark, sf_dir), W.EventWindow("sliding", 86_400_000, 21_600_000), {"n": F.count(F.lit(1))}, ("user_id",)), "sliding"))


@query(f"SELECT * FROM (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM (SELECT *, sum(n0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS n0 FROM events)) GROUP BY user_id, g) WHERE window_end <= {CLOSED}")
def stream_session_drained(spark, sf_dir):
    return ntz(R.drain(W.stream(event_stream(spark, sf_dir), W.EventWindow("session", 3_600_000), {"n": F.count(F.lit(1))}, ("user_id",)), "session"))


@query("SELECT user_id AS key, b AS block, count(*) AS n, round(sum(value), 4) AS s FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS b FROM events) GROUP BY ALL HAVING count(*) = 20")
def stream_count_windows(spark, sf_dir):
    out = R.drain(W.count_windows(event_stream(spark, sf_dir), "user_id", "value", 20), "count")
    return out.select("key", "block", "n", F.round("sum", 4).alias("s"))


@query("SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 14400 SECOND")
def stream_join(spark, sf_dir):
    """Events and those of the same user that follow within four hours."""
    e = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "event_ts")
    return R.drain(W.joined(e, e, "user_id", 14_400_000, 86_400_000 * 40), "join").select("l_event_id", "r_event_id")


@query(CHAIN)
def stream_chain(spark, sf_dir):
    """The chain of three steps over a stream: partial chains expire with the watermark."""
    e = event_stream(spark, sf_dir)
    return R.drain(W.chained([e.where(F.col("event_type") == t) for t in ("view", "click", "purchase")], "user_id", 7_200_000, 86_400_000 * 40), "chain").select("user_id", "id0", "id1", "id2")


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id, 'field_set' AS kind FROM events WHERE event_type = 'click' AND value > 20 UNION ALL SELECT 2, event_id, 'calculated' FROM events WHERE value > 50")
def stream_rules(spark, sf_dir):
    """Rules straight over a stream: predicates and actions keep no state."""
    rules = [Rule(1, "click", (Test("event_type", "eq", "click"), Test("value", "gt", 20.0)), (SetField("hot", True),)), Rule(2, "large", (Test("value", "gt", 50.0),), (Calculate("multiply", {"a": "value", "b": 2.0}, "double"),))]
    return R.drain(Engine(rules).evaluate(event_stream(spark, sf_dir)), "rules").select("rule_id", "fact_id", "kind")


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 60)")
def stream_incremental(spark, sf_dir):
    """Micro-batches evaluated once each, with aggregates over all facts so far."""
    e = Engine([Rule(1, "busy", (Aggregate("count", "event_id", "n", ("user_id",), having=Test("n", "gt", 60)),), (Log("busy"),))])
    folder = new_folder(spark, "incremental")
    R.incremental(e, event_stream(spark, sf_dir), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("rule_id", "fact_id")


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id, 'Alert [error]: failed' AS message, NULL AS recipient, 'alert_high' AS channel FROM events WHERE event_type = 'error' UNION ALL SELECT 1, event_id, 'Error', 'ops', 'email' FROM events WHERE event_type = 'error'")
def stream_alerts(spark, sf_dir):
    """Alerts and notifications of a stream's micro-batches, delivered by channel."""
    e = Engine([Rule(1, "error", (Test("event_type", "eq", "error"),), (Alert("error", "failed", "high"), Notify("ops", "email", "Error"), Log("seen")))])
    folder = new_folder(spark, "alerts")
    R.each_batch(event_stream(spark, sf_dir), lambda batch, n: R.deliver(e.evaluate(batch), f"{folder}/batch={n}"), f"{folder}-state").awaitTermination()
    return spark.read.parquet(folder).select("rule_id", "fact_id", "message", "recipient", F.col("channel").cast("string").alias("channel"))


@query(f"SELECT 'daily' AS name, 'tumbling_' || epoch_ms(window_start) || '_' || epoch_ms(window_end) AS window_id, n FROM ({DAILY}) UNION ALL SELECT 'hourly', 'tumbling_' || epoch_ms(window_start) || '_' || epoch_ms(window_start + INTERVAL 1 HOUR), n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1) WHERE window_start + INTERVAL 1 HOUR <= {CLOSED} AND epoch_ms(window_start + INTERVAL 1 HOUR) >= epoch_us({CLOSED}) // 1000 - 432000000")
def stream_many_windows(spark, sf_dir):
    """Two windows over one stream; of the hourly ones those of the last five days are kept."""
    s = R.Streams(event_stream(spark, sf_dir)).register("daily", W.EventWindow("tumbling", 86_400_000), {"n": F.count(F.lit(1))}).register("hourly", W.EventWindow("tumbling", 3_600_000), {"n": F.count(F.lit(1))})
    s.drain()
    part = lambda name, **m: s.completed(name, **m).select(F.lit(name).alias("name"), "window_id", "n")
    return part("daily").unionByName(part("hourly", retention_ms=432_000_000))


@query(f"SELECT (SELECT count(*) FROM events) AS events_processed, CAST(0 AS BIGINT) AS late_events_dropped, (SELECT epoch_us({CLOSED}) // 1000) AS watermark_ms, (SELECT count(*) FROM ({DAILY})) AS windows_completed")
def stream_statistics(spark, sf_dir):
    s = R.Streams(event_stream(spark, sf_dir)).register("daily", W.EventWindow("tumbling", 86_400_000), {"n": F.count(F.lit(1))})
    s.drain()
    got = s.statistics("daily")
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} bigint" for k in got))


@query("SELECT event_id, epoch_us(ts) // 1000 + 1000 * (event_id % 4) AS ms FROM events")
def event_time_fields(spark, sf_dir):
    """The first of the time fields that a fact has."""
    ms, i = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 4
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(i == 0, ms).alias("timestamp"), F.when(i <= 1, ms + 1000).alias("time"), F.when(i <= 2, ms + 2000).alias("event_time"), (ms + 3000).alias("created_at"))
    return W.with_event_time(e).select("event_id", F.unix_millis("event_ts").alias("ms"))


@query("SELECT 'tumbling_' || epoch_ms(s) || '_' || epoch_ms(s + INTERVAL 1 DAY) AS window_id, round(sum(value * 2 + 1), 4) AS x FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS s, value FROM events) GROUP BY s")
def win_custom(spark, sf_dir):
    """A window's own expression, and its id."""
    e = events(spark, sf_dir)
    out = W.windowed(e, W.EventWindow("tumbling", 86_400_000), {"x": F.round(win(e, "custom", expression=F.sum(F.col("value") * 2 + 1)), 4)})
    return out.select(W.window_id("tumbling").alias("window_id"), "x")


@query("SELECT b AS block, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n FROM (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 30 AS b FROM events) GROUP BY ALL")
def win_count_keyless(spark, sf_dir):
    e = W.assign(events(spark, sf_dir), W.EventWindow("count_tumbling", 30), (), "event_ts", "event_id")
    return ntz(e.groupBy(F.col("_block").alias("block"), "window_start", "window_end").agg(F.count("*").alias("n")))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events WHERE ts + INTERVAL 2 DAY >= TIMESTAMP '2024-01-10' GROUP BY 1 HAVING window_start + INTERVAL 1 DAY <= TIMESTAMP '2024-01-10'")
def allowed_late(spark, sf_dir):
    """Events behind the watermark but within the allowed lateness still count."""
    e = events(spark, sf_dir)
    return ntz(W.windowed(e, W.EventWindow("tumbling", 86_400_000), {"n": win(e, "count")}, watermark="2024-01-10", lateness_ms=2 * 86_400_000)).select("window_start", "n")


@query("SELECT CAST(1 AS BIGINT) AS rule_id, event_id AS fact_id FROM events WHERE (user_id, time_bucket(INTERVAL 1 DAY, ts)) IN (SELECT (user_id, time_bucket(INTERVAL 1 DAY, ts)) FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts) HAVING sum(value * 2) > 300)")
def stream_condition_custom(spark, sf_dir):
    c = StreamTest(W.EventWindow("tumbling", 86_400_000), "custom", "value * 2", "s", Test("s", "gt", 300), group_by=("user_id",))
    return match([Rule(1, "busy day", (c,))], events(spark, sf_dir))

