"""Frames of an aggregate in batch: event time, the last facts, blocks of facts, and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleweft.model import Aggregate
from ruleweft.operators.predicates import compile_condition, resolver
from ruleweft.sources.shared import durable

TIME, ID = "event_ts", "fact_id"


def millis(c: str | Column = TIME) -> Column:
    return F.unix_millis((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def positions(df: DataFrame, order: list, name: str = "_pos") -> DataFrame:
    """Numbers rows from 0 in a total order without gathering them: counts by range partition, then row numbers within.

    Partitions are ranges of the order, so only their counts meet in one place. Bounds of ranges are sampled anew
    whenever a plan runs, so the dealt rows are written once.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # one row for each partition
    return ranged.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def last(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` facts by time, then id."""
    return df.orderBy(F.desc(TIME), F.desc(ID)).limit(n)


def sessions(df: DataFrame, keys: list[str], gap_ms: int, name: str = "_session") -> DataFrame:
    """Numbers sessions of each key: a gap longer than ``gap_ms`` begins a new one.

    Without keys the sessions are those of all facts together: numbered within ranges of time, and on from the ranges
    before, of which only the ends and counts meet in one place.
    """
    by = list(keys)
    if not keys:
        df, by = durable(df.repartitionByRange(millis(), ID).withColumn("_part", F.spark_partition_id())), ["_part"]
    w = Window.partitionBy(*by).orderBy(millis(), ID)
    new = (millis() - F.lag(millis()).over(w) > gap_ms).cast("int")
    out = df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    if keys:
        return out
    ends = out.groupBy("_part").agg(F.min(millis()).alias("_lo"), F.max(millis()).alias("_hi"), F.max(name).alias("_n"))
    order = Window.orderBy("_part")
    step = F.coalesce(F.lag("_n").over(order), F.lit(0)) + F.coalesce((F.col("_lo") - F.lag("_hi").over(order) > gap_ms).cast("int"), F.lit(0))
    base = ends.withColumn("_step", step).withColumn("_base", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("_part", "_base")
    return out.join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


#: Facts of a ``last`` frame up to which their groups are broadcast.
BROADCAST_LAST = 100_000


def framed(facts: DataFrame, history: DataFrame | None, spec: Aggregate, flag: str, value: Callable) -> DataFrame:
    """``facts`` with a flag for the aggregate over each fact's frame of ``history`` and ``facts``.

    The flag comes out of the window's own pass, so facts keep their rows even where ids repeat. A group field that the
    facts lack counts as null for all.
    """
    kind, size = spec.frame.kind, spec.frame.size
    store = facts if history is None else history.withColumn("_own", F.lit(False)).unionByName(facts.withColumn("_own", F.lit(True)), allowMissingColumns=True)
    keys = [k for k in spec.group_by if k in store.columns]
    resolve = resolver(store.schema)
    c, t = resolve(spec.source)
    keep = compile_condition(spec.filter, resolve) if spec.filter is not None else F.lit(True)
    c = F.when(keep, c)

    def qualify(df: DataFrame) -> DataFrame:
        types = df.schema
        other = resolver(types)
        ok = F.col("_present") > 0 if spec.having is None else compile_condition(spec.having, lambda n: (F.col("_agg"), types["_agg"].dataType) if n == spec.alias else other(n))
        return df.withColumn(flag, F.coalesce(ok, F.lit(False))).drop("_agg", "_present")

    if kind == "last":
        own = last(store, size).groupBy(*keys).agg(value(c, t).alias("_agg"), F.count(c).alias("_present"))
        own = qualify(own).where(flag).select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), flag)
        own = F.broadcast(own) if size <= BROADCAST_LAST or not keys else own
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & (facts[k] if k in facts.columns else F.lit(None)).eqNullSafe(own[f"_k{i}"])
        return facts.join(own, on, "left").drop(*(f"_k{i}" for i in range(len(keys)))).withColumn(flag, F.coalesce(flag, F.lit(False)))
    helpers: list[str] = []
    if kind == "time" and keys:
        w = Window.partitionBy(*keys).orderBy("_ms").rangeBetween(-size, 0)
        df, helpers = store.withColumn("_ms", millis()), ["_ms"]
    elif kind == "time":
        # without keys: a frame lies in its fact's stretch of time and the one before, so each fact goes to two stretches
        stretch = F.floor(F.col("_ms") / size)
        both = F.when(F.col("_ms").isNull(), F.array(F.struct(stretch.alias("s"), F.lit(True).alias("mine")))).otherwise(F.array(F.struct(stretch.alias("s"), F.lit(True).alias("mine")), F.struct((stretch + 1).alias("s"), F.lit(False).alias("mine"))))
        df = store.withColumn("_ms", millis()).withColumn("_in", F.explode(both)).withColumn("_stretch", F.col("_in.s")).withColumn("_mine", F.col("_in.mine"))
        w = Window.partitionBy("_stretch").orderBy("_ms").rangeBetween(-size, 0)
        helpers = ["_ms", "_in", "_stretch", "_mine"]
    elif kind == "block":
        df, helpers = positions(store, [TIME, ID]).withColumn("_block", F.floor(F.col("_pos") / size)), ["_pos", "_block"]
        w = Window.partitionBy("_block", *keys)
    else:
        df, helpers = sessions(store, keys, size), ["_session"]
        w = Window.partitionBy(*keys, "_session")
    df = df.withColumn("_agg", value(c, t, w)).withColumn("_present", F.count(c).over(w))
    if "_mine" in helpers:
        df = df.where("_mine")
    if history is not None:
        df = df.where("_own")
    return qualify(df).select(*(F.col(f"`{n}`") for n in facts.columns), flag)
