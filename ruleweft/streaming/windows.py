"""Event-time windows, in batch with exact semantics and as Structured Streaming with Spark's.

Batch: the watermark is given. An event is late if it lies more than the allowed lateness before it; windows that end
at or before it are complete. Streams derive the watermark from the latest event and emit complete windows once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ruleweft.functions import values as V
from ruleweft.functions.expr import compile_expression
from ruleweft.model import RuleError, StreamTest
from ruleweft.operators.frames import positions, sessions
from ruleweft.operators.predicates import compile_condition, resolver

#: Fields that may hold an event's time in ms, in order. Fixed values.
TIME_FIELDS = ("timestamp", "time", "event_time", "created_at")
LATENESS_MS = 60_000
FUNCTIONS = ("count", "sum", "avg", "min", "max", "distinct", "stddev", "variance", "percentile", "median", "first", "last", "rate", "custom")


@dataclass(frozen=True)
class EventWindow:
    """kind: tumbling, sliding, session, count_tumbling or count_sliding; sizes in ms, or in events for count windows."""

    kind: str
    size: int
    advance: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("tumbling", "sliding", "session", "count_tumbling", "count_sliding") or self.size <= 0:
            raise RuleError("window", f"unknown window {self.kind} of {self.size}")
        if self.kind.endswith("sliding") and not self.advance:
            raise RuleError("window", "a sliding window needs advance")


def with_event_time(facts: DataFrame, name: str = "event_ts") -> DataFrame:
    """The first of the time fields that is there, in ms, as a timestamp; else ``event_ts`` as it is, else now."""
    found = [F.timestamp_millis(F.col(c)) for c in TIME_FIELDS if c in facts.columns and isinstance(facts.schema[c].dataType, V.WHOLE)]
    own = [F.col(name).cast("timestamp")] if name in facts.columns else []
    return facts.withColumn(name, F.coalesce(*found, *own, F.current_timestamp()))


def aggregate(function: str, c: Column | None, t: T.DataType | None = None, ts: str = "event_ts", percent: float | None = None, window_ms: int | None = None, unit_ms: int = 1000, streaming: bool = False, expression: Column | None = None) -> Column:
    """A window's aggregate; sums are doubles, and windows without values give 0."""
    x = V.number(c, t) if c is not None and t is not None else c
    zero = lambda a: F.coalesce(a, F.lit(0.0))
    if function == "count":
        return F.count(F.lit(1))
    if function == "rate":
        return F.count(F.lit(1)) * F.lit(float(unit_ms)) / F.lit(float(window_ms))
    if function == "custom":
        return expression
    if function == "distinct":
        if streaming:
            return F.size(F.collect_set(c)).cast("bigint") + F.max(c.isNull().cast("bigint"))
        return F.count_distinct(c) + F.max(c.isNull().cast("bigint"))
    if function in ("min", "max"):
        got = F.min(c) if function == "min" else F.max(c)
        return zero(got) if V.kind(t) == "number" else got
    if function in ("first", "last"):
        at = F.when(c.isNotNull(), F.col(ts))
        return F.min_by(c, at) if function == "first" else F.max_by(c, at)
    if function in ("percentile", "median"):
        return zero(F.percentile(x, F.lit(0.5 if function == "median" else float(percent) / 100)))
    return zero({"sum": F.sum, "avg": F.avg, "stddev": F.stddev_pop, "variance": F.var_pop}[function](x))


def interval(ms: int) -> str:
    return f"{ms} milliseconds"


def assign(events: DataFrame, window: EventWindow, keys: tuple[str, ...] = (), ts: str = "event_ts", ids: str = "event_id") -> DataFrame:
    """``events`` with ``window_start`` and ``window_end`` (batch); one row for each window an event lies in."""
    t = F.col(ts).cast("timestamp")
    ms = F.unix_millis(t)
    at = F.timestamp_millis
    if window.kind == "tumbling":
        start = ms - F.pmod(ms, F.lit(window.size))
        return events.withColumn("window_start", at(start)).withColumn("window_end", at(start + window.size))
    if window.kind == "sliding":
        last = ms - F.pmod(ms, F.lit(window.advance))
        first = F.greatest(F.lit(0), last - (-(-window.size // window.advance) - 1) * window.advance)
        first = F.when(first + window.size <= ms, first + window.advance).otherwise(first)
        out = events.withColumn("_start", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(window.advance)))))
        return out.withColumn("window_start", at("_start")).withColumn("window_end", at(F.col("_start") + window.size)).drop("_start")
    if window.kind == "session":
        own = sessions(events.withColumn("event_ts", t).withColumn("fact_id", F.col(ids)) if ts != "event_ts" or ids != "fact_id" else events, list(keys), window.size)
        w = Window.partitionBy(*keys, "_session")
        return own.withColumn("window_start", F.min("event_ts").over(w)).withColumn("window_end", at(F.unix_millis(F.max("event_ts").over(w)) + window.size))
    step = window.advance or window.size
    if keys:
        out = events.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(t, ids)) - 1)
    else:  # numbered by ranges of time: no task gets all events
        out = positions(events.withColumn("_t", t), ["_t", ids], "_nr").withColumnRenamed("_nr", "_rn").drop("_t")
    last = F.floor(F.col("_rn") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("_rn") - window.size) / step) + 1)
    out = out.withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_block")
    return out.withColumn("window_start", F.min(t).over(w)).withColumn("window_end", F.max(t).over(w))


def windowed(events: DataFrame, window: EventWindow, aggregates: dict[str, Column], keys: tuple[str, ...] = (), watermark: Any = None, lateness_ms: int = LATENESS_MS, ts: str = "event_ts", ids: str = "event_id") -> DataFrame:
    """Complete windows with their aggregates, in batch. Without a watermark every window is complete."""
    if watermark is not None:
        events = events.where(F.unix_millis(F.col(ts).cast("timestamp")) + lateness_ms >= F.unix_millis(F.lit(watermark).cast("timestamp")))
    extra = ["_block"] if window.kind.startswith("count") else ["_session"] if window.kind == "session" else []
    out = assign(events, window, keys, ts, ids).groupBy(*keys, "window_start", "window_end", *extra).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.drop(*extra) if watermark is None else out.where(F.col("window_end") <= F.lit(watermark).cast("timestamp")).drop(*extra)


def window_id(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.unix_millis("window_start").cast("string"), F.lit("_"), F.unix_millis("window_end").cast("string"))


def stream(events: DataFrame, window: EventWindow, aggregates: dict[str, Column], keys: tuple[str, ...] = (), lateness_ms: int = LATENESS_MS, ts: str = "event_ts") -> DataFrame:
    """The same over a stream, for append mode. Sessions need a key, and count windows ``count_windows``."""
    t = F.col(ts).cast("timestamp")
    e = events.withColumn(ts, t).withWatermark(ts, interval(lateness_ms))
    if window.kind == "session":
        if not keys and events.isStreaming:
            raise RuleError("window", "sessions in streams need a key")
        w = F.session_window(ts, interval(window.size))
    elif window.kind == "tumbling":
        w = F.window(ts, interval(window.size))
    elif window.kind == "sliding":
        w = F.window(ts, interval(window.size), interval(window.advance))
    else:
        raise RuleError("window", "use count_windows for windows of events")
    out = e.groupBy(*keys, w.alias("_w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    out = out.where(F.col("_w.start") >= F.lit("1970-01-01").cast("timestamp"))
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggregates)


def count_windows(events: DataFrame, key: str, value: str, size: int, ts: str = "event_ts") -> DataFrame:
    """(key, block, n, sum) of every full run of ``size`` events of a key, over a stream, in order of time within a
    micro-batch; state is one partial block."""
    import numpy as np
    import pandas as pd

    def step(k, frames, state):
        block, n, total = state.get if state.exists else (0, 0, 0.0)
        got = [(pdf[ts].to_numpy(), pdf[value].astype(float).fillna(0.0).to_numpy()) for pdf in frames]
        at, x = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        x = x[np.argsort(at, kind="stable")]
        # the partial block's sum stands for its events, at the place of the last one
        filled = np.concatenate([np.zeros(max(0, n - 1)), [total][: min(n, 1)], x])
        full = len(filled) // size
        sums = filled[: full * size].reshape(full, size).sum(1)
        rest = filled[full * size :]
        state.update((block + full, len(rest), float(rest.sum())))
        yield pd.DataFrame({"key": [k[0]] * full, "block": block + np.arange(full), "n": np.full(full, size), "sum": sums})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key), F.col(value).cast("double").alias(value), F.col(ts).cast("timestamp").alias(ts))
    return rows.groupBy(key).applyInPandasWithState(step, f"key {kind}, block long, n long, sum double", "block long, n long, sum double", "append", "NoTimeout")


def chained(steps: list[DataFrame], key: str, within_ms: int, lateness_ms: int = LATENESS_MS, ts: str = "event_ts", ids: str = "event_id") -> DataFrame:
    """Chains of events of one key, one of each step in order of time, the last at most ``within_ms`` after the first.

    Columns: the key, and ``id0``, ``ts0`` and so on. Over batches it is a chain of equi-joins; over streams partial
    chains expire with the watermark.
    """
    part = lambda df, i: df.select(F.col(key).alias(f"key{i}"), F.col(ids).alias(f"id{i}"), F.col(ts).cast("timestamp").alias(f"ts{i}")).withWatermark(f"ts{i}", interval(lateness_ms))
    out = part(steps[0], 0)
    for i, df in enumerate(steps[1:], 1):
        within = " AND ".join(f"ts{i} <= ts{k} + INTERVAL {within_ms} MILLISECONDS" for k in {0, i - 1})
        out = out.join(part(df, i), F.expr(f"key0 = key{i} AND ts{i} >= ts{i - 1} AND {within}")).drop(f"key{i}")
        # a stream has one event time: from here on that of the latest step
        out = out.withColumn(f"ts{i - 1}", F.timestamp_micros(F.unix_micros(f"ts{i - 1}")))
    return out.withColumnRenamed("key0", key)


def joined(left: DataFrame, right: DataFrame, key: str, within_ms: int, lateness_ms: int = LATENESS_MS, ts: str = "event_ts") -> DataFrame:
    """Pairs of events of one key at most ``within_ms`` apart, right after left: state expires with the watermark."""
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)).withWatermark(f"l_{ts}", interval(lateness_ms))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withWatermark(f"r_{ts}", interval(lateness_ms))
    return a.join(b, F.expr(f"l_{key} = r_{key} AND r_{ts} >= l_{ts} AND r_{ts} <= l_{ts} + INTERVAL {within_ms} MILLISECONDS"))


def attach_stream(facts: DataFrame, store: DataFrame, c: StreamTest, flag: str, fact_id: str = "fact_id") -> DataFrame:
    """``facts`` with a flag: the fact lies in a window of ``store`` whose aggregate qualifies."""
    resolve = resolver(store.schema)
    events = store if c.filter is None else store.where(compile_condition(c.filter, resolve))
    col, t = resolve(c.source) if c.source else (None, None)
    expression = None
    if c.function == "custom":
        expression = F.sum(compile_expression(c.source, resolve).col)
    agg = aggregate(c.function, col, t, percent=c.percent, window_ms=c.window.size, expression=expression)
    placed = assign(events, c.window, c.group_by, "event_ts", fact_id)
    extra = ["_block"] if c.window.kind.startswith("count") else ["_session"] if c.window.kind == "session" else []
    by = [*c.group_by, "window_start", "window_end", *extra]
    good = placed.groupBy(*by).agg(agg.alias(c.alias))
    good = good.where(compile_condition(c.having, resolver(good.schema))) if c.having is not None else good
    on = [placed[b].eqNullSafe(good[b]) for b in by]
    hit = placed.join(good, on, "left_semi").select(F.col(fact_id).alias("_id"), F.lit(True).alias(flag)).dropDuplicates(["_id"])
    return facts.join(hit, facts[fact_id] == hit["_id"], "left").drop("_id").withColumn(flag, F.coalesce(flag, F.lit(False)))
