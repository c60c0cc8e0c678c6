"""Running streams: drain what is there, feed batches to a sink, run rules over a stream, or many windows over one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweft.plans.engine import Engine
from ruleweft.sources.shared import new_folder
from ruleweft.streaming import windows as W


def written(stream: DataFrame, folder: str, seconds: int | None = None):
    """Starts a stream that appends its rows to Parquet files in ``folder``, each row once."""
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(**trigger).start()


def rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Processes all that is available and returns the rows emitted, from Parquet in the shared folder."""
    folder = new_folder(stream.sparkSession, f"stream-{name}")
    written(stream, folder).awaitTermination()
    return rows(stream.sparkSession, folder, stream.schema)


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", seconds: int | None = None):
    """Starts a stream whose micro-batches go to ``sink``: rules over each batch, alerts to wherever they belong."""
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def incremental(engine: Engine, stream: DataFrame, folder: str, keep_facts: bool = True, seconds: int | None = None):
    """Rules over facts as they come: each micro-batch is evaluated once, its firings go to ``folder``/rows.

    Aggregates see all facts of earlier batches too, which are kept in ``folder``/facts if ``keep_facts``. A batch that
    is run again after a failure overwrites its own files, so nothing is counted twice.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        history = None
        if keep_facts:
            batch.write.mode("overwrite").parquet(f"{folder}/facts/batch={n}")
            history = spark.read.schema(batch.schema.add("batch", "long")).parquet(f"{folder}/facts").where(F.col("batch") < n).drop("batch") if n else None
        engine.evaluate(batch, history).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        batch.unpersist()

    return each_batch(stream, sink, f"{folder}/state", seconds=seconds)


def deliver(firings: DataFrame, folder: str) -> None:
    """Alerts and notifications to files by channel: alerts by severity, notifications by their channel."""
    out = firings.where("kind = 'notification_sent' OR message LIKE 'Alert [%'")
    channel = F.when(F.col("kind") == "notification_sent", F.col("extra")["channel"]).otherwise(F.concat(F.lit("alert_"), F.col("extra")["severity"]))
    out.select("rule_id", "fact_id", "message", F.col("extra")["recipient"].alias("recipient"), channel.alias("channel")).write.mode("append").partitionBy("channel").parquet(folder)


@dataclass
class Streams:
    """Any number of named windows over one stream of events, each with its own results."""

    events: DataFrame
    lateness_ms: int = W.LATENESS_MS
    specs: dict[str, tuple[W.EventWindow, dict[str, Column], tuple[str, ...]]] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)
    progress: dict[str, list] = field(default_factory=dict)

    def register(self, name: str, window: W.EventWindow, aggregates: dict[str, Column], keys: tuple[str, ...] = ()) -> Streams:
        self.specs[name] = (window, aggregates, keys)
        return self

    def _plan(self, name: str) -> DataFrame:
        window, aggregates, keys = self.specs[name]
        return W.stream(self.events, window, aggregates, keys, self.lateness_ms)

    def drain(self) -> None:
        """Processes what is available; a window's result appears once, when the watermark has passed its end."""
        spark, running = self.events.sparkSession, {}
        for name in self.specs:
            self.folders.setdefault(name, new_folder(spark, f"window-{name}"))
            running[name] = written(self._plan(name), self.folders[name])
        for name, q in running.items():
            q.awaitTermination()
            self.progress.setdefault(name, []).extend(q.recentProgress)

    def completed(self, name: str, retention_ms: int | None = None) -> DataFrame:
        """Complete windows with their ids; with ``retention_ms`` only those that end at most so long before the
        watermark."""
        plan = self._plan(name)
        out = rows(self.events.sparkSession, self.folders[name], plan.schema).withColumn("window_id", W.window_id(self.specs[name][0].kind))
        if retention_ms is None:
            return out
        return out.where(F.unix_millis("window_end") >= self.watermark_ms(name) - retention_ms)

    def watermark_ms(self, name: str) -> int:
        import datetime

        marks = [p["eventTime"]["watermark"] for p in self.progress.get(name, []) if "watermark" in (p["eventTime"] or {})]
        return max((int(datetime.datetime.fromisoformat(m.replace("Z", "+00:00")).timestamp() * 1000) for m in marks), default=0)

    def statistics(self, name: str) -> dict[str, int]:
        """Counts that the stream itself reports, and complete windows."""
        got = self.progress.get(name, [])
        return {
            "events_processed": sum(p["numInputRows"] for p in got),
            "late_events_dropped": sum(s["numRowsDroppedByWatermark"] for p in got for s in p["stateOperators"]),
            "watermark_ms": self.watermark_ms(name),
            "windows_completed": self.completed(name).count(),
        }
