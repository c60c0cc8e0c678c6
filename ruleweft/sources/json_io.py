"""Facts as JSON: one object a line with the envelope (id, external_id, timestamp) and ``data`` of any fields.

Ragged facts keep their fields as a map of tagged cells, which tells a missing field from null and 5 from 5.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweft.functions import values as V

ENVELOPE = "id string, external_id string, timestamp string, data string"


def _cell_of(text: Column, kind: Column) -> Column:
    """The cell of a JSON value by its text and its variant type; RFC 3339 text stays text."""
    t = F.when(text.isNull() | (kind == "VOID"), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    t = t.when(text.rlike(r"^-?\d+$") & text.try_cast("bigint").isNotNull(), "integer").otherwise("float")
    return F.struct(
        t.alias("t"), F.when(t == "string", text).alias("s"), F.when(t == "integer", text.try_cast("bigint")).alias("i"), F.when(t == "float", text.try_cast("double")).alias("d"), F.when(t == "boolean", text == "true").alias("b"),
        F.lit(None).cast("timestamp").alias("ts"), F.when(t.isin("array", "object"), text).alias("j"),
    )


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to (fact_id, external_id, event_ts, fields map<string, cell>); an id that is no number is 0 and kept
    as the external id."""
    e = F.from_json(column, ENVELOPE)
    raw = lines.select(e.alias("e"))
    number = F.col("e.id").try_cast("bigint")
    # the text tells 1 from 1.0, the variant tells text from other values
    texts, kinds = F.from_json(F.col("e.data"), "map<string,string>"), F.from_json(F.col("e.data"), "map<string,variant>")
    pairs = F.transform(F.map_keys(texts), lambda k: F.struct(k.alias("key"), _cell_of(F.element_at(texts, k), F.schema_of_variant(F.element_at(kinds, k))).alias("value")))
    return raw.select(
        F.coalesce(number, F.lit(0)).alias("fact_id"), F.coalesce(F.col("e.external_id"), F.when(number.isNull(), F.col("e.id"))).alias("external_id"), F.to_timestamp("e.timestamp").alias("event_ts"), F.map_from_entries(pairs).alias("fields")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def serialize(facts: DataFrame, fact_id: str = "fact_id", external_id: str = "external_id", event_ts: str = "event_ts") -> DataFrame:
    """Typed facts to JSON lines in ``value``."""
    rest = [c for c in facts.columns if c not in (fact_id, external_id, event_ts)]
    part = lambda c, name: F.col(c).alias(name)
    head = [part(c, n) for c, n in ((fact_id, "id"), (external_id, "external_id")) if c in facts.columns]
    if event_ts in facts.columns:
        head.append(F.date_format(F.col(event_ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"))
    return facts.select(F.to_json(F.struct(*head, F.struct(*rest).alias("data"))).alias("value"))


def write(facts: DataFrame, path: str, **names: str) -> None:
    serialize(facts, **names).write.text(path)


def promote(ragged: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed columns for the named fields (name to type); the map stays."""
    part = {"string": "s", "bigint": "i", "double": "d", "boolean": "b", "timestamp": "ts"}
    cell = lambda n: F.col("fields")[n]
    col = lambda n, t: V.cell_number(cell(n)) if t == "double" else cell(n)[part[t]]
    return ragged.select("*", *(col(n, t).cast(t).alias(n) for n, t in fields.items()))


def present(name: str) -> Column:
    """True where a ragged fact has the field, null or not."""
    return F.coalesce(F.map_contains_key("fields", name), F.lit(False))
