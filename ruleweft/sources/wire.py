"""Facts and results as messages: a string id and a map of one-of values in, plain rows out.

A message's id that is no number becomes fact id 0 and stays as the external id. A value has one of its parts set; a
value with none is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<string_value:string,number_value:double,bool_value:boolean,int_value:bigint>"
MESSAGE = f"id string, data map<string,{VALUE}>, created_at bigint"


def _cell(v: Column) -> Column:
    t = F.when(v["string_value"].isNotNull(), "string").when(v["int_value"].isNotNull(), "integer").when(v["number_value"].isNotNull(), "float").when(v["bool_value"].isNotNull(), "boolean").otherwise("null")
    none = F.lit(None)
    return F.struct(t.alias("t"), v["string_value"].alias("s"), v["int_value"].alias("i"), v["number_value"].alias("d"), v["bool_value"].alias("b"), none.cast("timestamp").alias("ts"), none.cast("string").alias("j"))


def from_messages(messages: DataFrame) -> DataFrame:
    """Messages (``MESSAGE``, created_at in epoch seconds) to ragged facts."""
    number = F.col("id").try_cast("bigint")
    return messages.select(F.coalesce(number, F.lit(0)).alias("fact_id"), F.col("id").alias("external_id"), F.timestamp_seconds("created_at").alias("event_ts"), F.transform_values("data", lambda _, v: _cell(v)).alias("fields"))


def to_messages(firings: DataFrame) -> DataFrame:
    """Firings as (rule_id, fact_id, actions): one row for each match, its actions in order as JSON."""
    action = F.to_json(F.struct("kind", "field", "value", "message", "target_fact_id", "extra"))
    own = firings.groupBy("rule_id", "fact_id").agg(F.array_sort(F.collect_list(F.struct("action_seq", action.alias("body")))).alias("a"))
    return own.select(F.col("rule_id").cast("string").alias("rule_id"), F.col("fact_id").cast("string").alias("fact_id"), F.transform("a", lambda x: x["body"]).alias("actions"))
