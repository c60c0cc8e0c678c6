"""Order and limits of rules that fire together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleweft.model import Rule
from ruleweft.operators.frames import positions

ORDERS = {"priority": F.desc, "salience": F.desc, "recency": F.desc, "specificity": F.desc, "name": F.asc}


def metadata(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, rule_name, priority, salience, specificity) of rules, whose number bounds it."""
    rows = [(r.id, r.name, r.priority, r.salience, len(r.conditions)) for r in rules]
    return spark.createDataFrame(rows, "rule_id bigint, rule_name string, priority int, salience int, specificity int")


def _order(by: str | Column) -> Column:
    if isinstance(by, Column):
        return by
    return ORDERS[by]({"recency": "triggered_at", "name": "rule_name"}.get(by, by))


def resolve(executions: DataFrame, primary: str | Column = "priority", tie: str | Column = "recency", most: int | None = None, conflict_set: list[str] | None = None) -> DataFrame:
    """``executions`` (with rule metadata) and their ``rank``; within sets of a key if ``conflict_set`` names one.

    ``most`` keeps the first of each set, after ordering.
    """
    order = [_order(primary), _order(tie), F.asc("rule_id"), F.asc("fact_id")]
    if conflict_set:
        out = executions.withColumn("rank", F.row_number().over(Window.partitionBy(*conflict_set).orderBy(*order)))
        return out if most is None else out.where(F.col("rank") <= most)
    # a global limit is a top-k, and global ranks are numbered by range partitions: no task gets all rows
    first = executions if most is None else executions.orderBy(*order).limit(most)
    return positions(first, order).withColumn("rank", (F.col("_pos") + 1).cast("int")).drop("_pos")
