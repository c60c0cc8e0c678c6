"""Coercions between values, as Columns. Types are those of the DataFrame; NULL stands for a missing field.

Mixed fields use a tagged cell instead: ``CELL`` has the type's name in ``t`` and the value in the part of its type.
"""

from __future__ import annotations

import datetime
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweft.model import RuleError

CELL = "struct<t:string,s:string,i:bigint,d:double,b:boolean,ts:timestamp,j:string>"
CELL_TYPE = T.StructType([T.StructField(n, t) for n, t in (("t", T.StringType()), ("s", T.StringType()), ("i", T.LongType()), ("d", T.DoubleType()), ("b", T.BooleanType()), ("ts", T.TimestampType()), ("j", T.StringType()))])
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind(t: T.DataType) -> str:
    """The class of a type: number, string, boolean, date, array, object or null."""
    if isinstance(t, NUMBERS):
        return "number"
    for name, types in (("string", (T.StringType,)), ("boolean", (T.BooleanType,)), ("date", TIMES), ("array", (T.ArrayType,)), ("object", (T.StructType, T.MapType)), ("null", (T.NullType,))):
        if isinstance(t, types):
            return name
    raise RuleError("type", f"{t.simpleString()} has no counterpart among values")


def is_cell(t: T.DataType) -> bool:
    """A column whose values are of several kinds: each is a tagged cell."""
    return isinstance(t, T.StructType) and t.names == CELL_TYPE.names and [f.dataType for f in t.fields] == [f.dataType for f in CELL_TYPE.fields]


def literal_kind(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return "date"
    return "array" if isinstance(v, (list, tuple)) else "object"


def compatible(a: str, b: str) -> bool:
    """Values of these classes can be compared; null goes with all."""
    return a == b or "null" in (a, b)


def type_of(df: DataFrame, name: str) -> T.DataType:
    """A field's type; the null type if the table doesn't have it."""
    return df.schema[name].dataType if name in df.columns else T.NullType()


def comparable(c: Column, t: T.DataType) -> Column:
    """As a double for ordering: numbers, booleans 1 and 0, dates in seconds, containers by length; else NULL."""
    k = kind(t)
    if k in ("number", "boolean"):
        return c.cast("int").cast("double") if k == "boolean" else c.cast("double")
    if k == "date":
        return F.unix_timestamp(c.cast("timestamp")).cast("double")
    if k in ("array", "object"):
        return size(c, t).cast("double")
    return F.lit(None).cast("double")


def size(c: Column, t: T.DataType) -> Column:
    n = F.lit(len(t.fields)) if isinstance(t, T.StructType) else F.size(c)
    return F.when(c.isNotNull(), n)


def truthy(c: Column, t: T.DataType) -> Column:
    """True values: true, not 0, not empty, any date; NULL is false."""
    k = kind(t)
    by = {"boolean": lambda: c, "number": lambda: c != 0, "string": lambda: F.length(c) > 0, "date": lambda: c.isNotNull(), "array": lambda: size(c, t) > 0, "object": lambda: size(c, t) > 0, "null": lambda: F.lit(False)}
    return F.coalesce(by[k](), F.lit(False))


def type_name(c: Column, t: T.DataType) -> Column:
    name = {"number": "integer" if isinstance(t, WHOLE) else "float"}.get(kind(t), kind(t))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.lit(name))


def as_integer(c: Column, t: T.DataType) -> Column:
    """Floats truncate, strings parse (else NULL), booleans 1 and 0, dates in seconds, containers by length; NULL is 0."""
    k = kind(t)
    if k == "string":
        return F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(c.try_cast("bigint"))
    if k == "number":
        return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(comparable(c, t).cast("bigint"), F.lit(0).cast("bigint"))


def as_float(c: Column, t: T.DataType) -> Column:
    if kind(t) == "string":
        return F.when(c.isNull(), F.lit(0.0)).otherwise(c.try_cast("double"))
    return F.coalesce(comparable(c, t), F.lit(0.0))


def number(c: Column, t: T.DataType) -> Column:
    """What aggregates see: numbers as doubles, NULL for all else."""
    if is_cell(t):
        return cell_number(c)
    return c.cast("double") if kind(t) == "number" else F.lit(None).cast("double")


def as_string(c: Column, t: T.DataType) -> Column:
    """Text of a value: RFC 3339 for dates, JSON for containers."""
    k = kind(t)
    if is_cell(t):
        return F.coalesce(c["s"], c["i"].cast("string"), c["d"].cast("string"), c["b"].cast("string"), as_string(c["ts"], T.TimestampType()), c["j"])
    if k == "date":
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(c) if k in ("array", "object") else c.cast("string")


def lit(v: Any) -> Column:
    """A literal; lists become arrays and dicts structs."""
    if isinstance(v, (list, tuple)):
        return F.array(*map(lit, v))
    if isinstance(v, dict):
        return F.struct(*(lit(x).alias(k) for k, x in v.items())) if v else F.create_map()
    return F.lit(v).cast("bigint") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)


def cell(c: Column, t: T.DataType) -> Column:
    """A tagged cell of a column's value."""
    if is_cell(t):
        return c
    k, null = kind(t), lambda x: F.lit(None).cast(x)
    part = lambda when, col, cast: (col if when else null(cast)).cast(cast)
    whole = isinstance(t, WHOLE)
    return F.struct(
        type_name(c, t).alias("t"), part(k == "string", c, "string").alias("s"), part(k == "number" and whole, c, "bigint").alias("i"), part(k == "number" and not whole, c, "double").alias("d"),
        part(k == "boolean", c, "boolean").alias("b"), part(k == "date", c, "timestamp").alias("ts"), part(k in ("array", "object"), F.to_json(c) if k in ("array", "object") else c, "string").alias("j"),
    )


def literal_cell(v: Any) -> Column:
    """A tagged cell of a Python value."""
    k = literal_kind(v)
    name = ("integer" if isinstance(v, int) else "float") if k == "number" else k
    part = lambda when, cast, x=v: F.lit(x if when else None).cast(cast)
    return F.struct(
        F.lit(name).alias("t"), part(k == "string", "string").alias("s"), part(name == "integer", "bigint").alias("i"), part(name == "float", "double").alias("d"), part(k == "boolean", "boolean").alias("b"),
        part(k == "date", "timestamp").alias("ts"), part(k in ("array", "object"), "string", json.dumps(v) if k in ("array", "object") else None).alias("j"),
    )


def unified(types: list[T.DataType]) -> T.DataType:
    """The type that holds values of all these types: whole numbers widen to bigint, other numbers to double, and
    different kinds become tagged cells."""
    some = [t for t in types if not isinstance(t, T.NullType)]
    if not some:
        return T.StringType()
    if all(t == some[0] for t in some):
        return some[0]
    kinds = {"cell" if is_cell(t) else kind(t) for t in some}
    if kinds == {"number"}:
        return T.LongType() if all(isinstance(t, WHOLE) for t in some) else T.DoubleType()
    if kinds == {"string"}:
        return T.StringType()
    if kinds == {"date"}:
        return T.TimestampType()
    if kinds == {"array"} and not is_cell(item := unified([t.elementType for t in some])):
        return T.ArrayType(item)
    return CELL_TYPE


def converted(c: Column, t: T.DataType, to: T.DataType) -> Column:
    """A value of type ``t`` as one of ``to``, which ``unified`` gave."""
    if isinstance(t, T.NullType):
        return F.lit(None).cast(to)
    return c if t == to else F.when(c.isNotNull(), cell(c, t)) if is_cell(to) else c.cast(to)


def plain_cell(v: Any) -> dict:
    """The parts of a Python value's cell, as Python values."""
    k = literal_kind(v)
    name = ("integer" if isinstance(v, int) else "float") if k == "number" else k
    part = {"string": "s", "integer": "i", "float": "d", "boolean": "b", "date": "ts", "array": "j", "object": "j"}.get(name)
    return dict.fromkeys(("s", "i", "d", "b", "ts", "j")) | {"t": name} | ({part: json.dumps(v) if part == "j" else v} if part else {})


NO_CELL = f"CAST(NULL AS {CELL})"


def cell_number(c: Column) -> Column:
    return F.coalesce(c["i"].cast("double"), c["d"])


def cell_equal(a: Column, b: Column, typed: bool = True) -> Column:
    """Equality of cells: typed tells 5 from 5.0; null equals null."""
    same = (a["t"] == b["t"]) & a["s"].eqNullSafe(b["s"]) & a["i"].eqNullSafe(b["i"]) & a["d"].eqNullSafe(b["d"]) & a["b"].eqNullSafe(b["b"]) & a["ts"].eqNullSafe(b["ts"]) & a["j"].eqNullSafe(b["j"])
    return F.coalesce(same if typed else same | (cell_number(a) == cell_number(b)), F.lit(False))
