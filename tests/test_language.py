"""Expressions, calculators and values, against worked examples."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweft.functions import values as V
from ruleweft.functions.calculators import REGISTRY, calculate, register
from ruleweft.functions.expr import compile_expression, parse, typed, variables
from ruleweft.model import RuleError
from ruleweft.operators.predicates import resolver

SCHEMA = "a bigint, b double, s string, ok boolean, xs array<bigint>, o struct<k:string,n:bigint>"


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(7, 2.5, "hello", True, [1, 2, 3], ("v", 4))], SCHEMA)


def value(df, text: str, **more):
    return df.select(compile_expression(text, resolver(df.schema), **more).col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a + 3 * 2", 13), ("(a + 3) * 2", 20), ("a / 2", 3.5), ("div(a, 2)", 3), ("div(-7, 2)", -3), ("-7 % 3", -1), ("2 ** 3 ** 2", 512), ("2 ** -1", 0.5), ("a > 5 && b < 3", True), ("!(a > 5) || ok", True),
        ('s ++ " there"', "hello there"), ('s contains "ell"', True), ('s starts_with "he"', True), ('s ends_with "x"', False), ("xs[0]", 1), ("xs[-1]", 3), ("xs ++ [4]", [1, 2, 3, 4]), ("[1, 2,]", [1, 2]), ("push(xs, 9)", [1, 2, 3, 9]),
        ("2 in xs", True), ("xs < [1, 1, 1, 1]", True), ('{k: 1, j: "x"}["j"]', "x"), ('o["k"]', "v"), ("o.n", 4), ("o.nothing == null", True), ("if a > 5 then 1 else 2", 1), ("if s then 1 else 2", 1), ("if 0 then 1 else 2", 2),
        ('cond when a > 10 then "big" when a > 5 then "mid" default "low"', "mid"), ("max(a, b, 100)", 100.0), ("min(3, 1, 2)", 1), ("max(4)", 4), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(1.2345, 2)", 1.23), ("abs(-4)", 4),
        ("0.1 + 0.2 == 0.3", True), ("1 == 1.0", True), ('1 == "1"', False), ('1 != "1"', True), ("null == null", True), ("a == null", False), (r'"q\"\n"', 'q"\n'), ("limit + 1", 11), ("base * 1.2", 120.0), ("add(1, 2)", 3.0),
    ],
)
def test_expression(row, text, want):
    got = value(row, text, constants={"limit": 10, "base": 100})
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize("text", ["a +", "nope + 1", "f(1)", "a && 1", '1 < "x"', "a ++ s", "max()", "cond default 1", "a $ b", "[1, 2", "s - 1", "!a"])
def test_refused_when_compiled(row, text):
    with pytest.raises(RuleError):
        compile_expression(text, resolver(row.schema))


@pytest.mark.parametrize("text", ["1 % 0", "a / 0", "xs[9]", "cond when false then 1"])
def test_error_when_run(row, text):
    with pytest.raises(Exception, match="(?i)zero|index|matched"):
        value(row, text)


@pytest.mark.parametrize(("x", "n", "want"), [(0.49999999999999994, 0, 0.0), (273.78475, 4, 273.7847), (-3189.06375, 4, -3189.0637), (2.5, 0, 3.0), (1e16, 4, 1e16), (-1e300, 4, -1e300), (1e306, 4, 1e306), (math.inf, 2, math.inf), (None, 2, None)])
def test_round_to_digits(spark, x, n, want):
    assert value(spark.createDataFrame([(x,)], "x double"), f"round(x, {n})") == want


def test_variables():
    assert variables(parse('if z > 1 then add(b, a) else [c, {k: d}][0] ++ "x"')) == ["a", "b", "c", "d", "z"]


def test_lookup_of_another_fact(row):
    seen = []

    def lookup(c, name):
        seen.append(name)
        return F.lit(5), T.LongType()

    assert value(row, '"17".amount + 1', lookup=lookup) == 6
    assert seen == ["amount"]


@pytest.mark.parametrize(
    ("name", "inputs", "want"),
    [
        ("multiply", {"a": 2.0, "b": 3.5}, 7.0), ("add", {"a": 10.0, "b": 15.5}, 25.5), ("percentage_add", {"amount": 100.0, "percentage": 0.1}, 110.0), ("percentage_deduct", {"amount": 200.0, "percentage": 0.25}, 150.0),
        ("proportional_allocator", {"total_amount": 500.0, "individual_value": 20.0, "total_value": 100.0}, 100.0), ("proportional_allocator", {"total_amount": 500.0, "individual_value": 20.0, "total_value": 0.0}, 0.0),
        ("time_between_datetime", {"start_datetime": "2024-01-01T00:00:00Z", "finish_datetime": "2024-01-02T00:00:00Z"}, 24.0),
        ("time_between_datetime", {"start_datetime": "2024-01-01T18:00:00Z", "finish_datetime": "2024-01-02T02:00:00Z", "workday": '{"hours": 0, "minutes": 0}', "part": "time_before"}, 6.0),
        ("time_between_datetime", {"start_datetime": "2024-01-01T18:00:00Z", "finish_datetime": "2024-01-02T02:00:00Z", "workday": '{"hours": 0, "minutes": 0}', "part": "time_after"}, 2.0),
        ("time_between_datetime", {"start_datetime": "2024-01-01T18:00:00Z", "finish_datetime": "2024-01-02T02:00:00Z", "workday": '{"hours": 22, "minutes": 30}', "part": "time_before"}, 4.5),
        ("time_between_datetime", {"start_datetime": "2024-01-01T18:00:00Z", "finish_datetime": "2024-01-02T02:00:00Z", "workday": '{"hours": 22, "minutes": 30}', "part": "time_after"}, 3.5),
        ("time_between_datetime", {"start_datetime": "2024-01-01T09:00:00Z", "finish_datetime": "2024-01-01T11:30:00Z", "units": "minutes"}, 150.0),
        ("threshold_check", {"value": 10.0, "threshold": 5.0}, True), ("limit_validator", {"value": 10.0, "min": 5.0, "max": 9.0}, False), ("limit_validate", {"value": 10.0, "warning": 5.0, "critical": 8.0, "max": 12.0}, "Critical"),
    ],
)
def test_calculator(row, name, inputs, want):
    typed_in = {k: typed(F.lit(v), T.StringType() if isinstance(v, str) else T.DoubleType()) for k, v in inputs.items()}
    got = row.select(calculate(name, typed_in).alias("x")).first()["x"]
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_weighted_average(spark):
    df = spark.createDataFrame([([(10.0, 1.0), (15.0, 1.0)],), ([],), ([(3.0, 0.0)],)], "items array<struct<value:double,weight:double>>")
    assert [r[0] for r in df.select(compile_expression("weighted_average(items)", resolver(df.schema)).col).collect()] == [12.5, 0.0, 0.0]


def test_registry(row):
    register("triple", {"x": "number"}, lambda x: x * 3)
    assert value(row, "triple(a)") == 21.0
    del REGISTRY["triple"]
    with pytest.raises(RuleError, match="not found"):
        calculate("triple", {})
    with pytest.raises(RuleError, match="Missing argument 'b'"):
        calculate("add", {"a": typed(F.lit(1), T.LongType())})
    with pytest.raises(RuleError, match="Invalid argument 'b'"):
        calculate("add", {"a": typed(F.lit(1), T.LongType()), "b": typed(F.lit("x"), T.StringType())})


def test_values(spark):
    df = spark.createDataFrame([(3.9, "12", "x", True, [1, 2], None)], "d double, n string, s string, b boolean, xs array<int>, z bigint")
    c = lambda f, name: f(F.col(name), df.schema[name].dataType).alias(name)
    assert tuple(df.select(*(c(V.as_integer, n) for n in df.columns)).first()) == (3, 12, None, 1, 2, 0)
    assert tuple(df.select(*(c(V.as_float, n) for n in df.columns)).first()) == (3.9, 12.0, None, 1.0, 2.0, 0.0)
    assert tuple(df.select(*(c(V.truthy, n) for n in df.columns)).first()) == (True, True, True, True, True, False)
    assert tuple(df.select(*(c(V.comparable, n) for n in df.columns)).first()) == (3.9, None, None, 1.0, 2.0, None)
    assert tuple(df.select(*(c(V.type_name, n) for n in df.columns)).first()) == ("float", "string", "string", "boolean", "array", "null")
    cells = df.select(V.literal_cell(5).alias("a"), V.literal_cell(5.0).alias("b"), V.literal_cell(None).alias("c"))
    got = cells.select(V.cell_equal(F.col("a"), F.col("b")), V.cell_equal(F.col("a"), F.col("b"), typed=False), V.cell_equal(F.col("c"), F.col("c"))).first()
    assert tuple(got) == (False, True, True)
    assert math.isclose(df.select(V.cell_number(V.literal_cell(2))).first()[0], 2.0)
