"""Every query of the rules engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from ruleweft.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float, complex)) and not hasattr(v, "dtype"):
        return str(v)
    return str(v) if "datetime" in str(getattr(v, "dtype", "")) or "bool" in str(getattr(v, "dtype", "")) else round(float(v), 3)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if sql := catalogue.oracle_sql().get(name):
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_rounding_at_ties(spark, tmp_path):
    """A product just below a tie goes down as in SQL, and large or tiny quotients stay right."""
    prices = [(31890.6375, 10.0), (1368.92375, 5.0), (0.00015, 2.0), (0.0000999999999999999, 2.0), (-7.00025, 2.0), (-31890.6375, 10.0), (1e16, 1.0), (-1e300, 1.0), (1e305, 1.0), (0.0, 3.0), (None, 1.0)]
    df = pd.DataFrame(prices, columns=["l_extendedprice", "l_quantity"]).assign(l_discount=0.05)
    df["l_orderkey"], df["l_linenumber"] = range(len(df)), pd.Series([1] * len(df), dtype="int32")
    path = str(tmp_path / "lineitem.parquet")
    df.to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    prices = lambda rows: sorted((r[0], repr(r[1])) for r in rows)
    got = catalogue.queries()["dsl_arithmetic"](spark, str(tmp_path)).select("fact_id", "unit_price").collect()
    assert prices(got) == prices(con.execute(f"SELECT fact_id, unit_price FROM ({catalogue.oracle_sql()['dsl_arithmetic']})").fetchall())
