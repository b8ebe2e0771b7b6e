"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

OWN = {n: f for n, f in entry.catalog.queries().items()}
SQL = entry.catalog.oracle_sql()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(cell, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, data, name):
    df = OWN[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted("|".join(cell(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for f in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
        cur = con.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert sorted("|".join(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_llm():
    root = os.path.dirname(entry.__file__)
    for f in glob.glob(f"{root}/strandline/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "strandline.llm" not in open(f).read(), f


def test_shortest_paths_leaves_out_no_order_that_can_be_reached(spark, data):
    got = {(r["src"], r["dst"]): r["length"] for r in OWN["shortest_paths"](spark, data).collect()}
    t = lambda n: f"'{data}/{n}.parquet'"
    want = duckdb.sql(f"select distinct 'supplier:' || s_suppkey, 'order:' || o_orderkey, if(a.n_nationkey = b.n_nationkey, 3, 5) from {t('lineitem')} join {t('supplier')} on l_suppkey = s_suppkey join {t('orders')} on l_orderkey = o_orderkey join {t('customer')} on o_custkey = c_custkey join {t('nation')} a on a.n_nationkey = s_nationkey join {t('nation')} b on b.n_nationkey = c_nationkey and b.n_regionkey = a.n_regionkey").fetchall()
    assert got == {(s, o): n for s, o, n in want} and set(got.values()) == {3, 5}
