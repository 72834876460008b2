"""Registered queries against their SQL, on small random tables of the test schema."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from spindle.plans import queries as Q


def _tables(seed=0, orders=120, parts=40, customers=30, suppliers=10, events=400):
    rng = random.Random(seed)
    day = lambda a, b: dt.datetime(1995, 1, 1) + dt.timedelta(days=rng.randint(a, b))
    money = lambda: round(rng.uniform(1, 5000), 2)
    o = [(k, rng.randrange(customers), rng.choice("FOP"), money(), day(0, 2400), rng.choice(["1-URGENT", "2-HIGH", "5-LOW"])) for k in range(orders)]
    lines = [(rng.randrange(orders), rng.randrange(parts), rng.randrange(suppliers), rng.randint(1, 4), float(rng.randint(1, 50)), money(), rng.randint(0, 10) / 100, 0.05, rng.choice("ANR"), rng.choice("FO"), day(0, 2500)) for _ in range(500)]
    start = dt.datetime(2024, 1, 1)
    e = [(k, start + dt.timedelta(seconds=rng.randrange(2_500_000)), rng.randrange(20), rng.choice(["click", "error", "purchase", "signup", "view"]), rng.uniform(0, 100), "{}") for k in range(events)]
    return {
        "region": pd.DataFrame([(k, f"R{k}") for k in range(5)], columns=["r_regionkey", "r_name"]).astype({"r_regionkey": "int32"}),
        "nation": pd.DataFrame([(k, f"N{k}", k % 5) for k in range(25)], columns=["n_nationkey", "n_name", "n_regionkey"]).astype({"n_nationkey": "int32", "n_regionkey": "int32"}),
        "supplier": pd.DataFrame([(k, f"S{k}", k % 25, money()) for k in range(suppliers)], columns=["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
        "customer": pd.DataFrame([(k, f"C{k}", k % 25, money(), "X") for k in range(customers)], columns=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]).astype({"c_nationkey": "int32"}),
        "part": pd.DataFrame([(k, f"P{k}", f"B{k % 4}", f"T{k % 6}", rng.randint(1, 50), money()) for k in range(parts)], columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).astype({"p_size": "int32"}),
        "orders": pd.DataFrame(o, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
        "lineitem": pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]).astype({"l_linenumber": "int32"}),
        "events": pd.DataFrame(e, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]),
    }


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("sf"), duckdb.connect()
    for name, df in _tables().items():
        for c in df.columns:
            if df[c].dtype.kind == "M":
                df[c] = df[c].astype("datetime64[us]")
        df.to_parquet(f"{path}/{name}.parquet", index=False)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), con


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "-"
    return f"{float(v):.3f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _rows(df):
    df = df[sorted(df)].astype(object)
    return sorted(tuple(map(_text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    path, con = tables
    got, want = Q.QUERIES[name](spark, path).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert _rows(got) == _rows(want)
    assert len(got)


def test_stockout_waits_makes_nothing_for_a_count(spark, tables):
    """Lines are counted by material once; then stock moves, spans of both kinds and groups of the answer are moved once each."""
    spark.sparkContext.setJobGroup("stockout_waits", "stockout_waits")
    plan = Q.QUERIES["lineage_stockout_waits"](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stockout_waits"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # before, 5 exchanges and 18 jobs
    assert plan.count("Exchange hashpartitioning(") == 3 and ran <= 9
