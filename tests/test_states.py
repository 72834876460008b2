"""Cubes from mergeable states are those from rows; joins of bucketed facts move nothing."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_model import bronze, built  # noqa: F401
from test_queries import tables as files  # noqa: F401

from spindle.plans import cubes
from spindle.plans import queries as Q
from spindle.plans.states import ViewStates
from spindle.sources import tables


def rounded(df):
    cell = lambda v: round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(cell(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(cubes.VIEWS))
def test_every_view_from_states(built, name):  # noqa: F811
    view, rng = cubes.VIEWS[name], random.Random(name)
    day = next(iter(view.fields))
    states = ViewStates(view, day, tuple(view.fields), tuple(view.measures))
    kept = states.build(built.__getitem__)
    for fields in [rng.sample(list(view.fields), 2)] + [[]] * (name == "procurement_metrics"):
        assert rounded(states.answer(*kept, fields)) == rounded(view.query(built.__getitem__, fields, list(view.measures)))
    with pytest.raises(ValueError):
        states.answer(*kept, ["nothing"])


def test_a_day_writes_its_own_states(spark, files, tmp_path):  # noqa: F811
    path, _ = files
    read = lambda limit: lambda t: Q._table(spark, path, t).filter(F.col("order_date_key") < limit) if t.startswith("fact_") else Q._table(spark, path, t)
    view, root = cubes.VIEWS["procurement_metrics"], str(tmp_path)
    chosen = ("purchase_order_count", "late_purchase_order_count", "ordered_value", "fill_rate", "avg_delivery_variance_hours")
    states = ViewStates(view, "order_date", ("supplier", "po_status"), chosen)
    days = sorted(r[0] for r in Q._table(spark, path, "fact_purchase_order_item").select("order_date_key").distinct().collect())
    states.update(read(days[-2]), root)
    before = {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    full = read(99999999)
    new = [r[0] for r in full("dim_date").filter(F.col("date_key").isin(days[-2:])).select("full_date").collect()]
    for _ in range(2):  # again: the same
        states.update(full, root, new)
    after = {p for p in Path(root).rglob("*.parquet")}
    assert all(p.stat().st_mtime_ns == t for p, t in before.items()) and len({str(p).split("_part=")[1].split("/")[0] for p in after - before.keys()}) == len(new)
    for fields, where in ((["supplier"], None), ([], "po_status = 'SENT'"), (["order_date", "po_status"], None)):
        assert rounded(states.query(spark, root, fields, where=where)) == rounded(view.query(full, fields, list(chosen), where))


def test_sketches_of_other_values(spark):
    rows = spark.range(30_000).select((F.col("id") % 7).cast("int").alias("paid"), F.concat(F.lit("x"), F.col("id") % 9_000).alias("accounts_payable_id"), F.lit(1.5).alias("amount"), F.lit(20240101).alias("payment_date_key"), F.lit(1).alias("supplier_key"))
    read = {"fact_payment": rows, "dim_date": spark.createDataFrame([(20240101, None)], "date_key int, full_date date")}.__getitem__
    states = ViewStates(cubes.VIEWS["payment_metrics"], "payment_date", (), ("payment_count", "paid_payable_count"))
    r = states.answer(*states.build(read)).first()
    assert r.payment_count == 30_000 and abs(r.paid_payable_count - 9_000) < 9_000 * 0.05


def test_bucketed_facts_meet_without_exchange(spark):
    orders = spark.range(2000).select(F.col("id").alias("o"), (F.col("id") % 7).alias("s"))
    lines = spark.range(9000).select((F.col("id") % 2000).alias("o"), F.col("id").alias("line"))
    receipts = lines.withColumnRenamed("line", "receipt")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b, c = (tables.save_bucketed(df, f"t_bucketed_{n}", ["o"], 6) for n, df in (("orders", orders), ("lines", lines), ("receipts", receipts)))
        joined = a.join(b, "o").join(c, "o").groupBy("o").agg(F.count(F.lit(1)).alias("n"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, orders.join(lines, "o").join(receipts, "o").groupBy("o").count().collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("orders", "lines", "receipts"):
            spark.sql(f"DROP TABLE IF EXISTS t_bucketed_{n}")


def test_states_of_few_values_are_small(spark):
    """Numbers far apart, each in a combination of fields of its own, as most are: a state has room for its value, not for all near it."""
    rows = spark.range(2_000).select(F.lit("PAID").alias("po_status"), F.col("id").alias("supplier_key"), (F.col("id") * 100_003).alias("purchase_order_id"), F.lit(20240101).alias("order_date_key"), F.lit(False).alias("received_on_time"))
    read = {"fact_purchase_order_item": rows.withColumnRenamed("po_status", "status"), "dim_date": spark.createDataFrame([(20240101, None)], "date_key int, full_date date"), "dim_supplier": spark.range(2_000).select(F.col("id").alias("supplier_key"), F.col("id").cast("string").alias("supplier_name"))}
    view = cubes.VIEWS["procurement_metrics"]
    kept = ViewStates(view, "order_date", ("supplier",), ("purchase_order_count", "late_purchase_order_count")).build(read.__getitem__)[1]
    assert kept.count() == 2_000 and not [c for c, kind in kept.dtypes if kind == "binary"]


def test_tasks_follow_the_bytes_read(spark, files):  # noqa: F811
    lines = spark.read.parquet(f"{files[0]}/lineitem.parquet")
    assert tables.dealt(lines, "l_partkey") is lines
    assert tables.dealt(lines, "l_partkey", most=1000).rdd.getNumPartitions() > 10
