"""Rules and observations that are counted by the write itself."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from spindle.operators import quality
from spindle.plans import model
from spindle.sources import tables

NOW = dt.datetime(2024, 1, 2)
STOCK = "material_id string, on_hand double, reserved double, source_commit_at timestamp"


def rules():
    return [quality.Rule("positive", F.col("x") > 0), quality.Rule("small", F.col("x") < 100, "warn")]


def test_counts_come_from_the_write(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(k,) for k in [5, 7, -1, None, 200]], "x int").write.parquet(f"{root}/in")
    df = spark.read.parquet(f"{root}/in")
    want = sorted(map(str, quality.expectations(df, "d", rules()).collect()))
    watch = quality.Watch("d", rules())
    tables.replace(watch(df), root, "d")
    shutil.rmtree(f"{root}/in")  # nothing can be read again
    assert sorted(map(str, watch.results(spark).collect())) == want and watch.failures() == {"positive": 1, "small": 1}
    with pytest.raises(quality.QualityError):
        watch.require()
    empty = quality.Watch("e", rules())
    tables.replace(empty(spark.createDataFrame([], "x int")), root, "e")
    assert [(r.total_rows, r.failed_rows, r.pass_rate) for r in empty.results(spark).collect()] == [(0, 0, 1.0)] * 2


def test_broken_rules_leave_the_table_as_it_was(spark, tmp_path):
    root = str(tmp_path)
    frame = lambda *rows: {"stock_position": spark.createDataFrame([(m, h, 0.0, NOW) for m, h in rows], STOCK)}
    now = F.lit(NOW)
    model.publish(frame(("a", 1.0), ("b", 0.0)), root, now, "run-1")
    with pytest.raises(quality.QualityError, match="stock_position.non_negative_stock: 1"):
        model.publish(frame(("a", -1.0)), root, now, "run-2")
    assert sorted(r.material_id for r in tables.current(spark, root, "stock_position").collect()) == ["a", "b"]
    model.publish(frame(("c", -1.0)), root, now, "run-3", hard=False)
    assert [r.material_id for r in tables.current(spark, root, "stock_position").collect()] == ["c"]
    kept = tables.current(spark, root, "expectation_result").orderBy("run_id").collect()
    assert [(r.run_id, r.total_rows, r.failed_rows) for r in kept] == [("run-1", 2, 0), ("run-2", 1, 1), ("run-3", 1, 1)]
    seen = tables.current(spark, root, "asset_observation").orderBy("run_id").first()
    assert (seen.asset_name, seen.row_count, seen.latest_at, seen.freshness_minutes) == ("stock_position", 2, NOW, 0.0)


def test_the_catalog_is_observed_and_covered(spark, tmp_path):
    session = spark.newSession()
    session.createDataFrame([(1, NOW)], "k int, loaded_at timestamp").createOrReplaceTempView("fact_a")
    session.range(3).createOrReplaceTempView("fact_b")
    session.range(3).createOrReplaceTempView("other")
    assert quality.observe_catalog(session, ("source_commit_at", "loaded_at"), F.lit(NOW), "gold", "r", str(tmp_path)) == {}
    seen = {r.asset_name: (r.row_count, r.latest_at) for r in tables.current(spark, str(tmp_path), "asset_observation").collect()}
    assert {k: seen[k] for k in ("fact_a", "fact_b", "other")} == {"fact_a": (1, NOW), "fact_b": (3, None), "other": (3, None)}
    registry = session.createDataFrame([("fact_a", "x"), ("fact_a", "y"), ("fact_c", "z")], "fact_table string, cube_name string")
    assert sorted(map(tuple, quality.catalog_coverage(session, registry).collect())) == [("fact_a", 2, 1), ("fact_b", 0, 3), ("fact_c", 1, None)]
