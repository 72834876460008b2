"""Overlaps of spans against all pairs, and the questions across domains on the small source."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_model import HORIZON, bronze, built, t  # noqa: F401

from spindle.operators import lineage, slices

AT = dt.datetime(2024, 1, 1)


def test_overlaps_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(6)

    def spans(n):
        hour = lambda: None if rng.random() < 0.03 else AT + dt.timedelta(hours=rng.randrange(400), seconds=rng.choice([0, 1800]))
        return [(k, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([1, 2]), hour(), hour()) for k in range(n)]

    schema = "n int, key string, part int, started_at timestamp, ended_at timestamp"
    mine, theirs = spans(120), [r for r in spans(150) if r[1] != "c"]
    for most in (slices.MOST, 20):
        monkeypatch.setattr(slices, "cuts", (lambda f: lambda rows, key, by, _: f(rows, key, by, most))(slices.cuts)) if most == 20 else None
        got = {r.n: r.overlap for r in lineage.overlap_seconds(spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema), ["key", "part"], "overlap").collect()}
        for n, key, part, a, b in mine:
            if a is None or b is None:
                assert got[n] is None
                continue
            want = sum(max(0.0, (min(b, d) - max(a, c)).total_seconds()) for _, k, p, c, d in theirs if key is not None and (k, p) == (key, part) and c and d and c < d) if a < b else 0
            assert abs(got[n] - want) < 1e-6


def test_no_join_of_spans_with_spans(spark):
    one = spark.createDataFrame([("a", AT, AT)], "key string, started_at timestamp, ended_at timestamp")
    plan = lineage.overlap_seconds(one, one, ["key"], "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_questions_on_the_model(spark, bronze, built):  # noqa: F811
    horizon = F.lit(HORIZON)
    waits = lineage.model_waits(built, bronze("entity_state_transition_store"), horizon)
    # o1 waited from 11 to 11 o'clock: the small source has it leave at once, so one more order waits for two days
    assert sorted((r.material_id, r.started_at, r.ended_at) for r in waits.collect()) == [("m1", t(1, 11), t(1, 11)), ("m2", t(1, 11), t(1, 11))]
    waits = waits.unionByName(spark.createDataFrame([("o9", t(3), t(5), "m2", "a1", "w1"), ("o9", t(3), t(5), "m1", "a1", "w1")], "work_order_id string, started_at timestamp, ended_at timestamp, material_id string, asset_id string, warehouse_id string"))
    out = lineage.model_stockouts(bronze("stock_balance_state"), horizon)
    assert [(r.material_id, r.started_at, r.ended_at) for r in out.collect()] == [("m2", t(1), HORIZON)]
    rows = {r.material_id: (r.wait_count, r.wait_hours, r.stockout_hours, r.stockout_share) for r in lineage.stockout_waits(waits, out, ["material_id"], ["material_id", "warehouse_id"]).collect()}
    assert rows == {"m1": (2, 48.0, 0.0, 0.0), "m2": (2, 48.0, 48.0, 1.0)}
    lines = lineage.model_open_orders(built, horizon)
    rows = {r.supplier_name: (r.line_count, r.waited_line_count, r.waited_hours) for r in lineage.supplier_waits(lines, waits, ["supplier_name"], ["material_id", "warehouse_id"]).collect()}
    # p1 was open from the 2nd to the 4th, p2 from the 3rd to the horizon
    assert rows == {"Acme": (1, 1, 24.0), "Bolt": (1, 1, 48.0)}


def test_delivery_and_completion(spark):
    work = spark.createDataFrame([(k, float(10 * k), 1.0) for k in range(1, 6)], "work_order_id int, elapsed_cycle_hours double, material_wait_hours double")
    asked = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3), (14, None), (15, 4)], "requisition_id int, work_order_id int")
    orders = spark.createDataFrame([(10, -2.0, True), (11, 5.0, False), (12, -1.0, True), (13, None, None), (14, 9.0, False)], "requisition_id int, delivery_variance_hours double, received_on_time boolean")
    rows = {r.delivery: (r.work_order_count, r.avg_cycle_hours, r.avg_worst_variance_hours) for r in lineage.delivery_and_completion(work, asked, orders).collect()}
    assert rows == {"late": (1, 10.0, 5.0), "on_time": (1, 20.0, -1.0), "open": (1, 30.0, None), "not_bought": (2, 45.0, None)}


def test_spans_and_others_are_moved_once(spark):
    one = spark.createDataFrame([("a", AT, AT + dt.timedelta(hours=1)), ("a", AT, AT + dt.timedelta(hours=1)), (None, AT, AT), ("b", None, AT)], "key string, started_at timestamp, ended_at timestamp")
    out = lineage.overlap_seconds(one, one, ["key"], "x")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(((r.key, r.x) for r in out.collect()), key=str) == [("a", 7200.0), ("a", 7200.0), ("b", None), (None, 0.0)]


def test_waits_are_added_up_at_their_ends(spark):
    """The same as the waits one by one, in one group a key and in slices, with null keys, open, empty and equal waits and fractions of seconds."""
    rng = random.Random(8)
    at = lambda: None if rng.random() < 0.05 else AT + dt.timedelta(hours=rng.randrange(300), microseconds=rng.choice([0, 250_001]))
    spans = lambda n: [(rng.choice(["a", "a", "b", "c", None]), rng.choice(["x", "y", None]), at(), at()) for _ in range(n)]
    schema = "key string, kind string, started_at timestamp, ended_at timestamp"
    rows, others = spans(150), [r for r in spans(120) if r[0] != "c"]
    waits, out = spark.createDataFrame(rows + rows[:20], schema), spark.createDataFrame(others, schema)
    for by in (["kind"], ["key", "started_at"], ["key"]):
        want = {}
        for row in rows + rows[:20]:
            key, _, a, b = row
            n, length, met = want.get(group := tuple(row[schema.replace(",", "").split()[::2].index(c)] for c in by), (0, 0.0, None))
            if a and b:
                met = (met or 0.0) + sum(max(0.0, (min(b, d) - max(a, c)).total_seconds()) for k, _, c, d in others if k is not None and k == key and c and d and a < b and c < d)
                length += max(0.0, (b - a).total_seconds())
            want[group] = (n + 1, length, met)
        for most in (None, slices.MOST, 20):
            got = {tuple(r[c] for c in by): r for r in lineage.stockout_waits(waits, out, by, ["key"], most).collect()}
            assert got.keys() == want.keys()
            for group, (n, length, met) in want.items():
                r = got[group]
                assert r.wait_count == n and abs(r.wait_hours - length / 3600) < 1e-9 and (r.stockout_hours is None if met is None else abs(r.stockout_hours - met / 3600) < 1e-9)
