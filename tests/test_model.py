"""The model from a small hand-made source to facts, views and checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindle.operators import changes, quality
from spindle.plans import cubes, model
from spindle.sources.schemas import REQUIRED, SOURCES


def t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


ROWS = {
    "supplier": [("s1", "Acme", None, 5, 30, 0.9, 0.1, True), ("s2", "Bolt", "77", 3, 30, 0.8, 0.2, True)],
    "warehouse": [("w1", "Main", True)],
    "cost_center": [("c1", "Plant", True)],
    "asset": [("a1", "Pump", "PUMP", "HIGH", "c1", "w1", True)],
    "material": [("m1", "Seal", "SPARE", "UN", None, "A", 5800, 10.0, 20.0, "s1", 1800, 500, 165, 760, True), ("m2", "Oil", "LUBE", "L", "271", "B", 1050, 5.0, 10.0, "s2", 1800, 500, 165, 760, True)],
    "asset_material_profile": [("a1", "m1", 0.5, 1.0, 2.0)],
    "stock_balance_state": [("m1", "w1", 9.0, 1.0, None, 0), ("m1", "w1", 7.0, 2.0, None, 1), ("m2", "w1", 0.0, 0.0, None, 0)],
    "work_order_state": [
        ("o1", "WO-1", "a1", "CORRECTIVE", "HIGH", "PLANNED", "c1", "w1", t(1, 10), t(1, 10), None, None, None, None, None, None, 0),
        ("o1", "WO-1", "a1", "CORRECTIVE", "HIGH", "CLOSED", "c1", "w1", t(1, 10), t(1, 10), t(1, 11), t(1, 12), None, t(1, 13), None, t(1, 14), 2),
        ("o2", "WO-2", "a1", "PREVENTIVE", "LOW", "CANCELLED", "c1", "w1", t(1, 10), t(1, 10), None, None, None, None, None, None, 1)],
    "work_order_material_state": [("l1", "o1", "m1", 4.0, 3.0, "PARTIALLY_ISSUED", 1), ("l2", "o1", "m2", 0.0, 0.0, "FULFILLED", 1), ("l3", "o2", "m1", 1.0, 0.0, "REQUESTED", 1)],
    "purchase_requisition_state": [("r1", "PR-1", "w1", "REORDER", "m1", "LOW", "APPROVED", t(1), t(1), t(2), 1)],
    "purchase_requisition_item_store": [("ri1", "r1", "m1", 20.0, 1)],
    "purchase_order_state": [("p1", "PO-1", "r1", "s1", "w1", "RECEIVED", t(2), t(2), t(2, 6), t(5), t(5), t(4), None, 1, 1), ("p2", "PO-2", "r1", "s2", "w1", "SENT", t(3), t(3), t(3, 1), t(9), t(9), None, None, 0, 1)],
    "purchase_order_item_state": [("i1", "p1", "ri1", "m1", 20.0, 5800, 20.0, 1), ("i2", "p2", "ri1", "m2", 10.0, 1000, 4.0, 1)],
    "goods_receipt_store": [("g1", "GR-1", "p1", "w1", t(4), 1)],
    "goods_receipt_item_store": [("gi1", "g1", "i1", "m1", 20.0, 1)],
    "inventory_movement_store": [("v1", "m1", "w1", "RECEIPT", 20.0, 5800, "GOODS_RECEIPT", "g1", t(4), 1), ("v2", "m1", "w1", "ISSUE", -3.0, 5800, "WORK_ORDER", "o1", t(4), 1), ("v3", "m2", "w1", "CYCLE_COUNT_ADJUSTMENT", 0.0, 1050, None, None, t(4), 1)],
    "fiscal_invoice_state": [("f1", "NF-1", "s1", "p1", "g1", "RELEASED", t(4), t(4), t(4), None, None, 116000, 37410, 121800, 51, False, 1)],
    "fiscal_invoice_item_store": [("fi1", "f1", "m1", 20.0, 5800, 20880, 5800, 1914, 8816, 1)],
    "accounts_payable_state": [("ap1", "f1", "s1", "PAID", 121800, t(5, 10), t(20), None, None, t(7, 9), 1), ("ap2", "f1", "s1", "OPEN", 1000, t(5), t(8, 23), None, None, None, 1)],
    "payment_store": [("pay1", "PG-1", "ap1", 121800, t(7, 9), 1)],
    "entity_state_transition_store": [
        ("x1", "work_order", "o1", None, "PLANNED", None, t(1, 10), 0), ("x2", "work_order", "o1", "PLANNED", "WAITING_MATERIAL", None, t(1, 11), 1), ("x3", "work_order", "o1", "WAITING_MATERIAL", "CLOSED", None, t(1, 11), 2),
        ("x4", "work_order", "o2", "PLANNED", "CANCELLED", "no need", t(1, 12), 1), ("x5", "fiscal_invoice", "f1", "VALIDATING", "BLOCKED", None, t(4), 1)],
}
HORIZON = t(10, 1)


@pytest.fixture(scope="module")
def bronze(spark):
    made = {}
    for name, source in SOURCES.items():
        df = spark.createDataFrame(ROWS.get(name, []), source.ddl)
        sequence = "valid_from_tick" if source.kind == "state" else None
        df = df.withColumns({"_change_type": F.lit("insert"), "_commit_version": (F.col(sequence) if sequence else F.lit(1)).cast("bigint"), "_commit_timestamp": F.lit(t(1)).cast("timestamp")})
        made[name] = changes.publicize(df, name, "run-1", ("valid_from_tick", "simulation_tick")).cache()
    # a second version of a supplier with the same attributes, and a third with others
    extra = [(2, "Acme"), (3, "Acme & Co"), (4, "Acme")]
    rows = spark.createDataFrame([("s1", n, None, 5, 30, 0.9, 0.1, True, "update_postimage", v, t(v)) for v, n in extra], SOURCES["supplier"].ddl + ", _change_type string, _commit_version bigint, _commit_timestamp timestamp")
    made["supplier"] = made["supplier"].unionByName(changes.publicize(rows, "supplier", "run-2"))
    return made.__getitem__


@pytest.fixture(scope="module")
def built(spark, bronze):
    bounds = spark.createDataFrame([(t(1), t(31))], "first_day timestamp, last_day timestamp")
    return model.build(bronze, F.lit(HORIZON).cast("timestamp"), bounds)


def one(df, key, value):
    return df.filter(F.col(key) == value).first()


def test_conformed_tables(built):
    m1 = one(built["material"], "material_id", "m1")
    assert str(m1.unit_cost) == "58.00" and str(m1.icms_pct) == "18.0000"
    o1, o2 = (one(built["work_order_lifecycle"], "work_order_id", o) for o in ("o1", "o2"))
    assert (o1.status, float(o1.elapsed_cycle_hours), float(o2.elapsed_cycle_hours)) == ("CLOSED", 4.0, 2.0)
    assert (o1.material_line_count, o1.fulfilled_material_line_count, o1.waited_for_material, o2.waited_for_material) == (2, 1, 1, 0)
    assert float(o1.estimated_material_cost) == 3 * 58
    lines = {r.work_order_material_id: r for r in built["work_order_material"].collect()}
    assert [(lines[k].open_qty, lines[k].fulfillment_ratio) for k in ("l1", "l2")] == [(1.0, 0.75), (0.0, 1.0)]
    assert (o1.asset_description, o1.cost_center_name, o1.warehouse_name) == ("Pump", "Plant", "Main") and o1.bronze_ingested_at is not None
    stock = one(built["stock_position"], "material_id", "m1")
    assert (stock.material_description, stock.material_category, stock.warehouse_name) == ("Seal", "SPARE", "Main")
    assert built["supplier"].filter("source_commit_version IS NOT NULL AND source_ingested_at IS NOT NULL").count() == 2
    assert (stock.on_hand, stock.available, float(stock.inventory_value)) == (7.0, 5.0, 406.0)
    p1, p2 = (one(built["purchase_order"], "purchase_order_id", p) for p in ("p1", "p2"))
    assert (p1.received_on_time, float(p1.delivery_variance_hours), p2.received_on_time) == (True, -24.0, None)
    a1, a2 = (one(built["accounts_payable"], "accounts_payable_id", a) for a in ("ap1", "ap2"))
    assert (a1.days_to_pay, a1.is_overdue, a1.days_past_due, a2.is_overdue, a2.days_past_due) == (1, False, 0, True, 2)
    assert one(built["fiscal_invoice"], "fiscal_invoice_id", "f1").was_blocked
    assert [r.movement_direction for r in built["inventory_movement"].orderBy("movement_id").collect()] == ["IN", "OUT", "ZERO"]


def test_dimensions_and_facts(built):
    rows = built["dim_supplier"].filter("supplier_id = 's1'").orderBy("source_commit_version").collect()
    assert [(r.supplier_name, r.source_commit_version, r.is_current) for r in rows] == [("Acme", 1, False), ("Acme & Co", 3, False), ("Acme", 4, True)]
    assert [r.effective_to for r in rows] == [t(3), t(4), None]
    items = {r.purchase_order_item_id: r for r in built["fact_purchase_order_item"].collect()}
    assert items["i1"].supplier_key == rows[-1].supplier_key and items["i1"].is_on_time_in_full and not items["i1"].is_partial and items["i2"].is_partial
    assert items["i2"].is_on_time_in_full is False
    assert built["dim_date"].count() == 31 and one(built["dim_date"], "date_key", 20240106).is_weekend
    for name in {v.fact for v in cubes.VIEWS.values()}:
        assert built[name].count() > 0, name
    for name, required in REQUIRED.items():
        if name.startswith("dim_"):
            assert quality.missing_columns(built[name], required) == []


@pytest.mark.parametrize("name", sorted(cubes.VIEWS))
def test_every_view_answers_with_all_its_fields_and_measures(built, name):
    view = cubes.VIEWS[name]
    rows = view.query(built.__getitem__, list(view.fields), list(view.measures)).collect()
    assert rows and set(rows[0].asDict()) == {*view.fields, *view.measures}
    assert view.query(built.__getitem__, measures=list(view.measures)).count() == 1
    with pytest.raises(ValueError):
        view.query(built.__getitem__, ["nothing"])


def test_view_values(built):
    view = cubes.VIEWS["procurement_metrics"]
    rows = {r.supplier: r for r in view.query(built.__getitem__, ["supplier"], ["fill_rate", "otif_purchase_order_count", "open_value"]).collect()}
    assert (rows["Acme"].fill_rate, rows["Bolt"].fill_rate, rows["Acme"].otif_purchase_order_count, float(rows["Bolt"].open_value)) == (1.0, 0.4, 1, 60.0)
    assert [r.supplier for r in view.query(built.__getitem__, ["supplier"], where="po_status = 'SENT'").collect()] == ["Bolt"]
    assert sum(len(v.measures) for v in cubes.VIEWS.values()) == 95 and sum(len(v.joins) for v in cubes.VIEWS.values()) == 33 and sum(len(v.fields) for v in cubes.VIEWS.values()) == 65


def test_process_tables(built):
    cases = {r.case_id: r for r in built["process_case_summary"].collect()}
    assert (cases["work_order:o1"].event_count, cases["work_order:o1"].current_state, cases["work_order:o1"].case_duration_seconds) == (3, "CLOSED", 3600)
    first = built["process_transition_summary"].filter("from_state IS NULL").first()
    assert (first.to_state, first.transition_count, first.avg_seconds_from_previous) == ("PLANNED", 1, None)


def test_checks(spark, built):
    found = {r.check_name: r.actual for r in quality.checks(model.violations(built, spark.createDataFrame([("a", 3, 2)], "source_table string, last_commit_version bigint, source_version bigint"))).collect()}
    assert found.pop("checkpoint_ahead_of_source") == 1 and not any(found.values()) and len(found) == 10
    more = model.violations(built, registry=cubes.registry(spark), views=set(cubes.VIEWS) - {"payment_metrics"}, results=model.expectations(built).withColumn("observed_at", F.lit(1)))
    found = {r.check_name: r.actual for r in quality.checks(more).collect()}
    assert len(found) == 13 and found.pop("semantic_cube_coverage") == 1 and not any(found.values())
    wrong = cubes.registry(spark).filter("cube_name <> 'payment_metrics'").replace("fact_work_order", "fact_other")
    assert quality.checks({"c": model.violations(built, registry=wrong, views=set(cubes.VIEWS))["semantic_fact_coverage"]}).first().actual == 3
    soft = {r.check_name: r.actual for r in quality.checks(model.reconciliations(built)).collect()}
    assert soft == {"cancelled_work_order_with_active_material_demand": 1, "cancelled_po_with_non_cancelled_requisition": 0, "voided_ap_with_payment": 0, "released_invoice_without_prior_block": 0}
    results = model.expectations(built).collect()
    assert len(results) == 7 and all(r.failed_rows == 0 for r in results)
    assert quality.coverage(spark, [v.fact for v in cubes.VIEWS.values()], {v.name: v.fact for v in cubes.VIEWS.values()}).isEmpty()
    assert [r.cube_count for r in quality.coverage(spark, ["f", "g"], {"a": "f", "b": "f"}).orderBy("fact_table").collect()] == [2, 0]


def test_facts_are_merged_by_their_write_modes(spark, built, tmp_path):
    root = str(tmp_path)
    facts = {name: built[name] for name in ("fact_work_order", "fact_inventory_movement", "fact_stock_position")}
    model.merge_facts(facts, root)
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = files()
    again = model.merge_facts(facts, root)
    assert files() == before and again["fact_work_order"].count() == 2  # nothing has changed, so nothing is written
    moved = {
        "fact_work_order": built["fact_work_order"].filter("work_order_id = 'o1'").withColumns({"asset_key": F.lit(1).cast("long"), "status": F.lit("COMPLETED")}),
        "fact_inventory_movement": built["fact_inventory_movement"].withColumn("quantity", F.lit(99.0)),
        "fact_stock_position": built["fact_stock_position"].withColumns({"material_key": F.lit(2).cast("long"), "on_hand": F.lit(5.0)})}
    after = model.merge_facts(moved, root)
    order = one(after["fact_work_order"], "work_order_id", "o1")
    assert (order.status, order.asset_key) == ("COMPLETED", one(built["fact_work_order"], "work_order_id", "o1").asset_key)
    assert after["fact_inventory_movement"].filter("quantity = 99").isEmpty() and after["fact_inventory_movement"].count() == 3
    assert {(r.material_key, r.on_hand) for r in after["fact_stock_position"].collect()} == {(2, 5.0)}
    assert set(model.WRITES) == {v.fact for v in cubes.VIEWS.values()}
    for name, (keys, _, date) in model.WRITES.items():
        assert {*keys, *([date] if date else [])} <= set(built[name].columns), name


def test_dimensions_are_advanced(spark, bronze, tmp_path):
    root, last = str(tmp_path), 3
    old = lambda name: bronze(name).filter(F.col("_source_commit_version") <= last)
    model.merge_dims(old, old, root)
    out = model.merge_dims(bronze, lambda name: bronze(name).filter(F.col("_source_commit_version") > last), root)
    for name, table in out.items():
        natural = name.removeprefix("dim_")
        rows = bronze(natural).withColumnsRenamed({"id": f"{natural}_id", "_source_commit_version": "source_commit_version", "_source_commit_timestamp": "source_commit_at"})
        want = model.dimensions.scd2(rows, f"{natural}_id", model._ATTRIBUTES[natural], surrogate=f"{natural}_key", seen=True)
        assert sorted(map(str, table.select(*want.columns).collect())) == sorted(map(str, want.collect()))
