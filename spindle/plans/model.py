"""From the ingested source tables to conformed tables, dimensions and facts.

Every function takes ``bronze``, which gives an ingested table by its source name (as ``changes.publicize`` makes
them), and returns DataFrames; what is run here is the count of rows by key before windows, and ``publish``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators import changes, dimensions, measures, process, quality
from spindle.operators.measures import amount, date_key, percent
from spindle.sources import tables
from spindle.sources.schemas import SOURCES

from . import cubes

Tables = Callable[[str], DataFrame]


def _latest(bronze: Tables, name: str) -> DataFrame:
    return changes.latest_per_key(bronze(name), list(SOURCES[name].key))


def _public(df: DataFrame) -> DataFrame:
    """Without the columns of ingestion, but for when the source committed the row and when it was ingested."""
    return df.withColumns({"source_commit_at": F.col("_source_commit_timestamp"), "bronze_ingested_at": F.col("_bronze_ingested_at")}).drop(*(c for c in df.columns if c.startswith("_")))


def masters(bronze: Tables) -> dict[str, DataFrame]:
    """supplier, warehouse, cost_center, material, asset, asset_material_profile with readable names and units."""
    supplier, warehouse, center, material, asset, profile = (_latest(bronze, n) for n in ("supplier", "warehouse", "cost_center", "material", "asset", "asset_material_profile"))
    origin = (F.col("_source_commit_version").alias("source_commit_version"), F.col("_bronze_ingested_at").alias("source_ingested_at"))
    named = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(f"{name}_name"), "active", *origin)
    warehouse, center = named(warehouse, "warehouse"), named(center, "cost_center")
    material = material.select(
        F.col("id").alias("material_id"), "description", "category", "uom", "ncm", "criticality", amount("unit_cost_cents").alias("unit_cost"), "reorder_point", "reorder_qty",
        "preferred_supplier_id", *(percent(f"{t}_bps").alias(f"{t}_pct") for t in ("icms", "ipi", "pis", "cofins")), "active", *origin)
    names = lambda df: df.drop("active", "source_commit_version", "source_ingested_at")
    public = [c for c in asset.columns if not c.startswith("_") and c != "id"]
    asset = asset.select(F.col("id").alias("asset_id"), *public, *origin).join(names(warehouse), "warehouse_id", "left").join(names(center), "cost_center_id", "left")
    profile = profile.select("asset_id", "material_id", F.col("probability").cast("decimal(9,6)").alias("probability"), "min_qty", "max_qty", *origin).join(asset.select("asset_id", "asset_type"), "asset_id")
    return {
        "supplier": supplier.select(
            F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "tax_id", "lead_time_days", "payment_term_days",
            *(F.col(c).cast("decimal(9,6)").alias(c) for c in ("delivery_reliability", "price_variability")), "active", *origin),
        "warehouse": warehouse, "cost_center": center, "material": material, "asset": asset,
        "asset_material_profile": profile.join(material.select("material_id", F.col("category").alias("material_category")), "material_id"),
    }


def _transitions(bronze: Tables, entity: str) -> DataFrame:
    rows = bronze("entity_state_transition_store").filter(F.col("entity_type") == entity)
    return rows.select(F.col("entity_id").alias(f"{entity}_id"), "from_state", "to_state", "reason", "occurred_at")


def maintenance(bronze: Tables, known: dict[str, DataFrame], horizon: Column) -> dict[str, DataFrame]:
    """Work orders with their phases, requirement lines, the lifecycle of both together, and the history of states."""
    history = _transitions(bronze, "work_order")
    ends = measures.terminal_times(history, "work_order_id", {"CANCELLED": "cancelled_at"})
    orders = _public(_latest(bronze, "work_order_state")).withColumnRenamed("id", "work_order_id").join(ends, "work_order_id", "left").withColumns(measures.work_order_hours(horizon))
    # an order of an unknown asset isn't published, as its place and cost center aren't known either
    asset = known["asset"].select("asset_id", F.col("description").alias("asset_description"), "asset_type", F.col("criticality").alias("asset_criticality"), "cost_center_name", "warehouse_name")
    orders = orders.join(asset, "asset_id")
    lines = _public(_latest(bronze, "work_order_material_state")).withColumnRenamed("id", "work_order_material_id")
    lines = lines.join(known["material"].select("material_id", "description", "category", "unit_cost"), "material_id").withColumns(measures.fulfilment("qty_required", "qty_issued", "unit_cost"))
    lifecycle = measures.lifecycle_rollup(orders, lines.withColumn("line_status", F.col("status")), history, "work_order_id")
    return {"work_order_status_history": history, "work_order": orders, "work_order_material": lines, "work_order_lifecycle": lifecycle}


def inventory(bronze: Tables, known: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Movements with their direction and value, and what is in stock."""
    material = known["material"].select("material_id", "description", "category")
    moves = _public(bronze("inventory_movement_store")).withColumnRenamed("id", "movement_id").withColumn("unit_cost", amount("unit_cost_cents"))
    moves = moves.withColumns(measures.movement("quantity", "unit_cost")).join(material, "material_id").join(known["warehouse"].select("warehouse_id", "warehouse_name"), "warehouse_id")
    # balances of an unknown material or warehouse aren't published
    named = known["material"].select("material_id", F.col("description").alias("material_description"), F.col("category").alias("material_category"), "unit_cost", "reorder_point", "reorder_qty")
    stock = _public(_latest(bronze, "stock_balance_state")).join(named, "material_id").join(known["warehouse"].select("warehouse_id", "warehouse_name"), "warehouse_id")
    return {"inventory_movement": moves, "stock_position": stock.withColumns(measures.stock("on_hand", "reserved", "unit_cost"))}


def procurement(bronze: Tables, known: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Requisitions, purchase orders, receipts and their items."""
    requests = measures.terminal_times(_transitions(bronze, "purchase_requisition"), "purchase_requisition_id", {"REJECTED": "rejected_at", "CANCELLED": "cancelled_at"})
    ends = measures.terminal_times(_transitions(bronze, "purchase_order"), "purchase_order_id", {"CANCELLED": "cancelled_at"})
    requisition = _public(_latest(bronze, "purchase_requisition_state")).withColumnRenamed("id", "purchase_requisition_id").join(requests, "purchase_requisition_id", "left")
    orders = _public(_latest(bronze, "purchase_order_state")).withColumnRenamed("id", "purchase_order_id").join(ends, "purchase_order_id", "left")
    orders = orders.withColumns(measures.delivery("promised_at", "received_at", "approved_at", "sent_at")).join(known["supplier"].select("supplier_id", "supplier_name"), "supplier_id").join(known["warehouse"].drop("active"), "warehouse_id", "left")
    items = _public(_latest(bronze, "purchase_order_item_state")).select(
        F.col("id").alias("purchase_order_item_id"), "purchase_order_id", "requisition_item_id", "material_id", F.col("quantity").alias("ordered_qty"), F.col("received_qty"), amount("unit_price_cents").alias("unit_price"), "source_commit_at")
    material = known["material"].select("material_id", "description")
    return {
        "purchase_requisition": requisition.withColumn("approval_lead_hours", measures.hours("requested_at", "approved_at")),
        "purchase_requisition_item": _public(bronze("purchase_requisition_item_store")).withColumnRenamed("id", "purchase_requisition_item_id").join(material, "material_id"),
        "purchase_order": orders, "purchase_order_item": items.withColumns(measures.order_line("ordered_qty", "received_qty", "unit_price")).join(material, "material_id"),
        "goods_receipt": _public(bronze("goods_receipt_store")).withColumnRenamed("id", "goods_receipt_id"),
        "goods_receipt_item": _public(bronze("goods_receipt_item_store")).withColumnRenamed("id", "goods_receipt_item_id").join(material, "material_id"),
    }


def finance(bronze: Tables, known: dict[str, DataFrame], horizon: Column) -> dict[str, DataFrame]:
    """Invoices and their items, payable titles and payments."""
    supplier = known["supplier"].select("supplier_id", "supplier_name")
    blocked = measures.ever(_transitions(bronze, "fiscal_invoice"), "fiscal_invoice_id", F.col("to_state") == "BLOCKED", "was_blocked")
    invoices = _public(_latest(bronze, "fiscal_invoice_state")).withColumnRenamed("id", "fiscal_invoice_id").withColumns(
        {"subtotal": amount("subtotal_cents"), "tax_total": amount("tax_total_cents"), "total_amount": amount("total_amount_cents"), "price_variance_pct": percent("price_variance_bps")})
    invoices = invoices.join(blocked, "fiscal_invoice_id", "left").withColumn("was_blocked", F.coalesce(F.col("was_blocked") == 1, F.lit(False))).join(supplier, "supplier_id")
    items = _public(bronze("fiscal_invoice_item_store")).withColumnsRenamed({"id": "fiscal_invoice_item_id", "invoice_id": "fiscal_invoice_id"}).withColumn("unit_price", amount("unit_price_cents"))
    items = items.withColumns({"merchandise_value": (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)"), **{f"{t}_amount": amount(f"{t}_cents") for t in ("icms", "ipi", "pis", "cofins")}})
    voided = measures.terminal_times(_transitions(bronze, "accounts_payable"), "accounts_payable_id", {"VOIDED": "voided_at"})
    titles = _public(_latest(bronze, "accounts_payable_state")).withColumnsRenamed({"id": "accounts_payable_id", "invoice_id": "fiscal_invoice_id"}).join(voided, "accounts_payable_id", "left")
    titles = titles.withColumn("amount", amount("amount_cents")).withColumns(measures.payable_age("status", "due_at", "posted_at", "paid_at", horizon)).join(supplier, "supplier_id")
    payments = bronze("payment_store").select(F.col("id").alias("payment_id"), "payment_no", "accounts_payable_id", amount("amount_cents").alias("amount"), "paid_at")
    return {"fiscal_invoice": invoices, "fiscal_invoice_item": items, "accounts_payable": titles, "payment": payments}


_ATTRIBUTES = {
    "supplier": ["name", "tax_id", "lead_time_days", "payment_term_days", "delivery_reliability", "price_variability", "active"],
    "material": ["description", "category", "uom", "ncm", "criticality", "unit_cost_cents", "reorder_point", "reorder_qty", "preferred_supplier_id", "icms_bps", "ipi_bps", "pis_bps", "cofins_bps", "active"],
    "asset": ["description", "asset_type", "criticality", "cost_center_id", "warehouse_id", "active"],
}


def dims(bronze: Tables, known: dict[str, DataFrame], bounds: DataFrame) -> dict[str, DataFrame]:
    """dim_supplier, dim_material, dim_asset with history, dim_warehouse, dim_cost_center, dim_date."""
    out = {}
    for name, attributes in _ATTRIBUTES.items():
        rows = bronze(name).withColumnsRenamed({"id": f"{name}_id", "_source_commit_version": "source_commit_version", "_source_commit_timestamp": "source_commit_at"})
        dim = dimensions.scd2(rows, f"{name}_id", attributes, surrogate=f"{name}_key")
        out[f"dim_{name}"] = dim.withColumnRenamed("name", "supplier_name") if name == "supplier" else dim
    out |= {f"dim_{n}": dimensions.type1(known[n], f"{n}_id", f"{n}_key") for n in ("warehouse", "cost_center")}
    return out | {"dim_date": dimensions.date_dimension(bounds)}


def facts(t: dict[str, DataFrame], d: dict[str, DataFrame], snapshot_at: Column) -> dict[str, DataFrame]:
    """The ten facts with the current keys of their dimensions. t: all conformed tables, d: dimensions."""

    def keyed(rows: DataFrame, *names: str) -> DataFrame:
        for n in names:
            rows = dimensions.with_key(rows, d[f"dim_{n}"], f"{n}_id", f"{n}_key")
        return rows

    orders, purchase = t["work_order_lifecycle"], t["purchase_order"]
    lines = t["work_order_material"].join(
        orders.select("work_order_id", "asset_id", "cost_center_id", "warehouse_id", "maintenance_type", "priority", "planned_at", F.col("status").alias("work_order_status")), "work_order_id")
    items = t["purchase_order_item"].join(
        purchase.select("purchase_order_id", "po_no", "supplier_id", "warehouse_id", "status", "approved_at", "promised_at", "received_at", "cancelled_at", "delivery_variance_hours", "received_on_time"), "purchase_order_id")
    receipts = t["goods_receipt_item"].join(t["goods_receipt"].select("goods_receipt_id", "purchase_order_id", "warehouse_id", "received_at"), "goods_receipt_id")
    receipts = receipts.join(t["purchase_order_item"].select("purchase_order_item_id", "unit_price"), "purchase_order_item_id").join(purchase.select("purchase_order_id", "supplier_id"), "purchase_order_id")
    invoice = t["fiscal_invoice"]
    invoice_items = t["fiscal_invoice_item"].join(invoice.select("fiscal_invoice_id", "supplier_id", "received_at"), "fiscal_invoice_id")
    titles = keyed(t["accounts_payable"], "supplier")
    days = lambda **columns: {f"{name}_date_key": date_key(c) for name, c in columns.items()}
    return {
        "fact_work_order": keyed(orders, "asset", "cost_center", "warehouse").withColumns(days(planned="planned_at", released="released_at", completed="completed_at", closed="closed_at")),
        "fact_work_order_material": keyed(lines, "material", "asset", "cost_center", "warehouse").withColumns(days(planned="planned_at")),
        "fact_inventory_movement": keyed(t["inventory_movement"], "material", "warehouse").withColumns(days(movement="occurred_at")),
        "fact_stock_position": keyed(t["stock_position"], "material", "warehouse").withColumns({"snapshot_at": snapshot_at, "snapshot_date_key": date_key(snapshot_at)}),
        "fact_purchase_order_item": keyed(items, "supplier", "material", "warehouse").withColumns(days(order="approved_at", promised="promised_at") | measures.order_flags("ordered_qty", "received_qty", "received_on_time")),
        "fact_goods_receipt_item": keyed(receipts, "supplier", "material", "warehouse").withColumns(days(receipt="received_at") | {"receipt_value": (F.col("qty_received") * F.col("unit_price")).cast("decimal(18,2)")}),
        "fact_fiscal_invoice": keyed(invoice, "supplier").withColumns(days(received="received_at")),
        "fact_fiscal_invoice_item": keyed(invoice_items, "supplier", "material").withColumns(days(received="received_at")),
        "fact_accounts_payable": titles.withColumns(days(posted="posted_at", due="due_at", paid="paid_at")),
        "fact_payment": t["payment"].join(titles.select("accounts_payable_id", "supplier_key"), "accounts_payable_id").withColumns(days(payment="paid_at")),
    }


#: How each fact is written: its key, what becomes of a row that is there already (keep: nothing; freeze: measures are renewed, dimension keys
#: stay; rebind: all is renewed), and the date key that its parts follow.
WRITES: dict[str, tuple[list[str], str, str]] = {
    "fact_work_order": (["work_order_id"], "freeze", "planned_date_key"),
    "fact_work_order_material": (["work_order_material_id"], "freeze", "planned_date_key"),
    "fact_inventory_movement": (["movement_id"], "keep", "movement_date_key"),
    "fact_stock_position": (["material_id", "warehouse_id"], "rebind", ""),
    "fact_purchase_order_item": (["purchase_order_item_id"], "freeze", "order_date_key"),
    "fact_goods_receipt_item": (["goods_receipt_item_id"], "freeze", "receipt_date_key"),
    "fact_fiscal_invoice": (["fiscal_invoice_id"], "freeze", "received_date_key"),
    "fact_fiscal_invoice_item": (["fiscal_invoice_item_id"], "freeze", "received_date_key"),
    "fact_accounts_payable": (["accounts_payable_id"], "freeze", "posted_date_key"),
    "fact_payment": (["payment_id"], "freeze", "payment_date_key"),
}


def merge_facts(found: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Merges rows of facts, new and renewed ones, into the tables under root, each as ``WRITES`` has it; gives the tables.

    A part holds a month, so a step writes the months that its rows are in. Rows that are there with the same values aren't
    written again; what has no date is one part.
    """
    out = {}
    for name, rows in found.items():
        keys, mode, date = WRITES[name]
        dimension_keys = [c for c in rows.columns if c.endswith("_key") and not c.endswith("_date_key")]

        def merge(old: DataFrame, new: DataFrame, keys=keys, mode=mode, dimension_keys=dimension_keys) -> DataFrame:  # noqa: ANN001
            if mode == "keep":
                return changes.insert_only(old, new, keys)
            return changes.upsert(old, new, keys) if mode == "rebind" else changes.upsert_preserving(old, new, keys, dimension_keys)

        spark = rows.sparkSession
        if tables.exists(spark, root, name):
            known = tables.current(spark, root, name)
            # frozen keys don't count as changes, nor do rows that are kept as they are
            compared = rows.columns if mode == "rebind" else keys if mode == "keep" else [c for c in rows.columns if c not in dimension_keys]
            changed = changes.changed_rows(known, rows.select(*compared), keys).select(*keys)
            rows = rows.alias("t").join(changed.alias("s"), changes.match(keys), "left_semi")
        part = F.floor(F.col(date) / 100) if date else F.lit(0)
        out[name] = tables.merge_into(rows, root, name, merge, keys, part)
    return out


def merge_dims(bronze: Tables, new: Tables, root: str, buckets: int = 16) -> dict[str, DataFrame]:
    """Advances the dimensions with history under root by the versions that ``new`` gives of their sources; gives the tables.

    bronze has all versions, new ones included; of it only keys are read to which versions come late. The first time it is
    all built from bronze.
    """
    out = {}
    for name, attributes in _ATTRIBUTES.items():
        natural, table = f"{name}_id", f"dim_{name}"
        named = lambda df, natural=natural: df.withColumnsRenamed({"id": natural, "_source_commit_version": "source_commit_version", "_source_commit_timestamp": "source_commit_at"})
        every, part = named(bronze(name)), F.pmod(F.xxhash64(natural), F.lit(buckets))
        if not tables.exists(every.sparkSession, root, table):
            out[table] = tables.replace(dimensions.scd2(every, natural, attributes, surrogate=f"{name}_key", seen=True), root, table, part)
            continue
        grown = dimensions.advance_scd2(tables.current(every.sparkSession, root, table), named(new(name)), every, natural, attributes, surrogate=f"{name}_key")
        out[table] = tables.merge_into(grown, root, table, lambda old, rows, natural=natural: changes.upsert(old, rows, [natural]), [natural], part, True)
    return out


def mining(bronze: Tables) -> dict[str, DataFrame]:
    """process_event, process_case_summary and process_transition_summary."""
    rows = bronze("entity_state_transition_store").withColumnsRenamed({"id": "transition_id", "_source_commit_timestamp": "source_commit_at"})
    events = process.event_log(rows)
    return {"process_event": events, "process_case_summary": process.case_summary(events), "process_transition_summary": process.transition_summary(events)}


def build(bronze: Tables, horizon: Column, bounds: DataFrame) -> dict[str, DataFrame]:
    """All conformed tables, dimensions, facts and process tables by name."""
    known = masters(bronze)
    conformed = known | maintenance(bronze, known, horizon) | inventory(bronze, known) | procurement(bronze, known) | finance(bronze, known, horizon)
    d = dims(bronze, known, bounds)
    return conformed | d | facts(conformed, d, horizon) | mining(bronze)


def violations(m: dict[str, DataFrame], checkpoints: DataFrame | None = None, registry: DataFrame | None = None, views: set[str] | None = None, results: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows that break each hard check, by its name; checks without their table are left out.

    checkpoints: source_table, last_commit_version, source_version (null: no such source). registry: as ``cubes.registry``
    gives it, and views: the names of the metric views there are. results: of expectations, with observed_at.
    """
    slack = measures.TOLERANCE
    d = {
        "negative_stock": m["stock_position"].filter("on_hand < 0 OR reserved < 0"),
        "work_order_material_overissue": m["work_order_material"].filter(F.col("qty_issued") > F.col("qty_required") + slack),
        "purchase_order_overreceipt": m["purchase_order_item"].filter(F.col("received_qty") > F.col("ordered_qty") + slack),
        "paid_ap_without_paid_at": m["accounts_payable"].filter("status = 'PAID' AND paid_at IS NULL"),
        "orphan_gold_work_order_asset": quality.orphans(m["fact_work_order"], m["dim_asset"], "asset_key"),
        "orphan_gold_inventory_material": quality.orphans(m["fact_inventory_movement"], m["dim_material"], "material_key"),
        "duplicate_gold_material_key": quality.duplicates(m["dim_material"], ["material_key"]),
        **{f"dim_{n}_single_current_version": quality.not_single_current(m[f"dim_{n}"], f"{n}_id") for n in ("supplier", "material", "asset")},
    }
    if checkpoints is not None:
        d["checkpoint_ahead_of_source"] = checkpoints.filter("source_version IS NULL OR last_commit_version > source_version")
    if registry is not None:
        spark = registry.sparkSession
        wanted = spark.createDataFrame([(v.fact, v.name) for v in cubes.VIEWS.values()], "fact_table string, wanted string")
        both = registry.select("fact_table", "cube_name").join(wanted, "fact_table", "full_outer")
        d["semantic_fact_coverage"] = both.filter("cube_name IS NULL OR wanted IS NULL OR cube_name <> wanted")
        d["semantic_cube_coverage"] = wanted.filter(~F.col("wanted").isin(*(views or {""})))
    if results is not None:
        d["declarative_expectations"] = quality.failing_rules(results)
    return d


def reconciliations(m: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that break each check across entities, which may do so for a while as tables are ingested one after another."""
    orders = m["work_order"].filter("status = 'CANCELLED'").select("work_order_id")
    requests = m["purchase_requisition"].select(F.col("purchase_requisition_id").alias("requisition_id"), F.col("status").alias("requisition_status"))
    paid = m["payment"].select("accounts_payable_id").distinct()
    released = m["fiscal_invoice"].filter("status = 'RELEASED'")
    return {
        "cancelled_work_order_with_active_material_demand": m["work_order_material"].filter("status NOT IN ('CANCELLED', 'FULFILLED')").join(orders, "work_order_id", "left_semi"),
        "cancelled_po_with_non_cancelled_requisition": m["purchase_order"].filter("status = 'CANCELLED'").join(requests, "requisition_id").filter("requisition_status <> 'CANCELLED'"),
        "voided_ap_with_payment": m["accounts_payable"].filter("status = 'VOIDED'").join(paid, "accounts_payable_id", "left_semi"),
        "released_invoice_without_prior_block": released.filter("NOT was_blocked"),
    }


def rules() -> dict[str, list[quality.Rule]]:
    """The seven rules by published table."""
    slack, rule = measures.TOLERANCE, quality.Rule
    window = F.col("effective_to").isNull() | (F.col("effective_to") > F.col("effective_from"))
    return {
        "stock_position": [rule("non_negative_stock", (F.col("on_hand") >= 0) & (F.col("reserved") >= 0))],
        "work_order_material": [rule("issued_not_above_required", F.col("qty_issued") <= F.col("qty_required") + slack)],
        "purchase_order_item": [rule("received_not_above_ordered", F.col("received_qty") <= F.col("ordered_qty") + slack)],
        "accounts_payable": [rule("paid_has_timestamp", (F.col("status") != "PAID") | F.col("paid_at").isNotNull())],
        **{f"dim_{n}": [rule("valid_scd2_window", window)] for n in ("supplier", "material", "asset")},
    }


def expectations(m: dict[str, DataFrame]) -> DataFrame:
    """Results of the seven rules on published tables."""
    frames = [quality.expectations(m[name], name, r) for name, r in rules().items()]
    return tables.union_all(*frames)


def publish(m: dict[str, DataFrame], root: str, now: Column, run_id: str, hard: bool = True) -> dict[str, DataFrame]:
    """Writes the tables under root, each with its rules counted by the write itself, and gives them as written.

    What was counted is added to ``expectation_result`` and ``asset_observation``. If a rule of action fail is broken and
    ``hard``, the results are kept, the table isn't replaced, and ``quality.QualityError`` is raised; later tables aren't written.
    """
    out, wanted = {}, rules()
    for name, df in m.items():
        spark = df.sparkSession
        watch = quality.Watch(name, wanted.get(name, []), "source_commit_at" if "source_commit_at" in df.columns else None)

        def accept(watch: quality.Watch = watch) -> None:
            stamp = (F.lit(run_id).alias("run_id"), now.cast("timestamp").alias("observed_at"))
            if watch.rules:
                tables.append(watch.results(spark).select(*stamp, "*"), root, "expectation_result")
            tables.append(watch.observed(spark, now, "published").select(*stamp, "*"), root, "asset_observation")
            if hard:
                watch.require()

        out[name] = tables.replace(watch(df), root, name, accept=accept)
    return out
