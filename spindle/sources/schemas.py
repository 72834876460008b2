"""Source tables: columns, keys and how each changes. Fixed values of the source system's contract."""

from __future__ import annotations

from dataclasses import dataclass

#: Columns of the source that analytics never sees.
PRIVATE = ("valid_from_tick", "simulation_tick")


@dataclass(frozen=True)
class Source:
    """kind: master (replaced in place), state (a row a change of a key) or event (rows are only added)."""

    ddl: str
    kind: str
    key: tuple[str, ...] = ("id",)


SOURCES: dict[str, Source] = {
    "supplier": Source("id string, name string, tax_id string, lead_time_days int, payment_term_days int, delivery_reliability double, price_variability double, active boolean", "master"),
    "warehouse": Source("id string, name string, active boolean", "master"),
    "cost_center": Source("id string, name string, active boolean", "master"),
    "asset": Source("id string, description string, asset_type string, criticality string, cost_center_id string, warehouse_id string, active boolean", "master"),
    "material": Source(
        "id string, description string, category string, uom string, ncm string, criticality string, unit_cost_cents bigint, reorder_point double, reorder_qty double, "
        "preferred_supplier_id string, icms_bps int, ipi_bps int, pis_bps int, cofins_bps int, active boolean", "master"),
    "asset_material_profile": Source("asset_id string, material_id string, probability double, min_qty double, max_qty double", "master", ("asset_id", "material_id")),
    "sim_state": Source("id string, simulated_at timestamp, committed_tick bigint, seed int, step_minutes int, business_timezone string, updated_at timestamp", "master"),
    "simulation_run": Source("run_id string, started_at timestamp, finished_at timestamp, from_tick bigint, to_tick bigint, status string, error string", "event", ("run_id",)),
    "stock_balance_state": Source("material_id string, warehouse_id string, on_hand double, reserved double, last_counted_at timestamp, valid_from_tick bigint", "state", ("material_id", "warehouse_id")),
    "work_order_state": Source(
        "id string, order_no string, asset_id string, maintenance_type string, priority string, status string, cost_center_id string, warehouse_id string, planned_at timestamp, "
        "release_after timestamp, released_at timestamp, started_at timestamp, complete_after timestamp, completed_at timestamp, close_after timestamp, closed_at timestamp, valid_from_tick bigint", "state"),
    "work_order_material_state": Source("id string, work_order_id string, material_id string, qty_required double, qty_issued double, status string, valid_from_tick bigint", "state"),
    "purchase_requisition_state": Source(
        "id string, request_no string, warehouse_id string, source_type string, source_ref string, priority string, status string, requested_at timestamp, approve_after timestamp, "
        "approved_at timestamp, valid_from_tick bigint", "state"),
    "purchase_requisition_item_store": Source("id string, requisition_id string, material_id string, quantity double, simulation_tick bigint", "event"),
    "purchase_order_state": Source(
        "id string, po_no string, requisition_id string, supplier_id string, warehouse_id string, status string, approved_at timestamp, send_after timestamp, sent_at timestamp, "
        "promised_at timestamp, next_receipt_at timestamp, received_at timestamp, closed_at timestamp, receipt_count int, valid_from_tick bigint", "state"),
    "purchase_order_item_state": Source(
        "id string, purchase_order_id string, requisition_item_id string, material_id string, quantity double, unit_price_cents bigint, received_qty double, valid_from_tick bigint", "state"),
    "goods_receipt_store": Source("id string, receipt_no string, purchase_order_id string, warehouse_id string, received_at timestamp, simulation_tick bigint", "event"),
    "goods_receipt_item_store": Source("id string, goods_receipt_id string, purchase_order_item_id string, material_id string, qty_received double, simulation_tick bigint", "event"),
    "inventory_movement_store": Source(
        "id string, material_id string, warehouse_id string, movement_type string, quantity double, unit_cost_cents bigint, reference_type string, reference_id string, "
        "occurred_at timestamp, simulation_tick bigint", "event"),
    "fiscal_invoice_state": Source(
        "id string, invoice_no string, supplier_id string, purchase_order_id string, goods_receipt_id string, status string, issued_at timestamp, received_at timestamp, "
        "validate_after timestamp, validation_complete_after timestamp, blocked_until timestamp, subtotal_cents bigint, tax_total_cents bigint, total_amount_cents bigint, "
        "price_variance_bps int, tax_issue boolean, valid_from_tick bigint", "state"),
    "fiscal_invoice_item_store": Source(
        "id string, invoice_id string, material_id string, quantity double, unit_price_cents bigint, icms_cents bigint, ipi_cents bigint, pis_cents bigint, cofins_cents bigint, simulation_tick bigint", "event"),
    "accounts_payable_state": Source(
        "id string, invoice_id string, supplier_id string, status string, amount_cents bigint, posted_at timestamp, due_at timestamp, scheduled_at timestamp, "
        "payment_scheduled_for timestamp, paid_at timestamp, valid_from_tick bigint", "state"),
    "payment_store": Source("id string, payment_no string, accounts_payable_id string, amount_cents bigint, paid_at timestamp, simulation_tick bigint", "event"),
    "entity_state_transition_store": Source(
        "id string, entity_type string, entity_id string, from_state string, to_state string, reason string, occurred_at timestamp, simulation_tick bigint", "event"),
    "event_log_store": Source("id string, event_type string, entity_type string, entity_id string, occurred_at timestamp, payload string, simulation_tick bigint", "event"),
}

#: Columns that consumers rely on: they may be added to, never taken away.
REQUIRED: dict[str, tuple[str, ...]] = {
    "supplier": ("id", "name", "lead_time_days", "payment_term_days", "delivery_reliability", "price_variability", "active"),
    "material": ("id", "description", "category", "uom", "criticality", "unit_cost_cents", "reorder_point", "reorder_qty", "preferred_supplier_id", "active"),
    "asset": ("id", "description", "asset_type", "criticality", "cost_center_id", "warehouse_id", "active"),
    "entity_state_transition_store": ("id", "entity_type", "entity_id", "from_state", "to_state", "reason", "occurred_at"),
    "dim_supplier": ("supplier_key", "supplier_id", "effective_from", "effective_to", "is_current"),
    "dim_material": ("material_key", "material_id", "effective_from", "effective_to", "is_current"),
    "dim_asset": ("asset_key", "asset_id", "effective_from", "effective_to", "is_current"),
}
