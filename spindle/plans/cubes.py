"""The ten metric views: a fact, dimensions it joins many to one, fields to group by and governed measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.measures import count_if, ratio
from spindle.sources import tables as stored

#: A column of the fact (``source``) or of a joined dimension by its alias.
S = lambda name: F.col(f"source.{name}")


class Aggregates:
    """The aggregates that measures are made of: over rows, or, while states are collected, over states of rows.

    A state is itself an aggregate of rows, and states of parts of the rows give what all rows would: ``states`` has the
    name and aggregate of each, by kind and expression, so that measures share them.
    """

    def __init__(self):
        self.states: dict[str, tuple[str, Column]] | None = None

    def _of(self, kind: str, value: Column, make: Callable[[Column], Column], again: Callable[[Column], Column]) -> Column:
        if self.states is None:
            return make(value)
        name, _ = self.states.setdefault(f"{kind} {value}", (f"state_{len(self.states)}_{kind}", make(value)))
        return again(F.col(name))

    def count(self) -> Column:
        return self._of("count", F.lit(1), F.count, F.sum)

    def sum(self, value: Column) -> Column:
        return self._of("sum", value, F.sum, F.sum)

    def max(self, value: Column) -> Column:
        return self._of("max", value, F.max, F.max)

    def avg(self, value: Column) -> Column:
        return F.avg(value) if self.states is None else ratio(self.sum(value), self._of("known", value, F.count, F.sum))

    def count_if(self, condition: Column) -> Column:
        return self._of("met", condition, count_if, F.sum)

    def sum_if(self, condition: Column, value: Column) -> Column:
        return self.sum(F.when(condition, value).otherwise(0))

    def collected(self, measure: Callable[[], Column], states: dict[str, tuple[str, Column]]) -> Column:
        """The measure over states; those that it needs are added to states."""
        self.states = states
        try:
            return measure()
        finally:
            self.states = None


A = Aggregates()


@dataclass(frozen=True)
class Join:
    """A dimension table and the pair of columns that join it. The dimension's column is unique."""

    table: str
    fact_column: str
    key: str


@dataclass(frozen=True)
class Distinct:
    """How many different values a column has in rows that meet a condition."""

    column: str
    condition: Callable[[], Column] | None = None

    def __call__(self) -> Column:
        return F.count_distinct(F.when(self.condition(), S(self.column)) if self.condition else S(self.column))


@dataclass(frozen=True)
class MetricView:
    """fields: (alias, column) or a function that gives a column; measures: functions that give an aggregate."""

    name: str
    domain: str
    grain: str
    fact: str
    joins: dict[str, Join]
    fields: dict[str, tuple[str, str] | Callable[[], Column]]
    measures: dict[str, Callable[[], Column]] = field(repr=False)

    def rows(self, tables: Callable[[str], DataFrame], used: list[str]) -> tuple[DataFrame, dict[str, Column]]:
        """The fact (``source``) with the dimensions that the fields need, and the column of each field."""
        rows = tables(self.fact).alias("source")
        for alias in dict.fromkeys(self.fields[f][0] for f in used if not callable(self.fields[f])):
            if alias != "source":
                join = self.joins[alias]
                rows = rows.join(tables(join.table).alias(alias), F.col(f"source.{join.fact_column}") == F.col(f"{alias}.{join.key}"), "left")
        return rows, {f: self.fields[f]() if callable(self.fields[f]) else F.col(".".join(self.fields[f])) for f in used}

    def _through_values(self, rows: DataFrame, keys: list[Column], fields: list[str], measures: list[str], distinct: list[str]) -> DataFrame:
        """Measures whose distinct counts are of one column: a row for each of its values first, with states of all else and whether any row meets each condition."""
        states: dict[str, tuple[str, Column]] = {}
        over = {m: A.collected(self.measures[m], states) for m in measures if m not in distinct}
        own = {m: self.measures[m].condition for m in distinct}
        met = (F.max(F.coalesce(c(), F.lit(False)) if c else F.lit(True)).alias(f"met_{m}") for m, c in own.items())
        value = S(self.measures[distinct[0]].column).alias("_value")
        values = stored.dealt(rows, *keys, value).groupBy(*keys, value).agg(*met, *(state.alias(name) for name, state in states.values()))
        counts = {m: F.count(F.when(F.col(f"met_{m}"), F.col("_value"))) for m in own}
        return values.groupBy(*fields).agg(*((over | counts)[m].alias(m) for m in measures))

    def query(self, tables: Callable[[str], DataFrame], fields: list[str] = (), measures: list[str] = (), where: str | None = None) -> DataFrame:
        """The measures for each combination of the fields; without fields one row, without measures the distinct fields.

        Only the dimensions that a field asks for are joined, and by left joins, so that facts without a match
        stay. ``where`` is a condition on the fields' names.
        """
        if unknown := [*(set(fields) - set(self.fields)), *(set(measures) - set(self.measures))]:
            raise ValueError(f"{self.name} has no {', '.join(sorted(unknown))}")
        if not fields and not measures:
            raise ValueError("a field or a measure is needed")
        used = [f for f in self.fields if f in fields or where and f in where]
        rows, columns = self.rows(tables, used)
        if where:
            # named beside the fact's own columns, which a field may share its name with
            rows = rows.withColumns({f"_field_{f}": c for f, c in columns.items()})
            columns = {f: F.col(f"_field_{f}") for f in columns}
            for f in sorted(columns, key=len, reverse=True):
                where = _rename(where, f)
            rows = rows.filter(where)
        keys = [columns[f].alias(f) for f in fields]
        if not measures:
            return rows.select(*keys).distinct()
        # several distinct counts in one aggregate would multiply the rows by as many
        distinct = [m for m in measures if isinstance(self.measures[m], Distinct)]
        if len(distinct) < 2:
            return rows.groupBy(*keys).agg(*(self.measures[m]().alias(m) for m in measures))
        if len({self.measures[m].column for m in distinct}) == 1:
            return self._through_values(rows, keys, fields, measures, distinct)
        parts = [rows.groupBy(*keys).agg(F.lit(1).alias("_one"), *(self.measures[m]().alias(m) for m in measures if m not in distinct))]
        for column in dict.fromkeys(self.measures[m].column for m in distinct):
            own = {m: self.measures[m].condition for m in distinct if self.measures[m].column == column}
            # of each value, whether any of its rows meets each condition; then values are counted
            values = rows.groupBy(*keys, S(column).alias("_value")).agg(*(F.max(F.coalesce(c(), F.lit(False)) if c else F.lit(True)).alias(m) for m, c in own.items()))
            parts.append(values.groupBy(*fields).agg(F.lit(1).alias("_one"), *(F.count(F.when(F.col(m), F.col("_value"))).alias(m) for m in own)))
        out = parts[0]
        for part in parts[1:]:
            same = F.col("x._one") == F.col("y._one")
            for f in fields:
                same &= F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}"))
            out = out.alias("x").join(part.alias("y"), same).select("x.*", *(F.col(f"y.{m}") for m in part.columns if m not in (*fields, "_one")))
        return out.select(*fields, *measures)


def _rename(condition: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![\w.'`]){name}(?![\w'`])", f"`_field_{name}`", condition)


def _date(fact_column: str) -> Join:
    return Join("dim_date", fact_column, "date_key")


def _current(name: str) -> Join:
    return Join(f"dim_{name}", f"{name}_key", f"{name}_key")


_MATERIAL = {"material": ("material", "description"), "material_category": ("material", "category")}
_SUPPLIER = {"supplier": ("supplier", "supplier_name")}
_WAREHOUSE = {"warehouse": ("warehouse", "warehouse_name")}
_rows = lambda: A.count()
_sum = lambda c: lambda: A.sum(S(c))
_avg = lambda c: lambda: A.avg(S(c))
_distinct = Distinct
_is = lambda c, *values: lambda: A.count_if(S(c).isin(*values))
_sum_when = lambda c, value, amount: lambda: A.sum_if(S(c) == value, S(amount))
_taxes = lambda: S("icms_amount") + S("ipi_amount") + S("pis_amount") + S("cofins_amount")
_orders_when = lambda condition: Distinct("purchase_order_id", condition)

VIEWS: dict[str, MetricView] = {v.name: v for v in (
    MetricView(
        "maintenance_metrics", "maintenance", "one row per work order", "fact_work_order",
        {"asset": _current("asset"), "cost_center": _current("cost_center"), "warehouse": _current("warehouse"), "planned_date": _date("planned_date_key")},
        {"planned_date": ("planned_date", "full_date"), "planned_year": ("planned_date", "year"), "planned_month": ("planned_date", "month"),
         "maintenance_type": ("source", "maintenance_type"), "priority": ("source", "priority"), "status": ("source", "status"),
         "asset_type": ("asset", "asset_type"), "asset_criticality": ("asset", "criticality"), "cost_center": ("cost_center", "cost_center_name"), **_WAREHOUSE},
        {"work_order_count": _rows, "completed_work_order_count": _is("status", "COMPLETED", "CLOSED"), "closed_work_order_count": _is("status", "CLOSED"),
         "corrective_work_order_count": _is("maintenance_type", "CORRECTIVE"), "cancelled_work_order_count": _is("status", "CANCELLED"),
         "waiting_material_work_order_count": _is("waited_for_material", 1), "estimated_material_cost": _sum("estimated_material_cost"),
         "avg_planning_hours": _avg("planning_hours"), "avg_material_wait_hours": _avg("material_wait_hours"), "avg_execution_hours": _avg("execution_hours"),
         "avg_cycle_hours": _avg("elapsed_cycle_hours"), "material_wait_ratio": lambda: ratio(A.sum(S("material_wait_hours")), A.sum(S("elapsed_cycle_hours")))}),
    MetricView(
        "maintenance_material_metrics", "maintenance", "one row per work-order material requirement", "fact_work_order_material",
        {"material": _current("material"), "asset": _current("asset"), "cost_center": _current("cost_center"), "warehouse": _current("warehouse"), "planned_date": _date("planned_date_key")},
        {"planned_date": ("planned_date", "full_date"), **_MATERIAL, "material_criticality": ("material", "criticality"), "asset_type": ("asset", "asset_type"),
         "cost_center": ("cost_center", "cost_center_name"), **_WAREHOUSE, "maintenance_type": ("source", "maintenance_type"), "priority": ("source", "priority"),
         "work_order_status": ("source", "work_order_status"), "material_status": ("source", "status")},
        {"material_requirement_line_count": _rows, "work_order_count": _distinct("work_order_id"), "required_quantity": _sum("qty_required"), "issued_quantity": _sum("qty_issued"),
         "open_quantity": _sum("open_qty"), "quantity_fulfillment_rate": lambda: ratio(A.sum(S("qty_issued")), A.sum(S("qty_required"))),
         "fully_fulfilled_line_count": _is("status", "FULFILLED"), "partially_issued_line_count": _is("status", "PARTIALLY_ISSUED"),
         "cancelled_material_line_count": _is("status", "CANCELLED"), "estimated_issued_material_cost": _sum("estimated_issued_cost")}),
    MetricView(
        "inventory_metrics", "inventory", "one row per inventory movement", "fact_inventory_movement",
        {"material": _current("material"), "warehouse": _current("warehouse"), "movement_date": _date("movement_date_key")},
        {"movement_date": ("movement_date", "full_date"), "movement_type": ("source", "movement_type"), "movement_direction": ("source", "movement_direction"),
         "reference_type": ("source", "reference_type"), **_MATERIAL, "material_criticality": ("material", "criticality"), **_WAREHOUSE},
        {"movement_count": _rows, "issued_quantity": lambda: A.sum_if(S("movement_type") == "ISSUE", -S("quantity")), "received_quantity": _sum_when("movement_type", "RECEIPT", "quantity"),
         "net_quantity": _sum("quantity"), "absolute_movement_quantity": lambda: A.sum(F.abs(S("quantity"))), "net_movement_value": _sum("movement_value"),
         "absolute_movement_value": lambda: A.sum(F.abs(S("movement_value"))), "adjustment_quantity": _sum_when("movement_type", "CYCLE_COUNT_ADJUSTMENT", "quantity")}),
    MetricView(
        "inventory_position_metrics", "inventory", "one row per material x warehouse snapshot", "fact_stock_position",
        {"material": _current("material"), "warehouse": _current("warehouse"), "snapshot_date": _date("snapshot_date_key")},
        {"snapshot_date": ("snapshot_date", "full_date"), **_MATERIAL, "material_criticality": ("material", "criticality"), **_WAREHOUSE},
        {"stock_position_count": _rows, "on_hand_quantity": _sum("on_hand"), "reserved_quantity": _sum("reserved"), "available_quantity": _sum("available"),
         "inventory_value": _sum("inventory_value"), "below_reorder_position_count": lambda: A.count_if(S("available") <= S("reorder_point")),
         "out_of_stock_position_count": lambda: A.count_if(S("available") <= 0), "average_available_quantity": _avg("available")}),
    MetricView(
        "procurement_metrics", "procurement", "one row per purchase-order item", "fact_purchase_order_item",
        {"supplier": _current("supplier"), "material": _current("material"), "warehouse": _current("warehouse"), "order_date": _date("order_date_key")},
        {"order_date": ("order_date", "full_date"), **_SUPPLIER, **_MATERIAL, **_WAREHOUSE, "po_status": ("source", "status"), "promised_date": lambda: S("promised_at").cast("date")},
        {"purchase_order_count": _distinct("purchase_order_id"), "purchase_order_item_count": _rows, "ordered_value": _sum("ordered_value"), "received_value": _sum("received_value"),
         "open_value": lambda: A.sum(S("ordered_value") - S("received_value")), "ordered_quantity": _sum("ordered_qty"), "received_quantity": _sum("received_qty"), "open_quantity": _sum("open_qty"),
         "fill_rate": lambda: ratio(A.sum(S("received_qty")), A.sum(S("ordered_qty"))), "avg_delivery_variance_hours": _avg("delivery_variance_hours"),
         "late_purchase_order_count": _orders_when(lambda: ~S("received_on_time")), "cancelled_purchase_order_count": _orders_when(lambda: S("status") == "CANCELLED"),
         "otif_purchase_order_count": _orders_when(lambda: S("is_on_time_in_full")), "partial_line_count": lambda: A.count_if(S("is_partial"))}),
    MetricView(
        "receiving_metrics", "procurement", "one row per goods-receipt item", "fact_goods_receipt_item",
        {"supplier": _current("supplier"), "material": _current("material"), "warehouse": _current("warehouse"), "receipt_date": _date("receipt_date_key")},
        {"receipt_date": ("receipt_date", "full_date"), **_SUPPLIER, **_MATERIAL, **_WAREHOUSE},
        {"goods_receipt_count": _distinct("goods_receipt_id"), "receipt_line_count": _rows, "purchase_order_count": _distinct("purchase_order_id"), "received_quantity": _sum("qty_received"),
         "receipt_value": _sum("receipt_value"), "avg_unit_price": _avg("unit_price"), "avg_receipt_value": _avg("receipt_value")}),
    MetricView(
        "invoice_metrics", "fiscal", "one row per fiscal invoice", "fact_fiscal_invoice",
        {"supplier": _current("supplier"), "received_date": _date("received_date_key")},
        {"received_date": ("received_date", "full_date"), **_SUPPLIER, "invoice_status": ("source", "status"), "tax_issue": ("source", "tax_issue"), "was_blocked": ("source", "was_blocked")},
        {"invoice_count": _rows, "invoice_value": _sum("total_amount"), "subtotal_value": _sum("subtotal"), "tax_value": _sum("tax_total"), "posted_invoice_count": _is("status", "POSTED"),
         "released_invoice_count": _is("status", "RELEASED"), "blocked_invoice_count": lambda: A.count_if(S("was_blocked")), "blocked_invoice_rate": lambda: ratio(A.count_if(S("was_blocked")), A.count()),
         "avg_abs_price_variance_pct": lambda: A.avg(F.abs(S("price_variance_pct"))), "tax_issue_count": lambda: A.count_if(S("tax_issue"))}),
    MetricView(
        "fiscal_item_metrics", "fiscal", "one row per fiscal invoice item", "fact_fiscal_invoice_item",
        {"supplier": _current("supplier"), "material": _current("material"), "received_date": _date("received_date_key")},
        {"received_date": ("received_date", "full_date"), **_SUPPLIER, **_MATERIAL, "material_ncm": ("material", "ncm")},
        {"fiscal_item_count": _rows, "invoice_count": _distinct("fiscal_invoice_id"), "invoiced_quantity": _sum("quantity"), "merchandise_value": _sum("merchandise_value"),
         "icms_amount": _sum("icms_amount"), "ipi_amount": _sum("ipi_amount"), "pis_amount": _sum("pis_amount"), "cofins_amount": _sum("cofins_amount"),
         "total_tax_amount": lambda: A.sum(_taxes()), "effective_tax_rate": lambda: ratio(A.sum(_taxes()), A.sum(S("merchandise_value")))}),
    MetricView(
        "payables_metrics", "finance", "one row per accounts-payable title", "fact_accounts_payable",
        {"supplier": _current("supplier"), "posted_date": _date("posted_date_key"), "due_date": _date("due_date_key")},
        {"posted_date": ("posted_date", "full_date"), "due_date": ("due_date", "full_date"), **_SUPPLIER, "ap_status": ("source", "status"), "is_overdue": ("source", "is_overdue")},
        {"payable_count": _rows, "payable_amount": _sum("amount"), "open_amount": lambda: A.sum_if(~S("status").isin("PAID", "VOIDED"), S("amount")),
         "scheduled_amount": _sum_when("status", "SCHEDULED", "amount"), "paid_amount": _sum_when("status", "PAID", "amount"), "voided_amount": _sum_when("status", "VOIDED", "amount"),
         "voided_count": _is("status", "VOIDED"), "overdue_amount": lambda: A.sum_if(S("is_overdue"), S("amount")), "overdue_count": lambda: A.count_if(S("is_overdue")),
         "avg_days_to_pay": _avg("days_to_pay"), "avg_days_past_due": _avg("days_past_due")}),
    MetricView(
        "payment_metrics", "finance", "one row per executed payment", "fact_payment",
        {"supplier": _current("supplier"), "payment_date": _date("payment_date_key")},
        {"payment_date": ("payment_date", "full_date"), "payment_year": ("payment_date", "year"), "payment_month": ("payment_date", "month"), **_SUPPLIER},
        {"payment_count": _rows, "paid_payable_count": _distinct("accounts_payable_id"), "payment_amount": _sum("amount"), "avg_payment_amount": _avg("amount"), "max_payment_amount": lambda: A.max(S("amount"))}),
)}


def registry(spark) -> DataFrame:
    """cube_name, fact_table, domain and grain of every view."""
    return spark.createDataFrame([(v.name, v.fact, v.domain, v.grain) for v in VIEWS.values()], "cube_name string, fact_table string, domain string, grain string")
