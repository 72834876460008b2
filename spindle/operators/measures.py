"""Columns and small plans that turn source rows into business measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack for sums of doubles that should be equal.
TOLERANCE = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def amount(cents: Column | str) -> Column:
    """Cents as decimal(18,2)."""
    return (_col(cents).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def percent(bps: Column | str) -> Column:
    """Basis points as percent, decimal(9,4)."""
    return (_col(bps).cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(9,4)")


def seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end."""
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def hours(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, in hours to six places."""
    return (seconds(start, end) / F.lit(3600).cast("decimal(4,0)")).cast("decimal(27,6)")


def full_days(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("DAY", _col(start), _col(end))


def date_key(day: Column | str) -> Column:
    """A day as the integer yyyymmdd."""
    day = _col(day).cast("date")
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0."""
    return top / F.nullif(bottom, F.lit(0))


def count_if(condition: Column) -> Column:
    """How many rows of a group meet a condition: null of an empty group, 0 if none does."""
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, _col(value)).otherwise(0))


# ------------------------------------------------------------------ maintenance


def work_order_hours(horizon: Column) -> dict[str, Column]:
    """The phases of a work order; an open one has elapsed up to the horizon, a closed or else cancelled one to its end."""
    return {
        "planning_hours": hours("planned_at", "released_at"),
        "material_wait_hours": hours("released_at", "started_at"),
        "execution_hours": hours("started_at", "completed_at"),
        "closure_hours": hours("completed_at", "closed_at"),
        "elapsed_cycle_hours": hours("planned_at", F.coalesce("closed_at", "cancelled_at", horizon)),
    }


def fulfilment(required: str, issued: str, unit_cost: str) -> dict[str, Column]:
    """Open quantity, share issued (1 if nothing was asked for) and cost of a requirement line."""
    need, got = F.col(required), F.col(issued)
    return {
        "open_qty": F.greatest(need - got, F.lit(0.0)),
        "fulfillment_ratio": F.when(need == 0, 1.0).otherwise(F.least(got / F.nullif(need, F.lit(0)), F.lit(1.0))),
        "estimated_issued_cost": (got * F.col(unit_cost)).cast("decimal(18,2)"),
    }


def lifecycle_rollup(orders: DataFrame, lines: DataFrame, transitions: DataFrame, key: str) -> DataFrame:
    """orders with their lines' counts and cost, and whether they ever waited for material; orders without lines have zeros."""
    by_line = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("material_line_count"), count_if(F.col("line_status") == "FULFILLED").alias("fulfilled_material_line_count"), F.sum("estimated_issued_cost").alias("estimated_material_cost"))
    waited = ever(transitions, key, F.col("to_state") == "WAITING_MATERIAL", "waited_for_material")
    out = orders.join(by_line, key, "left").join(waited, key, "left")
    return out.fillna(0, ["material_line_count", "fulfilled_material_line_count", "waited_for_material"]).withColumn("estimated_material_cost", F.coalesce("estimated_material_cost", F.lit(0).cast("decimal(18,2)")))


def terminal_times(transitions: DataFrame, key: str, states: dict[str, str]) -> DataFrame:
    """The last time that each entity entered each state. states: column name by state."""
    return transitions.groupBy(key).agg(*(F.max(F.when(F.col("to_state") == s, F.col("occurred_at"))).alias(name) for s, name in states.items()))


def ever(transitions: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    """Whether an entity ever had a transition that meets the condition, as 1 or 0."""
    return transitions.groupBy(key).agg(F.max(F.when(condition, 1).otherwise(0)).alias(name))


# ------------------------------------------------------------------ procurement


def delivery(promised: str, received: str, approved: str, sent: str) -> dict[str, Column]:
    """Hours late (negative: early), whether on time (null before receipt), and hours from approval to dispatch."""
    return {
        "delivery_variance_hours": hours(promised, received),
        "received_on_time": F.when(F.col(received).isNotNull(), F.col(received) <= F.col(promised)),
        "dispatch_lead_hours": hours(approved, sent),
    }


def order_line(ordered: str, received: str, unit_price: str) -> dict[str, Column]:
    got, want, price = F.col(received), F.col(ordered), F.col(unit_price)
    return {
        "ordered_value": (want * price).cast("decimal(18,2)"),
        "received_value": (got * price).cast("decimal(18,2)"),
        "open_qty": F.greatest(want - got, F.lit(0.0)),
        "fill_ratio": F.least(got / F.nullif(want, F.lit(0)), F.lit(1.0)),
    }


def order_flags(ordered: str, received: str, on_time: str) -> dict[str, Column]:
    got, want = F.col(received), F.col(ordered)
    return {"is_partial": (got > 0) & (got < want), "is_on_time_in_full": (got >= want) & F.col(on_time)}


# ------------------------------------------------------------------ finance and stock


def payable_age(status: str, due: str, posted: str, paid: str, horizon: Column) -> dict[str, Column]:
    """Days to pay, and whether and by how many calendar days a title that is neither paid nor voided is past due."""
    late = ~F.col(status).isin("PAID", "VOIDED") & (F.col(due) < horizon)
    return {
        "days_to_pay": full_days(posted, paid),
        "is_overdue": late,
        "days_past_due": F.when(late, F.datediff(horizon.cast("date"), F.col(due).cast("date"))).otherwise(0),
    }


def movement(quantity: str, unit_cost: str) -> dict[str, Column]:
    q = F.col(quantity)
    return {
        "movement_direction": F.when(q > 0, "IN").when(q < 0, "OUT").otherwise("ZERO"),
        "movement_value": (q * F.col(unit_cost)).cast("decimal(18,2)"),
    }


def stock(on_hand: str, reserved: str, unit_cost: str) -> dict[str, Column]:
    return {"available": F.col(on_hand) - F.col(reserved), "inventory_value": (F.col(on_hand) * F.col(unit_cost)).cast("decimal(18,2)")}


def on_order(stock_rows: DataFrame, order_lines: DataFrame, keys: list[str], active: tuple[str, ...] = ("APPROVED", "SENT", "PARTIALLY_RECEIVED")) -> DataFrame:
    """Stock rows with what is still to come of purchase orders in an active state; 0 where there is none."""
    coming = order_lines.filter(F.col("status").isin(*active)).groupBy(*keys).agg(F.sum(F.greatest(F.col("ordered_qty") - F.col("received_qty"), F.lit(0.0))).alias("on_order"))
    return stock_rows.join(coming, keys, "left").withColumn("on_order", F.coalesce("on_order", F.lit(0.0)))


def open_payables(payables: DataFrame, now: Column) -> DataFrame:
    """Titles neither paid nor voided, with the calendar days they are past due (negative: still to run)."""
    return payables.filter(~F.col("status").isin("PAID", "VOIDED")).withColumn("days_past_due", F.datediff(now.cast("date"), F.col("due_at").cast("date")))
