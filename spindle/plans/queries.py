"""Registered queries of the operational operators over the star-schema test tables, each with SQL for the same rows.

The test tables have no maintenance or purchasing entities, so others stand in for them: orders for purchase orders,
work orders, invoices and titles, lineitem for their lines and for movements, part for materials, nation for
warehouses, region for cost centers, and events for transition logs and change logs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spindle.operators import changes, dimensions, lineage, measures, process, quality, slices, snapshots
from spindle.operators.measures import amount, date_key, hours, percent
from spindle.sources import tables
from spindle.streaming import mining

from . import cubes, states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals and doubles as doubles of four places, times and dates as text, so that engines can be compared."""

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            return F.round(c.cast("double"), 4).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        return (c.cast("long") if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else c).alias(f.name)

    return df.select(*(plain(f) for f in df.schema))


def query(name: str, sql: str):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(f(lambda t: _table(spark, sf_dir, t)))
        ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a stand-in by its name in the model."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return STAND_INS[name](read) if name in STAND_INS else read(name)


# ------------------------------------------------------------------ stand-ins

def _price() -> Column:
    return F.round(F.col("p_retailprice") * 100).cast("bigint")


def _got() -> Column:
    return F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") / 2).cast("double")).otherwise(0.0)


def _horizon() -> Column:
    return F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")


def _items(read) -> DataFrame:
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = tables.dealt(read("lineitem"), "l_partkey").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = tables.dealt(lines, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(
        F.col("l_orderkey").alias("purchase_order_id"), F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("material_key"), F.col("c_nationkey").alias("warehouse_key"),
        F.when(F.col("o_orderstatus") == "F", "RECEIVED").when(F.col("o_orderstatus") == "O", "SENT").otherwise("PARTIALLY_RECEIVED").alias("status"),
        F.col("l_quantity").alias("ordered_qty"), _got().alias("received_qty"), amount(_price()).alias("unit_price"), F.col("o_orderdate").alias("approved_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("promised_at"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("received_at"), F.col("o_orderdate").alias("sent_at"))
    return rows.withColumns(measures.order_line("ordered_qty", "received_qty", "unit_price") | measures.delivery("promised_at", "received_at", "approved_at", "sent_at")).withColumns(
        measures.order_flags("ordered_qty", "received_qty", "received_on_time") | {"order_date_key": date_key("approved_at")})


def _receipts(read) -> DataFrame:
    rows = read("lineitem").filter("l_linestatus = 'F'").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("goods_receipt_id"), F.col("l_orderkey").alias("purchase_order_id"), F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("material_key"),
        (F.col("l_partkey") % 25).cast("int").alias("warehouse_key"), date_key("l_shipdate").alias("receipt_date_key"), F.col("l_quantity").alias("qty_received"), amount(_price()).alias("unit_price"),
        (F.col("l_quantity") * amount(_price())).cast("decimal(18,2)").alias("receipt_value"))


def _movements(read) -> DataFrame:
    rows = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "RECEIPT").when(F.col("l_returnflag") == "A", "ISSUE").otherwise("CYCLE_COUNT_ADJUSTMENT")
    quantity = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).when(F.col("l_returnflag") == "A", -F.col("l_quantity")).otherwise(0.0)
    return rows.select(
        F.col("l_partkey").alias("material_key"), (F.col("l_partkey") % 25).cast("int").alias("warehouse_key"), date_key("l_shipdate").alias("movement_date_key"), kind.alias("movement_type"),
        F.lit("WORK_ORDER").alias("reference_type"), quantity.alias("quantity"), amount(_price()).alias("unit_cost")).withColumns(measures.movement("quantity", "unit_cost"))


def _stock(read) -> DataFrame:
    rows = read("part").select(
        F.col("p_partkey").alias("material_key"), (F.col("p_partkey") % 25).cast("int").alias("warehouse_key"), F.lit(20010801).alias("snapshot_date_key"), (F.col("p_size") * 10).cast("double").alias("on_hand"),
        (F.col("p_partkey") % 37 * 5).cast("double").alias("reserved"), F.lit(100.0).alias("reorder_point"), amount(_price()).alias("unit_cost"))
    return rows.withColumns(measures.stock("on_hand", "reserved", "unit_cost"))


def _cents() -> Column:
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


def _payables(read) -> DataFrame:
    rows = read("orders").select(
        F.col("o_orderkey").alias("accounts_payable_id"), (F.col("o_orderkey") % 10).alias("supplier_key"), F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("SCHEDULED").alias("status"),
        amount(_cents()).alias("amount"), F.col("o_orderdate").alias("posted_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS 5 HOURS")).alias("paid_at"))
    return rows.withColumns(measures.payable_age("status", "due_at", "posted_at", "paid_at", _horizon()) | {"posted_date_key": date_key("posted_at"), "due_date_key": date_key("due_at")})


def _invoices(read) -> DataFrame:
    return read("orders").select(
        F.col("o_orderkey").alias("fiscal_invoice_id"), (F.col("o_orderkey") % 10).alias("supplier_key"), date_key("o_orderdate").alias("received_date_key"),
        F.when(F.col("o_orderstatus") == "F", "POSTED").when(F.col("o_orderstatus") == "O", "RECEIVED").otherwise("RELEASED").alias("status"), amount(_cents()).alias("subtotal"),
        amount(F.col("o_orderkey") % 1000).alias("tax_total"), amount(_cents() + F.col("o_orderkey") % 1000).alias("total_amount"), percent((F.col("o_orderkey") % 101 - 50).cast("int")).alias("price_variance_pct"),
        (F.col("o_orderpriority").startswith("1")).alias("tax_issue"), (F.col("o_orderstatus") == "P").alias("was_blocked"))


def _invoice_items(read) -> DataFrame:
    rows = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    cents = (F.col("l_quantity").cast("bigint") * _price())
    return rows.select(
        F.col("l_orderkey").alias("fiscal_invoice_id"), F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("material_key"), date_key("l_shipdate").alias("received_date_key"), F.col("l_quantity").alias("quantity"),
        amount(cents).alias("merchandise_value"), *(amount(F.floor(cents * bps / 10000).cast("bigint")).alias(f"{t}_amount") for t, bps in (("icms", 1800), ("ipi", 500), ("pis", 165), ("cofins", 760))))


def _work_orders(read) -> DataFrame:
    at = lambda days, h: F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS {h} HOURS")
    kind = F.col("o_orderstatus")
    rows = read("orders").select(
        F.col("o_orderkey").alias("work_order_id"), (F.col("o_orderkey") % 25).cast("int").alias("warehouse_key"), (F.col("o_orderkey") % 5).cast("int").alias("cost_center_key"),
        F.when(F.col("o_orderpriority").startswith("1"), "CORRECTIVE").otherwise("PREVENTIVE").alias("maintenance_type"), F.substring("o_orderpriority", 3, 20).alias("priority"),
        F.when(kind == "F", "CLOSED").when(kind == "O", "IN_PROGRESS").otherwise("CANCELLED").alias("status"), F.col("o_orderdate").alias("planned_at"), at(1, 2).alias("released_at"), at(2, 5).alias("started_at"),
        F.when(kind == "F", at(4, 1)).alias("completed_at"), F.when(kind == "F", at(5, 0)).alias("closed_at"), F.when(kind == "P", at(3, 3)).alias("cancelled_at"),
        (F.col("o_orderkey") % 3 == 0).cast("int").alias("waited_for_material"), amount(_cents()).alias("estimated_material_cost"), date_key("o_orderdate").alias("planned_date_key"))
    return rows.withColumns(measures.work_order_hours(_horizon()))


def _work_order_lines(read) -> DataFrame:
    rows = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        F.col("l_orderkey").alias("work_order_id"), F.col("l_partkey").alias("material_key"), (F.col("l_partkey") % 25).cast("int").alias("warehouse_key"), (F.col("l_partkey") % 5).cast("int").alias("cost_center_key"),
        date_key("l_shipdate").alias("planned_date_key"), F.when(F.col("l_linestatus") == "F", "FULFILLED").when(F.col("l_returnflag") == "R", "PARTIALLY_ISSUED").otherwise("REQUESTED").alias("status"),
        F.col("l_quantity").alias("qty_required"), _got().alias("qty_issued"), amount(_price()).alias("unit_cost"), F.col("l_returnflag").alias("maintenance_type"))
    return rows.withColumns(measures.fulfilment("qty_required", "qty_issued", "unit_cost"))


def _dates(read) -> DataFrame:
    return dimensions.date_dimension(read("orders").agg(F.min("o_orderdate").alias("first_day"), F.lit("2003-12-31").cast("date").alias("last_day")))


STAND_INS: dict[str, Callable] = {
    "fact_purchase_order_item": _items, "fact_goods_receipt_item": _receipts, "fact_inventory_movement": _movements, "fact_stock_position": _stock, "fact_accounts_payable": _payables,
    "fact_fiscal_invoice": _invoices, "fact_fiscal_invoice_item": _invoice_items, "fact_work_order": _work_orders, "fact_work_order_material": _work_order_lines,
    "fact_payment": lambda read: _payables(read).filter("status = 'PAID'").withColumn("payment_date_key", date_key("paid_at")),
    "dim_supplier": lambda read: read("supplier").select(F.col("s_suppkey").alias("supplier_key"), F.col("s_name").alias("supplier_name")),
    "dim_material": lambda read: read("part").select(F.col("p_partkey").alias("material_key"), F.col("p_name").alias("description"), F.col("p_type").alias("category"), F.col("p_brand").alias("criticality"), F.col("p_brand").alias("ncm")),
    "dim_warehouse": lambda read: read("nation").select(F.col("n_nationkey").alias("warehouse_key"), F.col("n_name").alias("warehouse_name")),
    "dim_cost_center": lambda read: read("region").select(F.col("r_regionkey").alias("cost_center_key"), F.col("r_name").alias("cost_center_name")),
    "dim_date": _dates,
    # a change log of users: each event is a version of its user
    "changes": lambda read: read("events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("points"), F.when(F.col("event_id") % 11 == 0, "update_postimage").otherwise("insert").alias("_change_type"),
        F.col("event_id").alias("_commit_version"), F.col("ts").alias("_commit_timestamp")),
    "transitions": lambda read: read("events").select(
        F.col("event_id").alias("transition_id"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("from_state"),
        F.col("event_type").alias("to_state"), F.lit(None).cast("string").alias("reason"), F.col("ts").alias("occurred_at"), F.col("ts").alias("source_commit_at")),
}

#: The stand-ins in SQL.
PRELUDE = """
WITH po AS (
  SELECT *, LEAST(received_qty / NULLIF(ordered_qty, 0), 1.0) AS fill_ratio, ordered_qty * unit_price AS ordered_value, received_qty * unit_price AS received_value,
         GREATEST(ordered_qty - received_qty, 0.0) AS open_qty, date_sub('second', promised_at, received_at) / 3600.0 AS delivery_variance_hours,
         CASE WHEN received_at IS NOT NULL THEN received_at <= promised_at END AS received_on_time
  FROM (SELECT l_orderkey AS purchase_order_id, l_suppkey AS supplier_key, l_partkey AS material_key, c_nationkey AS warehouse_key,
               CASE o_orderstatus WHEN 'F' THEN 'RECEIVED' WHEN 'O' THEN 'SENT' ELSE 'PARTIALLY_RECEIVED' END AS status, l_quantity AS ordered_qty,
               CASE WHEN l_linestatus = 'F' THEN l_quantity WHEN l_returnflag = 'R' THEN floor(l_quantity / 2) ELSE 0.0 END AS received_qty,
               round(p_retailprice * 100) / 100 AS unit_price, o_orderdate AS approved_at, o_orderdate + INTERVAL 30 DAY AS promised_at,
               CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS received_at, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS order_date_key
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)
), items AS (
  SELECT *, received_qty > 0 AND received_qty < ordered_qty AS is_partial, received_qty >= ordered_qty AND received_on_time AS is_on_time_in_full FROM po
), payables AS (
  SELECT *, status NOT IN ('PAID', 'VOIDED') AND due_at < TIMESTAMP '2001-08-01' AS is_overdue, date_sub('day', posted_at, paid_at) AS days_to_pay,
         CASE WHEN status NOT IN ('PAID', 'VOIDED') AND due_at < TIMESTAMP '2001-08-01' THEN date_diff('day', CAST(due_at AS DATE), DATE '2001-08-01') ELSE 0 END AS days_past_due
  FROM (SELECT o_orderkey AS accounts_payable_id, o_orderkey % 10 AS supplier_key, CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'OPEN' ELSE 'SCHEDULED' END AS status,
               round(o_totalprice * 100) / 100 AS amount, o_orderdate AS posted_at, o_orderdate + INTERVAL 30 DAY AS due_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 20 DAY + INTERVAL 5 HOUR END AS paid_at FROM orders)
), moves AS (
  SELECT *, quantity * unit_cost AS movement_value, CASE WHEN quantity > 0 THEN 'IN' WHEN quantity < 0 THEN 'OUT' ELSE 'ZERO' END AS movement_direction
  FROM (SELECT l_partkey AS material_key, l_partkey % 25 AS warehouse_key, CASE l_returnflag WHEN 'R' THEN 'RECEIPT' WHEN 'A' THEN 'ISSUE' ELSE 'CYCLE_COUNT_ADJUSTMENT' END AS movement_type,
               CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0.0 END AS quantity, round(p_retailprice * 100) / 100 AS unit_cost
        FROM lineitem JOIN part ON l_partkey = p_partkey)
), stock AS (
  SELECT *, on_hand - reserved AS available, on_hand * unit_cost AS inventory_value
  FROM (SELECT p_partkey AS material_key, p_partkey % 25 AS warehouse_key, p_size * 10.0 AS on_hand, p_partkey % 37 * 5.0 AS reserved, 100.0 AS reorder_point, round(p_retailprice * 100) / 100 AS unit_cost FROM part)
), wo AS (
  SELECT *, date_sub('second', planned_at, released_at) / 3600.0 AS planning_hours, date_sub('second', released_at, started_at) / 3600.0 AS material_wait_hours,
         date_sub('second', started_at, completed_at) / 3600.0 AS execution_hours, date_sub('second', completed_at, closed_at) / 3600.0 AS closure_hours,
         date_sub('second', planned_at, COALESCE(closed_at, cancelled_at, TIMESTAMP '2001-08-01')) / 3600.0 AS elapsed_cycle_hours
  FROM (SELECT o_orderkey AS work_order_id, o_orderkey % 25 AS warehouse_key, o_orderkey % 5 AS cost_center_key, CASE WHEN o_orderpriority LIKE '1%' THEN 'CORRECTIVE' ELSE 'PREVENTIVE' END AS maintenance_type,
               substring(o_orderpriority, 3, 20) AS priority, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'CANCELLED' END AS status, o_orderdate AS planned_at,
               o_orderdate + INTERVAL 26 HOUR AS released_at, o_orderdate + INTERVAL 53 HOUR AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 97 HOUR END AS completed_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 120 HOUR END AS closed_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 75 HOUR END AS cancelled_at,
               CAST(o_orderkey % 3 = 0 AS INT) AS waited_for_material, round(o_totalprice * 100) / 100 AS estimated_material_cost FROM orders)
), wol AS (
  SELECT *, GREATEST(qty_required - qty_issued, 0.0) AS open_qty, CASE WHEN qty_required = 0 THEN 1.0 ELSE LEAST(qty_issued / NULLIF(qty_required, 0), 1.0) END AS fulfillment_ratio, qty_issued * unit_cost AS estimated_issued_cost
  FROM (SELECT l_orderkey AS work_order_id, l_partkey AS material_key, l_quantity AS qty_required, CASE WHEN l_linestatus = 'F' THEN 'FULFILLED' WHEN l_returnflag = 'R' THEN 'PARTIALLY_ISSUED' ELSE 'REQUESTED' END AS status,
               CASE WHEN l_linestatus = 'F' THEN l_quantity WHEN l_returnflag = 'R' THEN floor(l_quantity / 2) ELSE 0.0 END AS qty_issued, round(p_retailprice * 100) / 100 AS unit_cost
        FROM lineitem JOIN part ON l_partkey = p_partkey)
), log AS (
  SELECT user_id AS id, event_type AS kind, CAST(floor(value) AS BIGINT) AS points, CASE WHEN event_id % 11 = 0 THEN 'update_postimage' ELSE 'insert' END AS change, event_id AS version, ts FROM events
), ev AS (
  SELECT event_id AS transition_id, 'user:' || user_id AS case_id, CAST(user_id AS VARCHAR) AS entity_id, lag(event_type) OVER c AS from_state, event_type AS activity, ts AS occurred_at,
         lag(ts) OVER c AS previous_event_at, row_number() OVER c AS event_index, date_sub('second', lag(ts) OVER c, ts) AS seconds_since_previous
  FROM events WINDOW c AS (PARTITION BY user_id ORDER BY ts, event_id)
)
"""
_T = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
_R = lambda e, name: f"round(CAST({e} AS DOUBLE), 4) AS {name}"

# ------------------------------------------------------------------ changes


@query("cents_bps_normalisation", "SELECT o_orderkey, " + _R("round(o_totalprice * 100) / 100", "amount") + ", " + _R("(o_orderkey % 10000) / 100.0", "pct") + " FROM orders")
def _(t):
    return t("orders").select("o_orderkey", amount(_cents()).alias("amount"), percent((F.col("o_orderkey") % 10000).cast("int")).alias("pct"))


@query("latest_state_per_key", PRELUDE + "SELECT id, kind, points, version AS _commit_version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, version DESC) AS rn FROM log) WHERE rn = 1")
def _(t):
    return changes.latest_per_key(t("changes"), ["id"], ["_commit_timestamp", "_commit_version"]).select("id", "kind", "points", "_commit_version")


@query("record_hash", "SELECT event_id, sha256(concat_ws('||', CAST(event_id AS VARCHAR), event_type, COALESCE(CAST(CASE WHEN user_id % 5 > 0 THEN user_id END AS VARCHAR), '∅'))) AS hash FROM events")
def _(t):
    rows = t("events").select("event_id", "event_type", F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("user_id"), F.lit(1).alias("_private"))
    return rows.select("event_id", changes.record_hash(rows.columns).alias("hash"))


@query("publicize_snapshot", "SELECT n_nationkey, n_name, 'snapshot' AS _source_change_type, 7 AS _source_commit_version, 'nation' AS _source_table, sha256(concat_ws('||', n_name, CAST(n_nationkey AS VARCHAR))) AS _source_record_hash FROM nation")
def _(t):
    rows = changes.publicize(t("nation"), "nation", "run", ("n_regionkey",), "snapshot", 7)
    return rows.select("n_nationkey", "n_name", "_source_change_type", "_source_commit_version", "_source_table", "_source_record_hash")


#: Some version in the middle of the log, and the newest; in the tables all commits of the second half of the month come after it.
_MIDDLE, _NEWEST = "(SELECT max(event_id) // 2 FROM events)", "(SELECT max(event_id) FROM events)"


def _newest(t) -> int:
    return t("changes").agg(F.max("_commit_version")).first()[0]


@query("cdc_incremental_window", PRELUDE + f"SELECT id, kind, points, version AS _commit_version FROM log WHERE version > {_MIDDLE} AND version <= {_NEWEST}")
def _(t):
    end = _newest(t)
    return changes.increment(t("changes"), end // 2, end).select("id", "kind", "points", "_commit_version")


@query("cdc_stability_cutoff", "SELECT max(event_id) AS version FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 5 MINUTE")
def _(t):
    end = changes.stable_end(changes.history(t("changes")), changes.cutoff(datetime(2024, 1, 15, 12)))
    return t("region").limit(1).select(F.lit(end).cast("long").alias("version"))


@query("cdc_horizon", "SELECT strftime(max(m), '%Y-%m-%d %H:%M:%S') AS horizon FROM (SELECT max(o_orderdate) AS m FROM orders UNION ALL SELECT max(l_shipdate) FROM lineitem)")
def _(t):
    return t("region").limit(1).select(F.lit(changes.horizon((t("orders"), "o_orderdate"), (t("lineitem"), "l_shipdate"))).cast("timestamp_ntz").alias("horizon"))


@query("commit_history", PRELUDE + "SELECT version, " + "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS timestamp, count(*) AS row_count FROM log GROUP BY version")
def _(t):
    return changes.history(t("changes"))


@query("snapshot_as_of", PRELUDE + "SELECT id, arg_max(kind, version) AS kind, arg_max(points, version) AS points FROM log WHERE version <= " + _MIDDLE + " GROUP BY id")
def _(t):
    return changes.snapshot(t("changes"), ["id"], _newest(t) // 2)


@query("baseline_states", PRELUDE + "SELECT id, arg_max(kind, version) AS kind, arg_max(points, version) AS points, max(version) AS tick FROM log WHERE version <= " + _NEWEST + " GROUP BY id")
def _(t):
    return changes.baseline(t("changes").withColumn("tick", F.col("_commit_version")), ["id"], "state", _newest(t), "tick")


_OLD, _NEW = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 < 2", "SELECT c_custkey, 'new ' || c_name AS c_name, c_nationkey + 100 AS c_nationkey FROM customer WHERE c_custkey % 3 > 0"


def _old_new(t):
    c = t("customer").select("c_custkey", "c_name", "c_nationkey")
    return c.filter("c_custkey % 3 < 2"), c.filter("c_custkey % 3 > 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_nationkey") + 100).alias("c_nationkey"))


@query("merge_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def _(t):
    return changes.upsert(*_old_new(t), ["c_custkey"])


@query("merge_insert_only", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def _(t):
    return changes.insert_only(*_old_new(t), ["c_custkey"])


@query("merge_preserve_keys", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.c_custkey, n.c_name, COALESCE(o.c_nationkey, n.c_nationkey) AS c_nationkey FROM n LEFT JOIN o USING (c_custkey) UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def _(t):
    return changes.upsert_preserving(*_old_new(t), ["c_custkey"], ["c_nationkey"])


@query("merge_changed_rows", f"WITH o AS ({_OLD}), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END AS c_name, c_nationkey FROM customer) SELECT n.* FROM n LEFT JOIN o USING (c_custkey) WHERE o.c_name IS DISTINCT FROM n.c_name")
def _(t):
    c = t("customer").select("c_custkey", "c_name", "c_nationkey")
    return changes.changed_rows(_old_new(t)[0], c.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("new")), ["c_custkey"])


# ------------------------------------------------------------------ dimensions

_RUNS = PRELUDE + ", v AS (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY version) AS before FROM log), runs AS (SELECT id, kind, version, ts AS effective_from, lead(ts) OVER (PARTITION BY id ORDER BY version) AS effective_to, lead(version) OVER (PARTITION BY id ORDER BY version) IS NULL AS is_current FROM v WHERE before IS DISTINCT FROM kind)"


def _scd2(t):
    return dimensions.scd2(t("changes").withColumnsRenamed({"_commit_version": "version", "_commit_timestamp": "ts"}), "id", ["kind"], "version", "ts")


@query("scd2_intervals", _RUNS + f" SELECT id, kind, version, {_T('effective_from')}, {_T('effective_to')}, is_current FROM runs")
def _(t):
    return _scd2(t).select("id", "kind", "version", "effective_from", "effective_to", "is_current")


@query("scd2_versions", _RUNS + " SELECT id, count(*) AS versions, count(DISTINCT kind) AS kinds FROM runs GROUP BY id")
def _(t):
    return _scd2(t).groupBy("id").agg(F.count_distinct("dimension_key").alias("versions"), F.count_distinct("attr_hash").alias("kinds"))


@query("scd2_current", _RUNS + " SELECT id, kind, version FROM runs WHERE is_current")
def _(t):
    return _scd2(t).filter("is_current").select("id", "kind", "version")


@query("scd2_grow", _RUNS + f" SELECT id, kind, version, {_T('effective_from')}, {_T('effective_to')}, is_current FROM runs")
def _(t):
    half = dimensions.scd2(t("changes").filter(F.col("_commit_version") <= _newest(t) // 2).withColumnsRenamed({"_commit_version": "version", "_commit_timestamp": "ts"}), "id", ["kind"], "version", "ts")
    return dimensions.grow_scd2(half, _scd2(t), "id", "version").select("id", "kind", "version", "effective_from", "effective_to", "is_current")


@query("scd2_as_of_join", PRELUDE + ", v AS (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY ts) AS before FROM log), runs AS (SELECT id, kind, ts AS effective_from, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS effective_to FROM v WHERE before IS DISTINCT FROM kind) SELECT e.event_id, r.kind FROM events e LEFT JOIN runs r ON e.user_id = r.id AND r.effective_from <= e.ts - INTERVAL 1 DAY AND (r.effective_to IS NULL OR e.ts - INTERVAL 1 DAY < r.effective_to)")
def _(t):
    facts = t("events").select("event_id", F.col("user_id").alias("id"), (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("at"))
    by_time = dimensions.scd2(t("changes").select("id", "kind", F.col("_commit_timestamp").alias("ts"), F.col("_commit_timestamp").alias("since")), "id", ["kind"], "ts", "since")
    return dimensions.as_of(facts, by_time, "id", "at", "kind").select("event_id", "kind")


@query("dim_date_spine", "SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, CAST(CAST(d AS DATE) AS VARCHAR) AS full_date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, monthname(d) AS month_name, weekofyear(d) AS week_of_year, day(d) AS day_of_month, dayofweek(d) + 1 AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend FROM (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), DATE '2003-12-31', INTERVAL 1 DAY)) AS d)")
def _(t):
    return t("dim_date")


@query("type1_dim_nation", "SELECT n_nationkey, n_name, true AS stable, CAST(1 AS BIGINT) AS keys FROM nation")
def _(t):
    a, b = (dimensions.type1(t("nation"), "n_nationkey", "nation_key") for _ in range(2))
    both = changes.upsert(a, b, ["nation_key"]).groupBy("n_nationkey", "n_name").agg(F.count_distinct("nation_key").alias("keys"))
    return both.select("n_nationkey", "n_name", (F.col("keys") == 1).alias("stable"), "keys")


@query("star_join_current_keys", _RUNS + " SELECT count(*) AS facts, count(r.version) AS bound FROM events e LEFT JOIN runs r ON e.user_id = r.id AND r.is_current")
def _(t):
    bound = dimensions.with_key(t("events").withColumnRenamed("user_id", "id"), _scd2(t), "id", "dimension_key")
    return bound.agg(F.count(F.lit(1)).alias("facts"), F.count("dimension_key").alias("bound"))


@query("fact_frozen_keys", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.c_custkey, n.c_name, COALESCE(o.c_nationkey, n.c_nationkey) AS c_nationkey FROM n LEFT JOIN o USING (c_custkey) UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def _(t):
    old, new = _old_new(t)
    return dimensions.frozen_fact(dimensions.frozen_fact(None, old, ["c_custkey"], ["c_nationkey"]), new, ["c_custkey"], ["c_nationkey"])


# ------------------------------------------------------------------ measures


@query("po_line_kpis", PRELUDE + "SELECT supplier_key, " + ", ".join(_R(f"sum({c})", c) for c in ("ordered_value", "received_value", "open_qty", "fill_ratio")) + " FROM po GROUP BY supplier_key")
def _(t):
    return t("fact_purchase_order_item").groupBy("supplier_key").agg(*(F.sum(c).alias(c) for c in ("ordered_value", "received_value", "open_qty", "fill_ratio")))


@query("po_delivery_kpis", PRELUDE + "SELECT supplier_key, " + _R("sum(delivery_variance_hours)", "late_hours") + ", count(*) FILTER (received_on_time) AS on_time, count(*) FILTER (received_on_time IS NULL) AS open FROM po GROUP BY supplier_key")
def _(t):
    ok = F.col("received_on_time")
    return t("fact_purchase_order_item").groupBy("supplier_key").agg(F.sum("delivery_variance_hours").alias("late_hours"), F.count(F.when(ok, 1)).alias("on_time"), F.count(F.when(ok.isNull(), 1)).alias("open"))


@query("po_flags_otif", PRELUDE + "SELECT is_partial, is_on_time_in_full, count(*) AS n FROM items GROUP BY ALL")
def _(t):
    return t("fact_purchase_order_item").groupBy("is_partial", "is_on_time_in_full").agg(F.count(F.lit(1)).alias("n"))


@query("order_lifecycle_hours", PRELUDE + "SELECT work_order_id, " + ", ".join(_R(c, c) for c in ("planning_hours", "material_wait_hours", "execution_hours", "closure_hours", "elapsed_cycle_hours")) + " FROM wo")
def _(t):
    return t("fact_work_order").select("work_order_id", "planning_hours", "material_wait_hours", "execution_hours", "closure_hours", "elapsed_cycle_hours")


@query("material_fulfilment", PRELUDE + "SELECT material_key, " + ", ".join(_R(f"sum({c})", c) for c in ("open_qty", "fulfillment_ratio", "estimated_issued_cost")) + " FROM wol GROUP BY material_key")
def _(t):
    return t("fact_work_order_material").groupBy("material_key").agg(*(F.sum(c).alias(c) for c in ("open_qty", "fulfillment_ratio", "estimated_issued_cost")))


@query("lifecycle_rollup", PRELUDE + ", l AS (SELECT work_order_id, count(*) AS n, count(*) FILTER (status = 'FULFILLED') AS f, sum(estimated_issued_cost) AS c FROM wol GROUP BY 1) SELECT o_orderkey AS work_order_id, COALESCE(n, 0) AS material_line_count, COALESCE(f, 0) AS fulfilled_material_line_count, " + _R("COALESCE(c, 0)", "estimated_material_cost") + ", CASE WHEN COALESCE(w, 0) > 0 THEN 1 ELSE 0 END AS waited_for_material FROM orders LEFT JOIN l ON o_orderkey = work_order_id LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'error') AS w FROM events GROUP BY 1) ON user_id = o_orderkey")
def _(t):
    history = t("events").select(F.col("user_id").alias("work_order_id"), F.when(F.col("event_type") == "error", "WAITING_MATERIAL").otherwise("OTHER").alias("to_state"))
    lines = t("fact_work_order_material").withColumn("line_status", F.col("status"))
    return measures.lifecycle_rollup(t("orders").select(F.col("o_orderkey").alias("work_order_id")), lines, history, "work_order_id")


@query("terminal_timestamps", "SELECT user_id, strftime(max(ts) FILTER (event_type = 'error'), '%Y-%m-%d %H:%M:%S') AS failed_at, strftime(max(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS bought_at FROM events GROUP BY user_id")
def _(t):
    return measures.terminal_times(t("events").select("user_id", F.col("event_type").alias("to_state"), F.col("ts").alias("occurred_at")), "user_id", {"error": "failed_at", "purchase": "bought_at"})


@query("ever_flag", "SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS had_error FROM events GROUP BY user_id")
def _(t):
    return measures.ever(t("events"), "user_id", F.col("event_type") == "error", "had_error")


@query("ap_overdue_aging", PRELUDE + "SELECT accounts_payable_id, is_overdue, days_past_due FROM payables")
def _(t):
    return t("fact_accounts_payable").select("accounts_payable_id", "is_overdue", "days_past_due")


@query("days_to_pay", PRELUDE + "SELECT accounts_payable_id, days_to_pay FROM payables")
def _(t):
    return t("fact_accounts_payable").select("accounts_payable_id", "days_to_pay")


@query("open_payables", PRELUDE + "SELECT accounts_payable_id, date_diff('day', CAST(due_at AS DATE), DATE '2001-08-01') AS days_past_due FROM payables WHERE status NOT IN ('PAID', 'VOIDED')")
def _(t):
    return measures.open_payables(t("fact_accounts_payable"), _horizon()).select("accounts_payable_id", "days_past_due")


@query("movement_direction_value", PRELUDE + "SELECT movement_direction, count(*) AS n, " + _R("sum(movement_value)", "value") + " FROM moves GROUP BY 1")
def _(t):
    return t("fact_inventory_movement").groupBy("movement_direction").agg(F.count(F.lit(1)).alias("n"), F.sum("movement_value").alias("value"))


@query("stock_position", PRELUDE + "SELECT material_key, " + _R("available", "available") + ", " + _R("inventory_value", "inventory_value") + " FROM stock")
def _(t):
    return t("fact_stock_position").select("material_key", "available", "inventory_value")


@query("on_order_position", PRELUDE + "SELECT material_key, " + _R("COALESCE(q, 0)", "on_order") + " FROM stock LEFT JOIN (SELECT material_key, sum(open_qty) AS q FROM po WHERE status IN ('SENT', 'PARTIALLY_RECEIVED') GROUP BY 1) USING (material_key)")
def _(t):
    return measures.on_order(t("fact_stock_position").select("material_key"), t("fact_purchase_order_item"), ["material_key"])


# ------------------------------------------------------------------ metric views


def _cube(name: str, view: str, fields: list[str], chosen: list[str], sql: str, where: str | None = None):
    QUERIES[name] = lambda spark, sf_dir: _plain(cubes.VIEWS[view].query(lambda t: _table(spark, sf_dir, t), fields, chosen, where))
    ORACLE_SQL[name] = PRELUDE + sql


def _measures(pairs: dict[str, str]) -> tuple[list[str], str]:
    """Names of measures, and their SQL: counts stay whole, the rest is rounded."""
    return list(pairs), ", ".join(f"{e} AS {n}" if e.startswith(("count", "CAST")) else _R(e, n) for n, e in pairs.items())


_m, _sql = _measures({
    "purchase_order_count": "count(DISTINCT purchase_order_id)", "purchase_order_item_count": "count(*)", "ordered_value": "sum(ordered_value)", "received_value": "sum(received_value)",
    "open_value": "sum(ordered_value - received_value)", "ordered_quantity": "sum(ordered_qty)", "received_quantity": "sum(received_qty)", "open_quantity": "sum(open_qty)",
    "fill_rate": "sum(received_qty) / nullif(sum(ordered_qty), 0)", "avg_delivery_variance_hours": "avg(delivery_variance_hours)",
    "late_purchase_order_count": "count(DISTINCT CASE WHEN NOT received_on_time THEN purchase_order_id END)", "cancelled_purchase_order_count": "count(DISTINCT CASE WHEN status = 'CANCELLED' THEN purchase_order_id END)",
    "otif_purchase_order_count": "count(DISTINCT CASE WHEN is_on_time_in_full THEN purchase_order_id END)", "partial_line_count": "CAST(sum(CASE WHEN is_partial THEN 1 ELSE 0 END) AS BIGINT)"})
_cube("cube_procurement_by_supplier", "procurement_metrics", ["supplier"], _m, f"SELECT s_name AS supplier, {_sql} FROM items LEFT JOIN supplier ON s_suppkey = supplier_key GROUP BY s_name")
_cube("cube_procurement_by_day_and_category", "procurement_metrics", ["promised_date", "material_category"], ["purchase_order_item_count", "fill_rate"],
      "SELECT CAST(CAST(promised_at AS DATE) AS VARCHAR) AS promised_date, p_type AS material_category, count(*) AS purchase_order_item_count, " + _R("sum(received_qty) / nullif(sum(ordered_qty), 0)", "fill_rate") + " FROM items LEFT JOIN part ON p_partkey = material_key GROUP BY ALL")
_cube("cube_procurement_open_by_warehouse", "procurement_metrics", ["warehouse"], ["open_quantity"], "SELECT n_name AS warehouse, " + _R("sum(open_qty)", "open_quantity") + " FROM items LEFT JOIN nation ON n_nationkey = warehouse_key WHERE status = 'SENT' GROUP BY 1", "po_status = 'SENT'")

_m, _sql = _measures({
    "goods_receipt_count": "count(DISTINCT l_orderkey * 10 + l_linenumber % 2)", "receipt_line_count": "count(*)", "purchase_order_count": "count(DISTINCT l_orderkey)", "received_quantity": "sum(l_quantity)",
    "receipt_value": "sum(l_quantity * round(p_retailprice * 100) / 100)", "avg_unit_price": "avg(round(p_retailprice * 100) / 100)", "avg_receipt_value": "avg(l_quantity * round(p_retailprice * 100) / 100)"})
_cube("cube_receiving_by_warehouse", "receiving_metrics", ["warehouse"], _m, f"SELECT n_name AS warehouse, {_sql} FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN nation ON n_nationkey = l_partkey % 25 WHERE l_linestatus = 'F' GROUP BY 1")

_m, _sql = _measures({
    "movement_count": "count(*)", "issued_quantity": "sum(CASE WHEN movement_type = 'ISSUE' THEN -quantity ELSE 0 END)", "received_quantity": "sum(CASE WHEN movement_type = 'RECEIPT' THEN quantity ELSE 0 END)", "net_quantity": "sum(quantity)",
    "absolute_movement_quantity": "sum(abs(quantity))", "net_movement_value": "sum(movement_value)", "absolute_movement_value": "sum(abs(movement_value))", "adjustment_quantity": "sum(CASE WHEN movement_type = 'CYCLE_COUNT_ADJUSTMENT' THEN quantity ELSE 0 END)"})
_cube("cube_inventory_by_category", "inventory_metrics", ["material_category", "movement_direction"], _m, f"SELECT p_type AS material_category, movement_direction, {_sql} FROM moves LEFT JOIN part ON p_partkey = material_key GROUP BY ALL")

_m, _sql = _measures({
    "stock_position_count": "count(*)", "on_hand_quantity": "sum(on_hand)", "reserved_quantity": "sum(reserved)", "available_quantity": "sum(available)", "inventory_value": "sum(inventory_value)",
    "below_reorder_position_count": "CAST(sum(CASE WHEN available <= reorder_point THEN 1 ELSE 0 END) AS BIGINT)", "out_of_stock_position_count": "CAST(sum(CASE WHEN available <= 0 THEN 1 ELSE 0 END) AS BIGINT)", "average_available_quantity": "avg(available)"})
_cube("cube_stock_by_warehouse", "inventory_position_metrics", ["warehouse"], _m, f"SELECT n_name AS warehouse, {_sql} FROM stock LEFT JOIN nation ON n_nationkey = warehouse_key GROUP BY 1")

_m, _sql = _measures({
    "payable_count": "count(*)", "payable_amount": "sum(amount)", "open_amount": "sum(CASE WHEN status NOT IN ('PAID', 'VOIDED') THEN amount ELSE 0 END)", "scheduled_amount": "sum(CASE WHEN status = 'SCHEDULED' THEN amount ELSE 0 END)",
    "paid_amount": "sum(CASE WHEN status = 'PAID' THEN amount ELSE 0 END)", "voided_amount": "sum(CASE WHEN status = 'VOIDED' THEN amount ELSE 0 END)", "voided_count": "CAST(sum(CASE WHEN status = 'VOIDED' THEN 1 ELSE 0 END) AS BIGINT)",
    "overdue_amount": "sum(CASE WHEN is_overdue THEN amount ELSE 0 END)", "overdue_count": "CAST(sum(CASE WHEN is_overdue THEN 1 ELSE 0 END) AS BIGINT)", "avg_days_to_pay": "avg(days_to_pay)", "avg_days_past_due": "avg(days_past_due)"})
_cube("cube_payables_by_status", "payables_metrics", ["ap_status", "is_overdue"], _m, f"SELECT status AS ap_status, is_overdue, {_sql} FROM payables GROUP BY ALL")
_cube("cube_payables_by_due_date", "payables_metrics", ["due_date"], ["payable_count", "overdue_amount"], "SELECT CAST(CAST(due_at AS DATE) AS VARCHAR) AS due_date, count(*) AS payable_count, " + _R("sum(CASE WHEN is_overdue THEN amount ELSE 0 END)", "overdue_amount") + " FROM payables GROUP BY 1")

_m, _sql = _measures({
    "invoice_count": "count(*)", "invoice_value": "sum((round(o_totalprice * 100) + o_orderkey % 1000) / 100)", "subtotal_value": "sum(round(o_totalprice * 100) / 100)", "tax_value": "sum(o_orderkey % 1000 / 100.0)",
    "posted_invoice_count": "CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT)", "released_invoice_count": "CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT)",
    "blocked_invoice_count": "CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT)", "blocked_invoice_rate": "sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) / nullif(count(*), 0)",
    "avg_abs_price_variance_pct": "avg(abs(o_orderkey % 101 - 50) / 100.0)", "tax_issue_count": "CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT)"})
_cube("cube_invoice_by_supplier", "invoice_metrics", ["supplier", "tax_issue"], _m, f"SELECT s_name AS supplier, o_orderpriority LIKE '1%' AS tax_issue, {_sql} FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 10 GROUP BY ALL")

_tax = lambda bps: f"floor(l_quantity * round(p_retailprice * 100) * {bps} / 10000) / 100"
_m, _sql = _measures({
    "fiscal_item_count": "count(*)", "invoice_count": "count(DISTINCT l_orderkey)", "invoiced_quantity": "sum(l_quantity)", "merchandise_value": "sum(l_quantity * round(p_retailprice * 100) / 100)",
    "icms_amount": f"sum({_tax(1800)})", "ipi_amount": f"sum({_tax(500)})", "pis_amount": f"sum({_tax(165)})", "cofins_amount": f"sum({_tax(760)})", "total_tax_amount": "sum(" + " + ".join(map(_tax, (1800, 500, 165, 760))) + ")",
    "effective_tax_rate": "sum(" + " + ".join(map(_tax, (1800, 500, 165, 760))) + ") / nullif(sum(l_quantity * round(p_retailprice * 100) / 100), 0)"})
_cube("cube_fiscal_items_by_category", "fiscal_item_metrics", ["material_category"], _m, f"SELECT p_type AS material_category, {_sql} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")

_m, _sql = _measures({"payment_count": "count(*)", "paid_payable_count": "count(DISTINCT accounts_payable_id)", "payment_amount": "sum(amount)", "avg_payment_amount": "avg(amount)", "max_payment_amount": "max(amount)"})
_cube("cube_payment_by_month", "payment_metrics", ["payment_year", "payment_month"], _m, f"SELECT year(paid_at) AS payment_year, month(paid_at) AS payment_month, {_sql} FROM payables WHERE status = 'PAID' GROUP BY ALL")

_m, _sql = _measures({
    "work_order_count": "count(*)", "completed_work_order_count": "CAST(sum(CASE WHEN status IN ('COMPLETED', 'CLOSED') THEN 1 ELSE 0 END) AS BIGINT)", "closed_work_order_count": "CAST(sum(CASE WHEN status = 'CLOSED' THEN 1 ELSE 0 END) AS BIGINT)",
    "corrective_work_order_count": "CAST(sum(CASE WHEN maintenance_type = 'CORRECTIVE' THEN 1 ELSE 0 END) AS BIGINT)", "cancelled_work_order_count": "CAST(sum(CASE WHEN status = 'CANCELLED' THEN 1 ELSE 0 END) AS BIGINT)",
    "waiting_material_work_order_count": "CAST(sum(waited_for_material) AS BIGINT)", "estimated_material_cost": "sum(estimated_material_cost)", "avg_planning_hours": "avg(planning_hours)", "avg_material_wait_hours": "avg(material_wait_hours)",
    "avg_execution_hours": "avg(execution_hours)", "avg_cycle_hours": "avg(elapsed_cycle_hours)", "material_wait_ratio": "sum(material_wait_hours) / nullif(sum(elapsed_cycle_hours), 0)"})
_cube("cube_maintenance_by_priority", "maintenance_metrics", ["priority", "cost_center"], _m, f"SELECT priority, r_name AS cost_center, {_sql} FROM wo LEFT JOIN region ON r_regionkey = cost_center_key GROUP BY ALL")
_cube("cube_maintenance_total", "maintenance_metrics", [], ["work_order_count", "avg_cycle_hours"], "SELECT count(*) AS work_order_count, " + _R("avg(elapsed_cycle_hours)", "avg_cycle_hours") + " FROM wo")

_m, _sql = _measures({
    "material_requirement_line_count": "count(*)", "work_order_count": "count(DISTINCT work_order_id)", "required_quantity": "sum(qty_required)", "issued_quantity": "sum(qty_issued)", "open_quantity": "sum(open_qty)",
    "quantity_fulfillment_rate": "sum(qty_issued) / nullif(sum(qty_required), 0)", "fully_fulfilled_line_count": "CAST(sum(CASE WHEN status = 'FULFILLED' THEN 1 ELSE 0 END) AS BIGINT)",
    "partially_issued_line_count": "CAST(sum(CASE WHEN status = 'PARTIALLY_ISSUED' THEN 1 ELSE 0 END) AS BIGINT)", "cancelled_material_line_count": "CAST(sum(CASE WHEN status = 'CANCELLED' THEN 1 ELSE 0 END) AS BIGINT)", "estimated_issued_material_cost": "sum(estimated_issued_cost)"})
_cube("cube_material_lines_by_category", "maintenance_material_metrics", ["material_category", "material_status"], _m, f"SELECT p_type AS material_category, status AS material_status, {_sql} FROM wol LEFT JOIN part ON p_partkey = material_key GROUP BY ALL")

# ------------------------------------------------------------------ process and quality


@query("process_event_log", PRELUDE + "SELECT transition_id, case_id, from_state, activity, event_index, seconds_since_previous FROM ev")
def _(t):
    return process.event_log(t("transitions")).select("transition_id", "case_id", "from_state", "activity", "event_index", "seconds_since_previous")


@query("process_case_summary", PRELUDE + "SELECT case_id, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS case_started_at, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS case_last_event_at, count(*) AS event_count, max(event_index) AS transition_count, arg_max(activity, event_index) AS current_state, date_sub('second', min(occurred_at), max(occurred_at)) AS case_duration_seconds FROM ev GROUP BY case_id")
def _(t):
    return process.case_summary(process.event_log(t("transitions"))).drop("entity_type", "entity_id")


@query("process_transition_summary", PRELUDE + "SELECT from_state, activity AS to_state, count(*) AS transition_count, " + _R("avg(seconds_since_previous)", "avg_seconds_from_previous") + ", quantile_disc(seconds_since_previous, 0.5) AS median_seconds_from_previous FROM ev GROUP BY ALL")
def _(t):
    return process.transition_summary(process.event_log(t("transitions")), 1_000_000).drop("entity_type")


@query("expectation_results", "SELECT 'lineitem' AS dataset, unnest(['discount_below_five_percent', 'shipped_after_1996']) AS expectation, 'fail' AS action, count(*) AS total_rows, unnest([count(*) FILTER (l_discount >= 0.05), count(*) FILTER (l_shipdate <= TIMESTAMP '1996-01-01')]) AS failed_rows, round(unnest([1 - count(*) FILTER (l_discount >= 0.05) / count(*), 1 - count(*) FILTER (l_shipdate <= TIMESTAMP '1996-01-01') / count(*)]), 4) AS pass_rate FROM lineitem")
def _(t):
    rules = [quality.Rule("discount_below_five_percent", F.col("l_discount") < 0.05), quality.Rule("shipped_after_1996", F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp_ntz"))]
    return quality.expectations(t("lineitem"), "lineitem", rules)


@query("quality_checks", "SELECT 'orphan_items' AS check_name, count(*) AS actual FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT 'duplicate_lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'not_single_current', 0")
def _(t):
    orders = t("orders").filter("o_orderstatus <> 'P'")
    return quality.checks({
        "orphan_items": quality.orphans(t("lineitem"), orders, "l_orderkey", "o_orderkey"), "duplicate_lines": quality.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"]), "not_single_current": quality.not_single_current(_scd2(t), "id")})


_DAYS = "SELECT event_type AS check_name, CAST(ts AS DATE) AS run, count(*) FILTER (event_id % 7 = 0) AS actual FROM events GROUP BY ALL"


@query("reconciliation_hysteresis", f"WITH d AS ({_DAYS}), g AS (SELECT *, sum(CASE WHEN actual > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY check_name ORDER BY run) AS k FROM d) SELECT check_name, CAST(run AS VARCHAR) AS run, actual, CAST(sum(CASE WHEN actual > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY check_name, k ORDER BY run) AS BIGINT) AS consecutive_failures FROM g")
def _(t):
    daily = t("events").groupBy(F.col("event_type").alias("check_name"), F.col("ts").cast("date").alias("run")).agg(F.count(F.when(F.col("event_id") % 7 == 0, 1)).alias("actual"))
    return quality.streaks(daily)


@query("asset_observation", "SELECT 'source' AS layer, 'orders' AS asset_name, count(*) AS row_count, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS latest_at, round(date_sub('second', max(o_orderdate), TIMESTAMP '2001-08-05 12:00:00') / 60.0, 4) AS freshness_minutes FROM orders UNION ALL SELECT 'source', 'nation', count(*), NULL, NULL FROM nation")
def _(t):
    return quality.observe({n: t(n) for n in ("orders", "nation")}, {"orders": "o_orderdate"}, F.lit("2001-08-05 12:00:00").cast("timestamp"), "source")


@query("reconciliation_gate", f"WITH d AS ({_DAYS}), g AS (SELECT *, sum(CASE WHEN actual > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY check_name ORDER BY run) AS k FROM d), c AS (SELECT *, sum(CASE WHEN actual > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY check_name, k ORDER BY run) AS n, row_number() OVER (PARTITION BY check_name ORDER BY run DESC) AS back FROM g) SELECT check_name, CAST(CASE WHEN n >= 3 THEN actual ELSE 0 END AS BIGINT) AS actual FROM c WHERE back = 1")
def _(t):
    daily = t("events").groupBy(F.col("event_type").alias("check_name"), F.col("ts").cast("date").alias("run")).agg(F.count(F.when(F.col("event_id") % 7 == 0, 1)).alias("actual"))
    # the state before each check's last run, and that run
    seen = quality.streaks(daily).withColumn("back", F.row_number().over(W.partitionBy("check_name").orderBy(F.desc("run"))))
    none = F.lit(None).cast("timestamp")
    before = seen.filter("back = 2").select("check_name", none.alias("first_failed_at"), none.alias("last_failed_at"), F.col("consecutive_failures").cast("int").alias("consecutive_failures"), F.col("actual").alias("last_actual"), none.alias("updated_at"))
    return quality.gate_values(quality.reconcile(before, seen.filter("back = 1").select("check_name", "actual"), F.lit("2024-02-01").cast("timestamp")))


@query("expectation_gate", "SELECT 'lineitem' AS dataset, 'discount_below_five_percent' AS expectation, count(*) FILTER (l_discount >= 0.05) AS failed_rows FROM lineitem HAVING count(*) FILTER (l_discount >= 0.05) > 0")
def _(t):
    rules = [quality.Rule("discount_below_five_percent", F.col("l_discount") < 0.05), quality.Rule("quantity_is_positive", F.col("l_quantity") > 0)]
    first = quality.expectations(t("lineitem").limit(0), "lineitem", rules).withColumn("observed_at", F.lit(1))
    return quality.failing_rules(first.unionByName(quality.expectations(t("lineitem"), "lineitem", rules).withColumn("observed_at", F.lit(2)))).select("dataset", "expectation", "failed_rows")


#: The registry as published. Fixed values.
_REGISTRY = """
SELECT * FROM (VALUES
  ('maintenance_metrics', 'fact_work_order', 'maintenance', 'one row per work order'),
  ('maintenance_material_metrics', 'fact_work_order_material', 'maintenance', 'one row per work-order material requirement'),
  ('inventory_metrics', 'fact_inventory_movement', 'inventory', 'one row per inventory movement'),
  ('inventory_position_metrics', 'fact_stock_position', 'inventory', 'one row per material x warehouse snapshot'),
  ('procurement_metrics', 'fact_purchase_order_item', 'procurement', 'one row per purchase-order item'),
  ('receiving_metrics', 'fact_goods_receipt_item', 'procurement', 'one row per goods-receipt item'),
  ('invoice_metrics', 'fact_fiscal_invoice', 'fiscal', 'one row per fiscal invoice'),
  ('fiscal_item_metrics', 'fact_fiscal_invoice_item', 'fiscal', 'one row per fiscal invoice item'),
  ('payables_metrics', 'fact_accounts_payable', 'finance', 'one row per accounts-payable title'),
  ('payment_metrics', 'fact_payment', 'finance', 'one row per executed payment')
) AS t(cube_name, fact_table, domain, grain)"""
#: Rows of each fact's stand-in.
_FACT_ROWS = PRELUDE + """, facts AS (
  SELECT 'fact_work_order' AS fact_table, count(*) AS row_count FROM wo UNION ALL SELECT 'fact_work_order_material', count(*) FROM wol UNION ALL SELECT 'fact_inventory_movement', count(*) FROM moves
  UNION ALL SELECT 'fact_stock_position', count(*) FROM stock UNION ALL SELECT 'fact_purchase_order_item', count(*) FROM items UNION ALL SELECT 'fact_goods_receipt_item', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'
  UNION ALL SELECT 'fact_fiscal_invoice', count(*) FROM orders UNION ALL SELECT 'fact_fiscal_invoice_item', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'fact_accounts_payable', count(*) FROM payables UNION ALL SELECT 'fact_payment', count(*) FROM payables WHERE status = 'PAID')
"""


def _catalog(spark: SparkSession, sf_dir: str, facts: dict[str, str]) -> SparkSession:
    """A session whose catalog has views of these names on stand-ins."""
    session = spark.newSession()
    for name, stand_in in facts.items():
        _table(session, sf_dir, stand_in).createOrReplaceTempView(name)
    return session


def _coverage(spark: SparkSession, sf_dir: str, facts: dict[str, str]) -> DataFrame:
    session = _catalog(spark, sf_dir, facts)
    return quality.catalog_coverage(session, cubes.registry(session))


_ALL_FACTS = {v.fact: v.fact for v in cubes.VIEWS.values()}
QUERIES["semantic_registry"] = lambda spark, sf_dir: _plain((lambda found: cubes.registry(found.sparkSession).join(found.select("fact_table", "row_count"), "fact_table"))(_coverage(spark, sf_dir, _ALL_FACTS)))
ORACLE_SQL["semantic_registry"] = _FACT_ROWS + f"SELECT r.*, row_count FROM ({_REGISTRY}) AS r JOIN facts USING (fact_table)"
QUERIES["semantic_coverage"] = lambda spark, sf_dir: _plain(_coverage(spark, sf_dir, _ALL_FACTS))
ORACLE_SQL["semantic_coverage"] = _FACT_ROWS + "SELECT fact_table, 1 AS cube_count, row_count FROM facts"
_FACTS = {"fact_payment": "fact_payment", "fact_work_order": "fact_work_order", "fact_unknown": "events"}
QUERIES["semantic_fact_gaps"] = lambda spark, sf_dir: _plain(_coverage(spark, sf_dir, _FACTS).filter("cube_count <> 1 OR row_count IS NULL"))
ORACLE_SQL["semantic_fact_gaps"] = _FACT_ROWS + "SELECT fact_table, 1 AS cube_count, CAST(NULL AS BIGINT) AS row_count FROM facts WHERE fact_table NOT IN ('fact_payment', 'fact_work_order') UNION ALL SELECT 'fact_unknown', 0, count(*) FROM events"

# ------------------------------------------------------------------ tables that grow


@query("sink_incremental_merge", PRELUDE + f"SELECT version AS event_id, id, kind, points + CASE WHEN version > {_MIDDLE} // 2 THEN 1000 ELSE 0 END AS points FROM log")
def _(t):
    end = _newest(t)
    rows = t("changes").select(F.col("_commit_version").alias("event_id"), "id", "kind", "points")
    root, part = tables.scratch(rows.sparkSession), F.floor(F.col("event_id") / (end // 16 + 1))
    later = rows.filter(F.col("event_id") > end // 2 // 2).withColumn("points", F.col("points") + 1000)
    # the second step holds rows of the first again, with other values, and is run twice
    for step in (rows.filter(F.col("event_id") <= end // 2), later, later):
        tables.merge_into(step, root, "raw", lambda old, new: changes.upsert(old, new, ["event_id"]), ["event_id"], part)
    return tables.current(rows.sparkSession, root, "raw")


@query("snapshot_from_bases", "WITH l AS (SELECT user_id AS id, event_type AS kind, CAST(floor(value) AS BIGINT) AS points, event_id // ((SELECT max(event_id) FROM events) // 16 + 1) + 1 AS v, event_id, event_id % 13 = 0 AS gone FROM events), s AS (SELECT id, arg_max(kind, event_id) AS kind, arg_max(points, event_id) AS points, arg_max(gone, event_id) AS gone FROM l WHERE v <= 12 GROUP BY id) SELECT id, kind, points FROM s WHERE NOT gone")
def _(t):
    events, end = t("events"), _newest(t)
    rows = events.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("points"), F.when(F.col("event_id") % 13 == 0, "delete").otherwise("insert").alias("_change_type"),
        (F.floor(F.col("event_id") / (end // 16 + 1)) + 1).cast("long").alias("_commit_version"), F.timestamp_seconds("event_id").alias("_commit_timestamp"))
    spark, root = events.sparkSession, tables.scratch(events.sparkSession)
    snapshots.write_log(rows, f"{root}/log")
    log = spark.read.parquet(f"{root}/log")
    snapshots.add_bases(spark, log, ["id"], root, "changes", 5, 16)
    return snapshots.snapshot(spark, log, ["id"], root, "changes", 12)


@query("scd2_advance", _RUNS + f" SELECT id, kind, version, {_T('effective_from')}, {_T('effective_to')}, is_current FROM runs")
def _(t):
    every = t("changes").select("id", "kind", F.col("_commit_version").alias("version"), F.col("_commit_timestamp").alias("ts"))
    first = (F.col("version") <= _newest(t) // 2) & (F.col("version") % 97 != 5)
    root, part = tables.scratch(every.sparkSession), F.pmod(F.xxhash64("id"), F.lit(16))
    known = tables.replace(dimensions.scd2(every.filter(first), "id", ["kind"], "version", "ts", seen=True), root, "dim", part)
    # some versions of the first half come late
    grown = dimensions.advance_scd2(known, every.filter(~first), every, "id", ["kind"], "version", "ts")
    return tables.merge_into(grown, root, "dim", lambda old, new: changes.upsert(old, new, ["id"]), ["id"], part, True).select("id", "kind", "version", "effective_from", "effective_to", "is_current")


@query("expectations_of_write", ORACLE_SQL["expectation_results"])
def _(t):
    rules = [quality.Rule("discount_below_five_percent", F.col("l_discount") < 0.05), quality.Rule("shipped_after_1996", F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp_ntz"))]
    watch, lines = quality.Watch("lineitem", rules), t("lineitem")
    tables.replace(watch(lines), tables.scratch(lines.sparkSession), "lineitem")
    return watch.results(lines.sparkSession)


@query("process_event_log_in_slices", "SELECT event_id AS transition_id, 'type:' || event_type AS case_id, lag(ts) OVER c IS NULL AS first, row_number() OVER c AS event_index, date_sub('second', lag(ts) OVER c, ts) AS seconds_since_previous FROM events WINDOW c AS (PARTITION BY event_type ORDER BY ts, event_id)")
def _(t):
    none = F.lit(None).cast("string")
    rows = t("events").select(
        F.col("event_id").alias("transition_id"), F.lit("type").alias("entity_type"), F.col("event_type").alias("entity_id"), none.alias("from_state"), none.alias("to_state"), none.alias("reason"), F.col("ts").alias("occurred_at"), F.col("ts").alias("source_commit_at"))
    # a case of a fifth of all events, in slices of about 500
    return process.event_log(rows, 500).select("transition_id", "case_id", F.col("previous_event_at").isNull().alias("first"), "event_index", "seconds_since_previous")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = spark.newSession()
    session.conf.set(*mining.STORE)
    # as a pattern, the path may be a file or a folder
    stream = session.readStream.schema(session.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select(
        F.col("event_id").cast("string").alias("transition_id"), F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("from_state"), F.col("event_type").alias("to_state"),
        F.lit(None).cast("string").alias("reason"), F.col("ts").cast("timestamp").alias("occurred_at"), F.timestamp_seconds("event_id").alias("source_commit_at"))
    root = tables.scratch(session)
    mining.mine_stream(rows, root, "process_event", f"{root}/checkpoint").awaitTermination()
    seen = tables.current(spark, root, "process_event")
    return _plain(seen.select(F.col("transition_id").cast("long").alias("transition_id"), "case_id", "activity", "event_index", "seconds_since_previous"))


QUERIES["process_event_log_streamed"] = _streamed
ORACLE_SQL["process_event_log_streamed"] = PRELUDE + "SELECT transition_id, case_id, activity, event_index, seconds_since_previous FROM ev"


@query("joined_bucketed_facts", "SELECT o_orderkey, count(*) AS lines, round(CAST(sum(l_quantity) AS DOUBLE), 4) AS quantity, any_value(o_orderstatus) AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t):
    name = f"spindle_{uuid.uuid4().hex}"
    orders = tables.save_bucketed(t("orders").select("o_orderkey", "o_orderstatus"), f"{name}_orders", ["o_orderkey"], 16)
    lines = tables.save_bucketed(t("lineitem").select("l_orderkey", "l_quantity"), f"{name}_lines", ["l_orderkey"], 16)
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.min("o_orderstatus").alias("status"))


_STATED = {
    "purchase_order_count": "count(DISTINCT purchase_order_id)", "late_purchase_order_count": "count(DISTINCT CASE WHEN NOT received_on_time THEN purchase_order_id END)", "purchase_order_item_count": "count(*)",
    "ordered_value": "sum(ordered_value)", "fill_rate": "sum(received_qty) / nullif(sum(ordered_qty), 0)", "avg_delivery_variance_hours": "avg(delivery_variance_hours)"}
_m, _sql = _measures(_STATED)


def _cube_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, root = states.ViewStates(cubes.VIEWS["procurement_metrics"], "order_date", ("supplier", "po_status"), tuple(_STATED), 256), tables.scratch(spark)
    kept.update(lambda t: _table(spark, sf_dir, t), root)
    return _plain(kept.query(spark, root, ["supplier"], where="po_status <> 'SENT'"))


QUERIES["cube_from_states"] = _cube_from_states
ORACLE_SQL["cube_from_states"] = PRELUDE + f"SELECT s_name AS supplier, {_sql} FROM items LEFT JOIN supplier ON s_suppkey = supplier_key WHERE status <> 'SENT' GROUP BY s_name"

# ------------------------------------------------------------------ across domains


def _waits(t) -> DataFrame:
    """Lines wait for their material from an order's release to its start, a day longer for every line."""
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_partkey").alias("material_key"), F.expr("o_orderdate + INTERVAL 26 HOURS").alias("started_at"), F.expr("o_orderdate + make_dt_interval(l_linenumber, 53)").alias("ended_at"))


def _most(t) -> int | None:
    """Limit of windows over materials: a line is a wait and a stock-out, or an open order and a wait, with two ends each."""
    return slices.limit(t("lineitem"), "l_partkey", 4)


def _stockouts(t, most: int | None) -> DataFrame:
    """Times in which what was received of a material, less what was issued, was nothing."""
    quantity = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).when(F.col("l_returnflag") == "A", -F.col("l_quantity")).otherwise(0.0)
    lines = t("lineitem").select(F.col("l_partkey").alias("material_key"), F.col("l_shipdate").alias("at"), quantity.alias("quantity"))
    # where no material has many lines, they move once: sums and windows stay in the tasks of their materials
    moves = (lines.repartition(tables.tasks(lines), "material_key") if most is None else lines).groupBy("material_key", "at").agg(F.sum("quantity").alias("moved"))
    balance = slices.walk(moves, "material_key", ["at"], sums={"moved": "balance"}, most=most)
    return lineage.condition_spans(balance, ["material_key"], "at", F.col("balance") <= 0, _horizon(), most=most)


_WAITS = """
WITH w AS (SELECT row_number() OVER () AS n, l_partkey AS material_key, o_orderdate + INTERVAL 26 HOUR AS s, o_orderdate + INTERVAL 53 HOUR + l_linenumber * INTERVAL 1 DAY AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_OUTS = """, m AS (SELECT l_partkey, l_shipdate AS moved_at, sum(CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0 END) AS q FROM lineitem GROUP BY ALL),
b AS (SELECT *, sum(q) OVER (PARTITION BY l_partkey ORDER BY moved_at) AS balance, lead(moved_at) OVER (PARTITION BY l_partkey ORDER BY moved_at) AS nxt FROM m),
o AS (SELECT l_partkey, moved_at AS s, COALESCE(nxt, TIMESTAMP '2001-08-01') AS e FROM b WHERE balance <= 0),
met AS (SELECT n, sum(epoch(least(w.e, o.e)) - epoch(greatest(w.s, o.s))) AS seconds FROM w JOIN o ON material_key = l_partkey AND o.s < w.e AND w.s < o.e AND o.s < o.e GROUP BY n)"""


@query("lineage_stockout_waits", _WAITS + _OUTS + " SELECT material_key, count(*) AS wait_count, " + ", ".join([_R("sum(epoch(e) - epoch(s)) / 3600", "wait_hours"), _R("sum(COALESCE(seconds, 0)) / 3600", "stockout_hours"), _R("sum(COALESCE(seconds, 0)) / sum(epoch(e) - epoch(s))", "stockout_share")]) + " FROM w LEFT JOIN met USING (n) GROUP BY material_key")
def _(t):
    most = _most(t)
    return lineage.stockout_waits(_waits(t), _stockouts(t, most), ["material_key"], ["material_key"], most)


@query("lineage_supplier_waits", _WAITS + ", p AS (SELECT row_number() OVER () AS k, l_suppkey AS supplier_key, l_partkey, o_orderdate AS s, l_shipdate AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey), met AS (SELECT k, sum(epoch(least(w.e, p.e)) - epoch(greatest(w.s, p.s))) AS seconds FROM p JOIN w ON material_key = l_partkey AND p.s < w.e AND w.s < p.e AND p.s < p.e GROUP BY k) SELECT supplier_key, count(*) AS line_count, count(*) FILTER (seconds > 0) AS waited_line_count, " + _R("sum(COALESCE(seconds, 0)) / 3600", "waited_hours") + " FROM p LEFT JOIN met USING (k) GROUP BY supplier_key")
def _(t):
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("supplier_key"), F.col("l_partkey").alias("material_key"), F.col("o_orderdate").alias("started_at"), F.col("l_shipdate").alias("ended_at"))
    return lineage.supplier_waits(lines, _waits(t), ["supplier_key"], ["material_key"], _most(t))


@query("lineage_delivery_and_completion", PRELUDE + ", b AS (SELECT purchase_order_id, count(*) FILTER (NOT received_on_time) AS late, count(*) FILTER (received_on_time IS NULL) AS open, max(delivery_variance_hours) AS worst FROM po WHERE purchase_order_id % 2 = 0 GROUP BY 1) SELECT CASE WHEN late > 0 THEN 'late' WHEN open > 0 THEN 'open' WHEN late = 0 THEN 'on_time' ELSE 'not_bought' END AS delivery, count(*) AS work_order_count, " + ", ".join([_R("avg(elapsed_cycle_hours)", "avg_cycle_hours"), _R("avg(material_wait_hours)", "avg_material_wait_hours"), _R("avg(worst)", "avg_worst_variance_hours")]) + " FROM wo LEFT JOIN b ON purchase_order_id = work_order_id GROUP BY 1")
def _(t):
    orders = t("fact_purchase_order_item").withColumnRenamed("purchase_order_id", "requisition_id")
    asked = t("orders").select(F.col("o_orderkey").alias("requisition_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("work_order_id"))
    return lineage.delivery_and_completion(t("fact_work_order"), asked, orders)
