"""Questions across domains: what maintenance waited for, and who was to deliver it.

Waits, stock-outs and open orders are spans of time that share a material. How much of a span others overlap comes
from one running integral a key: how many of the others are open, summed over time. A span takes the integral at its
end less that at its start, so no span meets another, however many overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import tables
from . import dimensions, slices
from .measures import ratio


def state_spans(transitions: DataFrame, key: str, state: str, horizon: Column) -> DataFrame:
    """key, started_at and ended_at (the horizon while it lasts) of each stay of an entity in a state.

    Needs to_state, occurred_at and transition_id. Moves without entity or time are left out.
    """
    moves = transitions.filter(F.col(key).isNotNull() & F.col("occurred_at").isNotNull()).select(key, "to_state", "occurred_at", "transition_id")
    walked = slices.walk(moves, key, ["occurred_at", "transition_id"], lead={"occurred_at": "_left"})
    return walked.filter(F.col("to_state") == state).select(key, F.col("occurred_at").alias("started_at"), F.coalesce("_left", horizon.cast("timestamp")).alias("ended_at"))


def condition_spans(versions: DataFrame, keys: list[str], since: str, condition: Column, horizon: Column, tie: list[str] = (), most: int | None = slices.MOST) -> DataFrame:
    """keys, started_at and ended_at of the times in which the newest version of a key met a condition; one row a version. tie: order of versions of one time; most: as of ``slices.walk``."""
    keyed = versions.filter(F.col(since).isNotNull()).select(*keys, F.col(since).alias("_since"), *(F.col(c).alias(f"_tie_{k}") for k, c in enumerate(tie)), F.coalesce(condition, F.lit(False)).alias("_met"))
    walked = slices.walk(keyed, keys, ["_since", *(f"_tie_{k}" for k in range(len(tie)))], lead={"_since": "_next"}, most=most)
    return walked.filter("_met").select(*keys, F.col("_since").alias("started_at"), F.coalesce("_next", horizon.cast("timestamp")).alias("ended_at"))


def _seconds(at: str) -> Column:
    """A time in seconds, with its fraction."""
    return F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)


def _both(spans: DataFrame, others: DataFrame, keys: list[str], start: str, end: str, wanted: list[str]) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Spans and others below each other, the columns of their keys, and where the ``wanted`` columns of spans are."""
    none = F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    by = [*(f"_key_{n}" for n in range(len(keys))), "_alone"]
    # a span without key is a key of its own, so that such spans are many groups
    plain = lambda alone, other: [*(F.col(k).alias(c) for k, c in zip(keys, by)), alone.alias("_alone"), F.lit(other).alias("_other"), F.col(start).cast("timestamp").alias("_from"), F.col(end).cast("timestamp").alias("_to")]
    # what keys and times say already is not moved twice
    types, theirs = dict(spans.dtypes), dict(others.dtypes)
    told = {k: c for k, c in zip(keys, by) if types[k] == theirs[k]} | {c: to for c, to in ((start, "_from"), (end, "_to")) if types[c] == "timestamp"}
    column = {c: told.get(c, f"_kept_{n}") for n, c in enumerate(wanted)}
    mine = spans.select(*plain(F.when(none, F.xxhash64(*spans.columns)), False), *(F.col(c).alias(to) for c, to in column.items() if c not in told))
    theirs = others.filter((F.col(start) < F.col(end)) & ~none).select(*plain(F.lit(None).cast("long"), True))
    return mine.unionByName(theirs, allowMissingColumns=True), by, column


def _crowded(both: DataFrame, by: list[str], most: int | None) -> bool:
    """Whether a key has more marks, two a row, than one group may have."""
    return most is not None and slices.cuts(both, by, "_from", most // 2) is not None


def _totals(both: DataFrame, by: list[str]) -> DataFrame:
    """Two rows a span, _sign 1 at its start and -1 at its end, with _total: the seconds that others of its key were open until then."""
    mark = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign"))
    # one exchange by key, before rows become two; all that follows stays in its tasks
    marks = both.repartition(tables.tasks(both), *by).withColumn("_mark", F.explode(F.array(mark("_from", 1), mark("_to", -1)))).withColumns({"_at": F.col("_mark.at"), "_sign": F.col("_mark.sign"), "_step": F.when(F.col("_other"), F.col("_mark.sign")).otherwise(0)}).drop("_mark", "_other")
    # how many are open, and their starts less the ends of those that no longer are: sums of whole numbers, in one pass
    second, micro = F.call_function("div", F.unix_micros("_at"), F.lit(1_000_000)), F.unix_micros("_at") % 1_000_000
    over = W.partitionBy(*by).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    summed = marks.withColumns({"_open": F.sum("_step").over(over), "_seconds": F.sum(F.col("_step") * second).over(over), "_micros": F.sum(F.col("_step") * micro).over(over)}).filter("_step = 0")
    until = lambda part, started: F.coalesce(F.col("_open") * part - F.col(started), F.lit(0))
    return summed.withColumn("_total", until(second, "_seconds").cast("double") + until(micro, "_micros") / F.lit(1e6))


def overlap_seconds(spans: DataFrame, others: DataFrame, keys: list[str], name: str, start: str = "started_at", end: str = "ended_at", most: int | None = slices.MOST) -> DataFrame:
    """spans with the seconds that spans of ``others`` of the same keys overlap each, all of them added up.

    A span without others, or with a null key, is overlapped by none: 0. A span without start or end has null; one that
    ends before it starts, here or in others, is empty. Two spans that overlap for an hour with three others each count
    three hours each. A key of more than ``most`` starts and ends is worked on in slices; both are counted for that, which
    makes them once more. ``most`` None: any key is one group, and nothing is counted.
    """
    both, by, column = _both(spans, others, keys, start, end, spans.columns)
    if _crowded(both, by, most):
        return _overlap_in_slices(spans, others, keys, name, start, end)
    found = _totals(both, by).groupBy(*by, "_from", "_to", *sorted({*column.values()} - {*by, "_from", "_to"})).agg(
        (F.max(F.when(F.col("_sign") == -1, F.col("_total"))) - F.max(F.when(F.col("_sign") == 1, F.col("_total")))).alias("_met"), F.count(F.when(F.col("_sign") == 1, 1)).cast("int").alias("_n"))
    # equal spans have been one
    out = found.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_n"))))
    overlap = F.when(F.col("_from") < F.col("_to"), F.col("_met")).when(F.col("_from").isNotNull() & F.col("_to").isNotNull(), 0.0)
    return out.select(*(F.col(column[c]).alias(c) for c in spans.columns), overlap.alias(name))


def _overlap_in_slices(spans: DataFrame, others: DataFrame, keys: list[str], name: str, start: str, end: str) -> DataFrame:
    """``overlap_seconds`` where a key has more rows than one group may have: marks in slices, and spans bound to them by day."""
    key = F.when(~F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False)), F.struct(*keys))
    steps = others.filter(F.col(start) < F.col(end)).select(key.alias("_key"), F.explode(F.array(F.struct(F.col(start).cast("timestamp").alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).cast("timestamp").alias("at"), F.lit(-1).alias("step")))).alias("s"))
    steps = steps.filter("_key IS NOT NULL").groupBy("_key", F.col("s.at").alias("_at")).agg(F.sum("s.step").alias("_step"))
    opened = slices.walk(steps, "_key", ["_at"], lag={"_at": "_before"}, sums={"_step": "_open"})
    gained = opened.withColumn("_gain", (F.col("_open") - F.col("_step")) * (_seconds("_at") - F.coalesce(_seconds("_before"), _seconds("_at"))))
    marks = slices.walk(gained, "_key", ["_at"], sums={"_gain": "_total"}).select(
        "_key", F.col("_at").alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"), F.struct(_seconds("_at").alias("at"), "_open", "_total").alias("_mark"))
    out = spans.withColumn("_key", key)
    for at in (start, end):
        out = dimensions.as_of(out, marks, "_key", at, "_mark")
        mark = lambda c: F.col(f"_mark.{c}")
        out = out.withColumn(f"_upto_{at}", F.coalesce(mark("_total") + mark("_open") * (_seconds(at) - mark("at")), F.lit(0.0))).drop("_mark")
    overlap = F.when(F.col(start) < F.col(end), F.col(f"_upto_{end}") - F.col(f"_upto_{start}")).when(F.col(start).isNotNull() & F.col(end).isNotNull(), 0.0)
    return out.withColumn(name, overlap).select(*spans.columns, name)


# ------------------------------------------------------------------ questions


def stockout_waits(waits: DataFrame, stockouts: DataFrame, by: list[str], keys: list[str], most: int | None = slices.MOST) -> DataFrame:
    """By any columns of waits: how many there are, their hours, the hours that fell into stock-outs of their keys, and the share. most: as of ``overlap_seconds``.

    Totals at ends less totals at starts are added up by the columns at once, so no wait is put together from its two ends.
    """
    length = lambda start, end: F.greatest(_seconds(end) - _seconds(start), F.lit(0.0))
    both, key, column = _both(waits, stockouts, keys, "started_at", "ended_at", by)
    if _crowded(both, key, most):
        met = _overlap_in_slices(waits, stockouts, keys, "stockout_seconds", "started_at", "ended_at")
        found = met.groupBy(*by).agg(F.count(F.lit(1)).alias("wait_count"), F.sum(length("started_at", "ended_at")).alias("_length"), F.sum("stockout_seconds").alias("_met"))
    else:
        first = F.col("_sign") == 1
        met = F.when(F.col("_from") < F.col("_to"), -F.col("_sign") * F.col("_total")).when(F.col("_from").isNotNull() & F.col("_to").isNotNull(), 0.0)
        found = _totals(both, key).groupBy(*(F.col(column[c]).alias(c) for c in by)).agg(F.count(F.when(first, 1)).alias("wait_count"), F.sum(F.when(first, length("_from", "_to"))).alias("_length"), F.sum(met).alias("_met"))
    return found.select(*by, "wait_count", (F.col("_length") / 3600).alias("wait_hours"), (F.col("_met") / 3600).alias("stockout_hours")).withColumn("stockout_share", ratio(F.col("stockout_hours"), F.col("wait_hours")))


def supplier_waits(orders: DataFrame, waits: DataFrame, by: list[str], keys: list[str], most: int | None = slices.MOST) -> DataFrame:
    """By columns of purchase order lines (a supplier): lines, how many had waits for their keys while they were open, and the hours of such waits.

    orders: keys, started_at (ordered) and ended_at (received or horizon). A wait that two open lines could end counts for both.
    most: as of ``overlap_seconds``.
    """
    met = overlap_seconds(orders, waits, keys, "waited_seconds", most=most)
    return met.groupBy(*by).agg(F.count(F.lit(1)).alias("line_count"), F.count(F.when(F.col("waited_seconds") > 0, 1)).alias("waited_line_count"), (F.sum("waited_seconds") / 3600).alias("waited_hours"))


def delivery_and_completion(work: DataFrame, requisitions: DataFrame, orders: DataFrame, on_time: str = "received_on_time") -> DataFrame:
    """How long work orders take by whether what was bought for them came on time: late (any order late), on time, open or not bought.

    work: work_order_id, elapsed_cycle_hours, material_wait_hours. requisitions: requisition_id, work_order_id. orders:
    requisition_id, delivery_variance_hours and whether received on time (null while open).
    """
    bought = requisitions.filter("work_order_id IS NOT NULL").join(orders, "requisition_id").groupBy("work_order_id").agg(
        F.count(F.lit(1)).alias("orders"), F.count(F.when(~F.col(on_time), 1)).alias("late"), F.count(F.when(F.col(on_time).isNull(), 1)).alias("open"), F.max("delivery_variance_hours").alias("worst_variance"))
    delivery = F.when(F.col("late") > 0, "late").when(F.col("open") > 0, "open").when(F.col("orders") > 0, "on_time").otherwise("not_bought")
    return work.join(bought, "work_order_id", "left").withColumn("delivery", delivery).groupBy("delivery").agg(
        F.count(F.lit(1)).alias("work_order_count"), F.avg("elapsed_cycle_hours").alias("avg_cycle_hours"), F.avg("material_wait_hours").alias("avg_material_wait_hours"), F.avg("worst_variance").alias("avg_worst_variance_hours"))


def model_waits(m: dict[str, DataFrame], transitions: DataFrame, horizon: Column) -> DataFrame:
    """material_id, warehouse_id, work_order_id, asset_id, started_at and ended_at of each wait for each material that its order requires.

    m: conformed tables; transitions: the source's moves.
    """
    moves = transitions.filter("entity_type = 'work_order'").select(F.col("entity_id").alias("work_order_id"), "to_state", "occurred_at", F.col("id").alias("transition_id"))
    waits = state_spans(moves, "work_order_id", "WAITING_MATERIAL", horizon)
    lines = m["work_order_material"].select("work_order_id", "material_id").distinct()
    return waits.join(lines, "work_order_id").join(m["work_order"].select("work_order_id", "asset_id", "warehouse_id"), "work_order_id")


def model_stockouts(balances: DataFrame, horizon: Column) -> DataFrame:
    """material_id, warehouse_id, started_at and ended_at of the times in which nothing was available. balances: all ingested versions."""
    return condition_spans(balances, ["material_id", "warehouse_id"], "_source_commit_timestamp", F.col("on_hand") - F.col("reserved") <= 0, horizon, ["_source_commit_version"])


def model_open_orders(m: dict[str, DataFrame], horizon: Column) -> DataFrame:
    """Lines of purchase orders with supplier_id, material_id and warehouse_id, open from approval to receipt or cancellation."""
    orders = m["purchase_order"].select("purchase_order_id", "supplier_id", "supplier_name", "warehouse_id", F.col("approved_at").alias("started_at"), F.coalesce("received_at", "cancelled_at", horizon.cast("timestamp")).alias("ended_at"))
    return m["purchase_order_item"].select("purchase_order_item_id", "purchase_order_id", "material_id").join(orders, "purchase_order_id")
