"""Process mining over state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import slices
from .measures import seconds


def event_log(transitions: DataFrame, most: int | None = slices.MOST) -> DataFrame:
    """Transitions as the events of cases, with their number in the case and the time since the one before.

    Needs transition_id, entity_type, entity_id, from_state, to_state, reason, occurred_at, source_commit_at. Without
    entity there is no case, and events of none are numbered together. A case of more than ``most`` events is worked on
    in slices, for which events are counted by case first.
    """
    events = transitions.withColumns({"case_id": F.concat("entity_type", F.lit(":"), "entity_id"), "activity": F.col("to_state")})
    walked = slices.walk(events, "case_id", ["occurred_at", "source_commit_at", "transition_id"], lag={"occurred_at": "previous_event_at"}, index="event_index", most=most)
    return walked.select(
        "transition_id", "case_id", "entity_type", "entity_id", "from_state", "activity", "reason", "occurred_at", "source_commit_at", "previous_event_at", "event_index",
    ).withColumn("seconds_since_previous", seconds("previous_event_at", "occurred_at"))


def case_summary(events: DataFrame) -> DataFrame:
    """One row a case: its span, number of events and last state."""
    return events.groupBy("case_id", "entity_type", "entity_id").agg(
        F.min("occurred_at").alias("case_started_at"), F.max("occurred_at").alias("case_last_event_at"), F.count(F.lit(1)).alias("event_count"), F.max("event_index").alias("transition_count"),
        F.max_by("activity", F.struct("occurred_at", "source_commit_at", "transition_id")).alias("current_state"),
    ).withColumn("case_duration_seconds", seconds("case_started_at", "case_last_event_at"))


def transition_summary(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """How often, and after how long on average and in the middle, entities of a type go from one state to another."""
    gap = F.col("seconds_since_previous")
    return events.groupBy("entity_type", "from_state", F.col("activity").alias("to_state")).agg(
        F.count(F.lit(1)).alias("transition_count"), F.avg(gap).alias("avg_seconds_from_previous"), F.percentile_approx(gap, 0.5, accuracy).alias("median_seconds_from_previous"))
