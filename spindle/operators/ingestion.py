"""The ingestion step: every source table from its checkpoint to its newest stable version, with a row for the run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.sources import tables
from spindle.sources.schemas import PRIVATE, Source

from . import changes

CHECKPOINT = "source_table string, last_commit_version bigint, last_commit_timestamp timestamp, updated_at timestamp"
RUN = "run_id string, started_at timestamp, stable_cutoff_at timestamp, data_horizon_at timestamp, completed_at timestamp, source_table_count int, rows_ingested bigint"


def read_checkpoint(spark: SparkSession, root: str, table: str) -> int | None:
    """The version up to which a source table was ingested; None before the first time."""
    if not tables.exists(spark, root, "ingestion_checkpoint"):
        return None
    row = tables.current(spark, root, "ingestion_checkpoint").filter(F.col("source_table") == table).first()
    return None if row is None else row.last_commit_version


def write_checkpoint(spark: SparkSession, root: str, table: str, version: int, at: datetime | None, now: datetime) -> None:
    row = spark.createDataFrame([(table, version, at, now)], CHECKPOINT)
    tables.merge_into(row, root, "ingestion_checkpoint", lambda old, new: changes.upsert(old, new, ["source_table"]), ["source_table"])


def raw_name(table: str, source: Source) -> str:
    return f"{table.removesuffix('_store')}_raw" if source.kind == "event" else f"{table}_raw"


def step(spark: SparkSession, read_log: Callable[[str], DataFrame], sources: dict[str, Source], root: str, started: datetime, lag_minutes: int = 5, run_id: str | None = None, span: int = 1000) -> dict[str, int]:
    """Ingests each source table and returns the rows read of each; a table without a stable version is left for the next run.

    A raw table has a part for every ``span`` commit versions, so an increment writes the newest part, and others only if
    they hold the same events already.

    The first time a table's baseline is taken, later the changes after its checkpoint. The raw table is written
    before its checkpoint: a run that is cut off between the two reads the same changes again and merges them
    into the same rows. A source that is behind its checkpoint raises ``changes.SourceReset``, a delete ``ValueError``. Tables
    after the one that fails aren't read; those before it stay ingested.
    """
    run_id, limit, counts = run_id or uuid.uuid4().hex, changes.cutoff(started, lag_minutes), {}
    for name, source in sources.items():
        log, counts[name] = read_log(name), 0
        end = changes.stable_end(changes.history(log), limit)
        if end is None:
            continue
        at = log.filter(F.col("_commit_version") == end).agg(F.max("_commit_timestamp")).first()[0]
        known, keys = read_checkpoint(spark, root, name), list(source.key)
        if known is None:
            rows = changes.publicize(changes.baseline(log, keys, source.kind, end), name, run_id, PRIVATE, "snapshot", end, at)
        elif (new := changes.increment(log, known, end)) is None:
            continue
        else:
            rows = changes.publicize(new, name, run_id, PRIVATE)
        # written once, as the rows are counted and merged
        rows = tables.replace(rows, root, f"{raw_name(name, source)}_new")
        counts[name] = rows.count()
        # the version is part of the identity of all but events
        part, identity = F.floor(F.col("_source_commit_version") / span), changes.identity(source.kind, keys)
        tables.merge_into(rows, root, raw_name(name, source), lambda old, new: changes.ingest(old, new, source.kind, keys), identity, part, source.kind != "event")
        write_checkpoint(spark, root, name, end, at, started)
    events = "event_log_raw"
    business = changes.horizon((tables.current(spark, root, events), "occurred_at")) if tables.exists(spark, root, events) else None
    row = {"run_id": run_id, "started_at": started, "stable_cutoff_at": limit, "data_horizon_at": business or limit, "completed_at": datetime.now(), "source_table_count": len(sources), "rows_ingested": sum(counts.values())}
    tables.append_rows(spark, root, "ingestion_run", RUN, [row])
    return counts
