"""Change logs: reading them as of a version or between versions, merging, and ingesting them in steps.

A change log is a DataFrame with the table's columns and _change_type (insert, update_postimage, update_preimage,
delete), _commit_version and _commit_timestamp. Kept as Parquet partitioned by _commit_version, a range of
versions reads only its own folders.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COMMIT = ("_change_type", "_commit_version", "_commit_timestamp")
#: Kinds of change whose rows are the table's new rows.
ADDED = ("insert", "update_postimage")


def changes_between(log: DataFrame, first: int, last: int) -> DataFrame:
    """The changes of versions first to last, both included."""
    return log.filter(F.col("_commit_version").between(first, last))


def snapshot(log: DataFrame, keys: list[str], version: int | None = None) -> DataFrame:
    """The table as of a version: of each key the last change, unless it was a delete."""
    log = log.filter(F.col("_change_type") != "update_preimage")
    if version is not None:
        log = log.filter(F.col("_commit_version") <= version)
    payload = [c for c in log.columns if c not in (*keys, *COMMIT)]
    # max_by combines before its shuffle, so a key's history is not sorted in one task
    last = log.groupBy(*keys).agg(F.max_by(F.struct("_change_type", *payload), F.struct("_commit_version", "_commit_timestamp", F.col("_change_type") != "delete")).alias("last"))
    return last.filter("last._change_type <> 'delete'").select(*keys, *(F.col(f"last.{c}").alias(c) for c in payload))


def history(log: DataFrame) -> DataFrame:
    """version, timestamp and rows of every commit."""
    return log.groupBy(F.col("_commit_version").alias("version")).agg(F.max("_commit_timestamp").alias("timestamp"), F.count(F.lit(1)).alias("row_count"))


def stable_end(commits: DataFrame, cutoff: datetime) -> int | None:
    """The newest version not later than the cutoff; None if there is none. commits: as ``history`` gives them."""
    return commits.filter(F.col("timestamp") <= F.lit(cutoff)).agg(F.max("version")).first()[0]


def cutoff(started: datetime, lag_minutes: int = 5) -> datetime:
    """Commits later than this may still be joined by others and wait for the next run."""
    if lag_minutes < 0:
        raise ValueError("the lag can't be negative")
    return started - timedelta(minutes=lag_minutes)


# ------------------------------------------------------------------ merging


def one_row_a_key(source: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``newest``."""
    rest = [c for c in source.columns if c not in keys]
    best = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest)).select(*source.columns)


def match(keys: list[str]) -> Column:
    """Equal keys of frames t and s; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    return out


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with source's row for every key that source has. source has one row a key."""
    kept = target.alias("t").join(source.select(*keys).alias("s"), match(keys), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows of source whose keys it lacks."""
    return target.unionByName(source.alias("s").join(target.select(*keys).alias("t"), match(keys), "left_anti"), allowMissingColumns=True)


def upsert_preserving(target: DataFrame, source: DataFrame, keys: list[str], frozen: list[str]) -> DataFrame:
    """``upsert``, but a row that target has already keeps its values of the frozen columns."""
    both = source.alias("s").join(target.select(*keys, *frozen, F.lit(True).alias("_known")).alias("t"), match(keys), "left")
    known = F.col("t._known").isNotNull()
    rows = both.select(*(F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in frozen else F.col(f"s.{c}") for c in source.columns))
    return upsert(target, rows, keys)


def changed_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Of source the rows that target lacks or has with other values, so that a merge writes no row in vain."""
    compared = [c for c in source.columns if c not in keys]
    differ = F.lit(False)
    for c in compared:
        differ |= ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = source.alias("s").join(target.select(*keys, *compared, F.lit(True).alias("_known")).alias("t"), match(keys), "left")
    return joined.filter(F.col("t._known").isNull() | differ).select("s.*")


# ------------------------------------------------------------------ ingestion


def record_hash(columns: list[str]) -> Column:
    """sha256 of the values of the columns, by name in order, a null as ∅; private columns (_ first) are left out."""
    public = sorted(c for c in columns if not c.startswith("_"))
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in public)), 256)


def publicize(rows: DataFrame, table: str, run_id: str, private: tuple[str, ...] = (), change: str | None = None, version: int | None = None, at: datetime | None = None) -> DataFrame:
    """rows with their origin: change type, commit, ingestion time, run, table and record hash, without private columns.

    Rows of a snapshot get ``change``, ``version`` and ``at``; rows of a change log carry their own.
    """
    payload = [c for c in rows.columns if c not in private and c not in COMMIT]
    kind = F.lit(change) if change else F.col("_change_type")
    commit = F.lit(version).cast("bigint") if change else F.col("_commit_version")
    stamp = F.lit(at).cast("timestamp") if change else F.col("_commit_timestamp")
    return rows.select(
        *payload, kind.alias("_source_change_type"), commit.alias("_source_commit_version"), stamp.alias("_source_commit_timestamp"),
        F.current_timestamp().alias("_bronze_ingested_at"), F.lit(run_id).alias("_bronze_run_id"), F.lit(table).alias("_source_table"), record_hash(payload).alias("_source_record_hash"))


def baseline(log: DataFrame, keys: list[str], kind: str, version: int, sequence: str = "valid_from_tick") -> DataFrame:
    """The rows that a first ingestion starts from: a master's snapshot, a state's last row of each key, all rows of events."""
    upto = log.filter((F.col("_commit_version") <= version) & F.col("_change_type").isin(*ADDED))
    if kind == "master":
        return snapshot(log, keys, version)
    if kind == "state":
        return one_row_a_key(upto, keys, [sequence, "_commit_version"]).drop(*COMMIT)
    return upto.drop(*COMMIT)


class SourceReset(RuntimeError):
    """The source's newest version is older than what was ingested before."""


def increment(log: DataFrame, checkpoint: int, end: int | None) -> DataFrame | None:
    """New rows after the checkpoint up to version end; None if there are none to read.

    A checkpoint ahead of the source means that the source was made anew. Deletes have no meaning in sources that
    keep their history, so one is an error.
    """
    if end is None or end == checkpoint:
        return None
    if checkpoint > end:
        raise SourceReset(f"checkpoint {checkpoint} is ahead of the source's version {end}")
    new = changes_between(log, checkpoint + 1, end)
    if not new.filter("_change_type = 'delete'").isEmpty():
        raise ValueError("the change log has a delete")
    return new.filter(F.col("_change_type").isin(*ADDED))


def identity(kind: str, keys: list[str]) -> list[str]:
    """The columns by which an ingested row is known: an event's keys, else the record and its version."""
    return keys if kind == "event" else ["_source_record_hash", "_source_commit_version"]


def ingest(bronze: DataFrame, rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """bronze with new rows, as ``publicize`` gives them: known events and known versions of a record are replaced, not repeated."""
    known = identity(kind, keys)
    return upsert(bronze, one_row_a_key(rows, known, ["_source_commit_version", "_source_commit_timestamp", "_source_record_hash"]), known)


def horizon(*times: tuple[DataFrame, str]) -> datetime | None:
    """The latest business time in the given columns of the given tables."""
    found = [df.agg(F.max(c)).first()[0] for df, c in times]
    return max((t for t in found if t is not None), default=None)


def latest_per_key(rows: DataFrame, keys: list[str], newest: list[str] = ["_source_commit_version", "_source_commit_timestamp", "_source_record_hash"]) -> DataFrame:  # noqa: B006
    """The newest row of each key, nulls oldest. Ranking within a task comes first, so only its winners are shuffled."""
    order = [F.col(c).desc_nulls_last() for c in newest]
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
