"""Snapshots of a change log from bases: the table as it was at every n-th version, written once, and the changes since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.sources import tables

from . import changes


def write_log(rows: DataFrame, path: str) -> None:
    """Adds changes to a log: a folder a commit version, so that a range of versions is a range of folders."""
    rows.hint("rebalance", "_commit_version").write.partitionBy("_commit_version").mode("append").parquet(path)


def from_base(base: DataFrame | None, tail: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes of tail, from the table before them; without a base tail is the whole log up to then."""
    if base is None:
        return changes.snapshot(tail, keys)
    tail = tail.filter(F.col("_change_type") != "update_preimage")
    payload = [c for c in base.columns if c not in keys]
    last = tail.groupBy(*keys).agg(F.max_by(F.struct("_change_type", *payload), F.struct("_commit_version", "_commit_timestamp", F.col("_change_type") != "delete")).alias("last"))
    kept = base.alias("t").join(last.select(*keys).alias("s"), changes.match(keys), "left_anti")
    return kept.unionByName(last.filter("last._change_type <> 'delete'").select(*keys, *(F.col(f"last.{c}").alias(c) for c in payload)))


def snapshot(spark: SparkSession, log: DataFrame, keys: list[str], root: str, name: str, version: int) -> DataFrame:
    """The table as of a version, from the newest base that isn't later and the log's folders after it; without a base from the log alone."""
    known = [b for b in tables.parts(spark, root, f"{name}.bases") if b <= version]
    if not known:
        return changes.snapshot(log, keys, version)
    return from_base(tables.current(spark, root, f"{name}.bases", known[-1:]), log.filter(F.col("_commit_version").between(known[-1] + 1, version)), keys)


def add_bases(spark: SparkSession, log: DataFrame, keys: list[str], root: str, name: str, every: int, newest: int) -> list[int]:
    """Writes the bases that are due up to version ``newest``, each from the one before, and gives their versions.

    A base is a part of one table, which names it once it is whole; a run that is cut off goes on where it was. The log's
    versions up to newest must be final: a base isn't made again.
    """
    made = []
    known = tables.parts(spark, root, f"{name}.bases")
    for version in range((known[-1] if known else 0) + every, newest + 1, every):
        tables.append(snapshot(spark, log, keys, root, name, version), root, f"{name}.bases", F.lit(version))
        made.append(version)
    return made
