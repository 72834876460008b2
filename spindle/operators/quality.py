"""Expectations, checks, reconciliation with hysteresis, observability and contracts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindle.sources import tables as T

from .measures import seconds


@dataclass(frozen=True)
class Rule:
    """What should hold of each row of a dataset. A rule that is null for a row holds."""

    name: str
    holds: Column
    action: str = "fail"


def expectations(df: DataFrame, dataset: str, rules: list[Rule]) -> DataFrame:
    """One row a rule: dataset, expectation, action, total_rows, failed_rows, pass_rate (1 of an empty table). One pass for all."""
    failed = [F.coalesce(F.sum(F.when(~r.holds, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"f{k}") for k, r in enumerate(rules)]
    counts = df.agg(F.count(F.lit(1)).alias("total"), *failed)
    rows = F.explode(F.array(*(F.struct(F.lit(r.name).alias("expectation"), F.lit(r.action).alias("action"), F.col(f"f{k}").alias("failed_rows")) for k, r in enumerate(rules))))
    return counts.select("total", rows.alias("r")).select(
        F.lit(dataset).alias("dataset"), "r.expectation", "r.action", F.col("total").alias("total_rows"), "r.failed_rows",
        F.when(F.col("total") == 0, 1.0).otherwise((F.col("total") - F.col("r.failed_rows")) / F.nullif(F.col("total"), F.lit(0))).alias("pass_rate"))


class Watch:
    """Rules that are counted while a dataset is written, with its rows and the latest of its times; no further scan.

    watch(df) is df, to be written once; what was counted is there when that write has ended. Spark repeats lost tasks without
    counting rows twice.
    """

    def __init__(self, dataset: str, rules: list[Rule], time_column: str | None = None):
        self.dataset, self.rules, self.time_column, self._seen = dataset, rules, time_column, Observation()

    def __call__(self, df: DataFrame) -> DataFrame:
        failed = [F.sum(F.when(~r.holds, 1).otherwise(0)).alias(f"f{k}") for k, r in enumerate(self.rules)]
        latest = F.max(self.time_column).cast("timestamp") if self.time_column else F.lit(None).cast("timestamp")
        return df.observe(self._seen, F.count(F.lit(1)).alias("total"), (F.max(latest) if not self.time_column else latest).alias("latest"), *failed)

    def failures(self) -> dict[str, int]:
        """Failed rows of each rule."""
        return {r.name: self._seen.get[f"f{k}"] or 0 for k, r in enumerate(self.rules)}

    def results(self, spark: SparkSession) -> DataFrame:
        """As ``expectations`` gives them."""
        total = self._seen.get["total"]
        rows = [(self.dataset, r.name, r.action, total, n, 1.0 if not total else (total - n) / total) for r, n in zip(self.rules, self.failures().values())]
        return spark.createDataFrame(rows, "dataset string, expectation string, action string, total_rows long, failed_rows long, pass_rate double")

    def observed(self, spark: SparkSession, now: Column, layer: str) -> DataFrame:
        """As ``observe`` gives it."""
        row = [(layer, self.dataset, self._seen.get["total"], self._seen.get["latest"])]
        return _with_freshness(spark.createDataFrame(row, "layer string, asset_name string, row_count long, latest_at timestamp"), now)

    def require(self) -> None:
        """Raises if a rule of action fail has failed rows."""
        bad = {r.name: n for r, n in zip(self.rules, self.failures().values()) if n and r.action == "fail"}
        if bad:
            raise QualityError(", ".join(f"{self.dataset}.{name}: {n}" for name, n in bad.items()))


def latest_results(results: DataFrame) -> DataFrame:
    """Of each rule of each dataset the last result. results: as ``expectations`` gives them, with observed_at."""
    order = W.partitionBy("dataset", "expectation").orderBy(F.desc("observed_at"))
    return results.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def check(name: str, violations: DataFrame) -> DataFrame:
    """check_name and actual, the number of violating rows."""
    return violations.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("check_name"), "actual")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of child whose key is set but isn't in parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_single_current(dimension: DataFrame, natural_key: str) -> DataFrame:
    """Keys of a dimension that haven't just one current row."""
    return dimension.groupBy(natural_key).agg(F.sum(F.col("is_current").cast("int")).alias("n")).filter("n <> 1")


def checks(found: dict[str, DataFrame]) -> DataFrame:
    """``check`` of each named frame of violations, in one frame."""
    return reduce(DataFrame.unionByName, (check(name, df) for name, df in found.items()))


class QualityError(RuntimeError):
    """A hard check failed."""


def gate(results: DataFrame) -> None:
    """Raises unless ``actual`` is 0 in every row; results has as many rows as there are checks."""
    bad = results.filter("actual <> 0").collect()
    if bad:
        raise QualityError(", ".join(f"{r.check_name}: {r.actual}" for r in sorted(bad)))


def reconcile(state: DataFrame, results: DataFrame, observed_at: Column) -> DataFrame:
    """The new state of checks that may fail for a while: how many runs in a row each has failed, and since when.

    State: check_name, first_failed_at, last_failed_at, consecutive_failures, last_actual, updated_at. A run that
    passes resets a check; checks without a result stay as they are.
    """
    both = state.alias("s").join(results.alias("r"), "check_name", "full_outer")
    ran, failed = F.col("r.actual").isNotNull(), F.col("r.actual") > 0
    streak = F.coalesce("s.consecutive_failures", F.lit(0))
    return both.select(
        "check_name",
        F.when(failed, F.when(streak > 0, F.col("s.first_failed_at")).otherwise(observed_at)).when(ran, None).otherwise(F.col("s.first_failed_at")).alias("first_failed_at"),
        F.when(failed, observed_at).otherwise(F.col("s.last_failed_at")).alias("last_failed_at"),
        F.when(failed, streak + 1).when(ran, 0).otherwise(streak).alias("consecutive_failures"),
        F.coalesce("r.actual", "s.last_actual").alias("last_actual"),
        F.when(ran, observed_at).otherwise(F.col("s.updated_at")).alias("updated_at"))


def gate_values(state: DataFrame, threshold: int = 3) -> DataFrame:
    """check_name and actual as the gate sees it: 0 until a check has failed ``threshold`` times in a row."""
    return state.select("check_name", F.when(F.col("consecutive_failures") >= threshold, F.col("last_actual")).otherwise(0).alias("actual"))


def streaks(results: DataFrame) -> DataFrame:
    """results (check_name, run, actual) with the number of failures in a row up to each run."""
    order = W.partitionBy("check_name").orderBy("run")
    group = F.sum(F.when(F.col("actual") > 0, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    grouped = results.withColumn("_group", group)
    run = W.partitionBy("check_name", "_group").orderBy("run").rowsBetween(W.unboundedPreceding, 0)
    return grouped.withColumn("consecutive_failures", F.sum(F.when(F.col("actual") > 0, 1).otherwise(0)).over(run)).drop("_group")


def observe(tables: dict[str, DataFrame], time_columns: dict[str, str], now: Column, layer: str) -> DataFrame:
    """asset_name, layer, row_count, latest_at and freshness_minutes of each table; without a time column, the last two are null."""
    rows = []
    for name, df in tables.items():
        latest = F.max(time_columns[name]).cast("timestamp") if name in time_columns else F.lit(None).cast("timestamp")
        rows.append(df.agg(F.count(F.lit(1)).alias("row_count"), latest.alias("latest_at")).select(F.lit(layer).alias("layer"), F.lit(name).alias("asset_name"), "row_count", "latest_at"))
    return _with_freshness(reduce(DataFrame.unionByName, rows), now)


def _with_freshness(rows: DataFrame, now: Column) -> DataFrame:
    return rows.withColumn("freshness_minutes", (seconds(F.col("latest_at"), now.cast("timestamp")) / F.lit(60.0)).cast("double"))


def stale(observed: DataFrame, most_minutes: float) -> DataFrame:
    """Assets older than allowed, or of unknown age."""
    return observed.filter(F.col("freshness_minutes").isNull() | (F.col("freshness_minutes") > most_minutes))


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that df lacks; further ones are welcome."""
    return [c for c in required if c not in df.columns]


def coverage(spark: SparkSession, facts: list[str], registry: dict[str, str]) -> DataFrame:
    """fact_table and cube_count of every fact that hasn't just one cube. registry: fact by cube."""
    rows = [(f, sum(v == f for v in registry.values())) for f in sorted({*facts, *registry.values()})]
    return spark.createDataFrame([r for r in rows if r[1] != 1 or r[0] not in facts], "fact_table string, cube_count int")


def failing_rules(results: DataFrame) -> DataFrame:
    """Rules of action fail whose last result has failed rows. results: as ``latest_results`` takes them."""
    return latest_results(results).filter("action = 'fail' AND failed_rows > 0")


def observe_run(tables: dict[str, Callable[[], DataFrame]], time_columns: dict[str, str], now: Column, layer: str, run_id: str) -> tuple[DataFrame | None, dict[str, str]]:
    """``observe`` of each table by itself with run_id and observed_at, and the error of each table that can't be read, which is left out."""
    rows, errors = [], {}
    for name, load in tables.items():
        try:
            # a few numbers a table, so that one that is broken fails here and not with all others
            rows += observe({name: load()}, time_columns, now, layer).collect()
        except Exception as e:
            errors[name] = str(e)[:500]
    if not rows:
        return None, errors
    seen = SparkSession.active().createDataFrame(rows, "layer string, asset_name string, row_count long, latest_at timestamp, freshness_minutes double")
    return seen.select(F.lit(run_id).alias("run_id"), now.cast("timestamp").alias("observed_at"), "layer", "asset_name", F.lit("table").alias("asset_type"), "row_count", "latest_at", "freshness_minutes"), errors


def observe_catalog(spark: SparkSession, time_columns: tuple[str, ...], now: Column, layer: str, run_id: str, root: str, database: str = "default") -> dict[str, str]:
    """``observe_run`` of every table in a database of the catalog, added to the table ``asset_observation`` under root; gives the errors.

    A table's time is the first of the time columns that it has.
    """
    columns: dict[str, list[str]] = {}
    for r in T.columns_of(spark, database).collect():  # the catalog, not the tables
        columns.setdefault(r.table_name, []).append(r.column_name)
    times = {name: next(c for c in time_columns if c in own) for name, own in columns.items() if any(c in own for c in time_columns)}
    seen, errors = observe_run({name: lambda name=name: spark.table(name) for name in columns}, times, now, layer, run_id)
    if seen is not None:
        T.append(seen, root, "asset_observation")
    return errors


def catalog_coverage(spark: SparkSession, registry: DataFrame, prefix: str = "fact_", database: str = "default") -> DataFrame:
    """fact_table, cube_count and row_count (null: no such table) of every fact that is in the catalog or in the registry.

    Facts are the catalog's tables whose names start with prefix. registry: fact_table and cube_name, as published.
    """
    found = sorted({t.name for t in spark.catalog.listTables(database) if t.name.startswith(prefix)})
    counts = [spark.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("fact_table"), "row_count") for name in found]
    rows = reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "fact_table string, row_count long")
    cubes = registry.groupBy("fact_table").agg(F.count_distinct("cube_name").cast("int").alias("cube_count"))
    return rows.join(cubes, "fact_table", "full_outer").select("fact_table", F.coalesce("cube_count", F.lit(0)).alias("cube_count"), "row_count")


def run_logged(task: Callable[[], None], log: Callable[[dict], None], run_id: str, clock: Callable[[], object], most: int = 2000) -> None:
    """Runs a task and logs its start and its end; a failure is logged with the end of its message and raised."""
    row = {"run_id": run_id, "started_at": clock(), "status": "RUNNING"}
    log(row)
    try:
        task()
    except Exception as e:
        log(row | {"finished_at": clock(), "status": "FAILED", "error": str(e)[-most:]})
        raise
    log(row | {"finished_at": clock(), "status": "SUCCEEDED"})
