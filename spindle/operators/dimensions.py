"""Dimensions of a star schema, and facts bound to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import changes, slices


def attribute_hash(attributes: list[str]) -> Column:
    """A digest of the attributes in which nulls and separators can't be mistaken for values."""
    return F.sha2(F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}), 256)


def _runs(versions: DataFrame, natural_key: str, attributes: list[str], version: str, since: str, surrogate: str, most: int | None) -> DataFrame:
    """What ``scd2`` gives, and seen_version: the last version that a run was seen with. versions: with _seen, the last version each row stands for."""
    hashed = slices.walk(versions.withColumn("attr_hash", attribute_hash(attributes)), natural_key, [version, since], lag={"attr_hash": "_before", "_seen": "_seen_before"}, most=most)
    starts = hashed.filter(F.col("_before").isNull() | (F.col("_before") != F.col("attr_hash"))).withColumn("effective_from", F.col(since))
    runs = slices.walk(starts, natural_key, [version, since], lead={"effective_from": "effective_to", version: "_next", "_seen_before": "_seen_then"}, most=most)
    newest = versions.groupBy(natural_key).agg(F.max("_seen").alias("_newest"))
    keyed = runs.alias("t").join(newest.alias("s"), changes.match([natural_key])).select("t.*", "s._newest")
    return keyed.select(
        F.xxhash64(F.col(natural_key).cast("string"), F.col(version).cast("string")).alias(surrogate), natural_key, *attributes, version, "effective_from", "attr_hash", "effective_to",
        F.col("_next").isNull().alias("is_current"), F.when(F.col("_next").isNull(), F.col("_newest")).otherwise(F.col("_seen_then")).alias("seen_version"))


def scd2(
    versions: DataFrame, natural_key: str, attributes: list[str], version: str = "source_commit_version", since: str = "source_commit_at", surrogate: str = "dimension_key", most: int | None = slices.MOST,
    seen: bool = False,
) -> DataFrame:
    """One row for each run of versions of a key with the same attributes.

    Columns: surrogate (of key and version), the key, the attributes, version, effective_from, attr_hash, effective_to
    (when the next run starts; null for the last) and is_current. Versions of one time stand in the order of version.
    ``seen`` adds seen_version, the last version of a run, which ``advance_scd2`` needs. A key of more than ``most``
    versions is worked on in slices, for which versions are counted by key first.
    """
    if seen:
        return _runs(versions.withColumn("_seen", F.col(version)), natural_key, attributes, version, since, surrogate, most)
    hashed = slices.walk(versions.withColumn("attr_hash", attribute_hash(attributes)), natural_key, [version, since], lag={"attr_hash": "_before"}, most=most)
    starts = hashed.filter(F.col("_before").isNull() | (F.col("_before") != F.col("attr_hash"))).withColumn("effective_from", F.col(since))
    runs = slices.walk(starts, natural_key, [version, since], lead={"effective_from": "effective_to", version: "_next"}, most=most)
    return runs.select(
        F.xxhash64(F.col(natural_key).cast("string"), F.col(version).cast("string")).alias(surrogate), natural_key, *attributes, version, "effective_from", "attr_hash", "effective_to", F.col("_next").isNull().alias("is_current"))


def advance_scd2(
    known: DataFrame, new: DataFrame, history: DataFrame, natural_key: str, attributes: list[str], version: str = "source_commit_version", since: str = "source_commit_at", surrogate: str = "dimension_key",
    most: int | None = slices.MOST,
) -> DataFrame:
    """All rows of the keys that new versions touch, as ``scd2`` with ``seen`` over all versions would give them; merge them by the natural key.

    Of a key whose new versions all come after those seen, only the open run and the new versions are compared. A key with
    a version that comes late, or again, is built anew from its versions in history, which has the new ones too;
    of history only such keys are compared. Keys without new versions are in no window.
    """
    first = new.groupBy(natural_key).agg(F.min(version).alias("_first"))
    state = known.alias("t").join(first.alias("s"), changes.match([natural_key])).select("t.*", "s._first")
    opened = state.filter("is_current")
    late = opened.filter(F.col("_first") <= F.col("seen_version")).select(natural_key)
    on_time = lambda rows: rows.alias("t").join(late.alias("s"), changes.match([natural_key]), "left_anti")
    columns = [natural_key, *attributes, version, since]
    known_open = opened.filter(F.col("_first") > F.col("seen_version")).withColumn(since, F.col("effective_from")).select(*columns, F.col("seen_version").alias("_seen"))
    fresh = on_time(new).select(*columns, F.col(version).alias("_seen"))
    grown = _runs(known_open.unionByName(fresh), natural_key, attributes, version, since, surrogate, most)
    again = history.alias("t").join(late.distinct().alias("s"), changes.match([natural_key]), "left_semi").select(*columns, F.col(version).alias("_seen"))
    closed = on_time(state.filter("NOT is_current")).select(*grown.columns)
    return closed.unionByName(grown).unionByName(_runs(again, natural_key, attributes, version, since, surrogate, most))


def grow_scd2(known: DataFrame, built: DataFrame, natural_key: str, version: str = "source_commit_version", surrogate: str = "dimension_key") -> DataFrame:
    """known with the runs it lacks; intervals and current flags are worked out anew, so no row has to be updated in place."""
    rows = changes.insert_only(known.drop("effective_to", "is_current"), built.drop("effective_to", "is_current"), [surrogate])
    order = W.partitionBy(natural_key).orderBy(version, "effective_from")
    return rows.withColumns({"effective_to": F.lead("effective_from").over(order), "is_current": F.lead(version).over(order).isNull()}).select(*built.columns)


def type1(rows: DataFrame, natural_key: str, surrogate: str) -> DataFrame:
    """rows with a surrogate key; ``changes.upsert`` on it keeps the latest values only."""
    return rows.select(F.xxhash64(natural_key).alias(surrogate), "*")


def date_dimension(bounds: DataFrame) -> DataFrame:
    """Each day from the first to the last in the one row (first_day, last_day) of bounds, with calendar columns."""
    day = F.explode(F.sequence(F.col("first_day").cast("date"), F.col("last_day").cast("date"))).alias("full_date")
    d = F.col("full_date")
    return bounds.filter("first_day <= last_day").select(day).select(
        (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"), F.dayofweek(d).alias("day_of_week"), F.dayofweek(d).isin(1, 7).alias("is_weekend"))


def with_key(facts: DataFrame, dimension: DataFrame, natural_key: str, surrogate: str, as_name: str | None = None) -> DataFrame:
    """facts with the surrogate key of the current row of the dimension; null where there is none."""
    current = dimension.filter("is_current") if "is_current" in dimension.columns else dimension
    return facts.join(current.select(natural_key, F.col(surrogate).alias(as_name or surrogate)), natural_key, "left")


def as_of(facts: DataFrame, dimension: DataFrame, natural_key: str, at: str, surrogate: str = "dimension_key", slice_unit: str = "day") -> DataFrame:
    """facts with the surrogate key of the row that was valid at their time; null before the first and for a null key.

    Facts and versions stand in one sequence by time, and a fact takes the last version before it, so a key of many facts and
    many versions makes no pairs. A key's time is cut into slices, so that a hot key is many groups: each slice that
    has facts first gets the version it begins with, from a sequence of slices and versions.
    """
    row = F.struct(F.col(surrogate).alias("key"), F.col("effective_to").alias("to"))
    cut = lambda c: F.date_trunc(slice_unit, c.cast("timestamp"))
    unbound = facts.filter(F.col(natural_key).isNull()).withColumn(surrogate, F.lit(None).cast(dimension.schema[surrogate].dataType))
    facts, dimension = facts.filter(F.col(natural_key).isNotNull()), dimension.filter(F.col(natural_key).isNotNull())
    versions = dimension.select(F.col(natural_key).alias("_k"), F.col("effective_from").cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), row.alias("_row")).filter("_at IS NOT NULL")
    rows = facts.select(F.col(natural_key).alias("_k"), F.col(at).cast("timestamp").alias("_at"), F.lit(2).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    # of versions of one time the one that lasts comes last
    order = ["_at", "_kind", F.col("_row.to").asc_nulls_last()]
    last = lambda *by: F.last("_row", ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    slices = rows.select("_k", cut(F.col("_at")).alias("_at")).distinct().withColumn("_kind", F.lit(-1))
    begins = versions.unionByName(slices, allowMissingColumns=True).withColumn("_row", last("_k")).filter("_kind = -1")
    both = rows.unionByName(versions, allowMissingColumns=True).unionByName(begins, allowMissingColumns=True)
    found = both.withColumn("_slice", cut(F.col("_at"))).withColumn("_row", last("_k", "_slice")).filter("_kind = 2")
    valid = F.col("_row.to").isNull() | (F.col("_at") < F.col("_row.to").cast("timestamp"))
    return found.select("_fact.*", F.when(valid, F.col("_row.key")).alias(surrogate)).unionByName(unbound)


def frozen_fact(known: DataFrame | None, rows: DataFrame, key: list[str], dimension_keys: list[str]) -> DataFrame:
    """A fact whose rows keep the dimension keys they first had, while their measures follow the source."""
    return rows if known is None else changes.upsert_preserving(known, rows, key, dimension_keys)
