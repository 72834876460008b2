"""Windows over hot keys in slices: the same rows as one window a key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spindle.operators import dimensions, process, slices

AT = dt.datetime(2024, 1, 1)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        key = rng.choice(["hot"] * 8 + ["warm", "cold", None])
        at = None if rng.random() < 0.02 else AT + dt.timedelta(minutes=rng.choice([rng.randrange(5000), 7, 7]))
        rows.append((k, key, at, rng.choice(["a", "b", None])))
    return spark.createDataFrame(rows, "id int, key string, at timestamp, kind string").cache()


@pytest.mark.parametrize("most", [7, 60])
def test_walk_is_a_window(events, most):
    ask = {"lag": {"kind": "kind_before", "at": "at_before"}, "lead": {"id": "id_after"}, "index": "n", "sums": {"id": "id_sum", "half": "half_sum"}}
    events = events.withColumn("half", F.when(F.col("kind") == "a", F.col("id")))
    assert plain(slices.walk(events, "key", ["at", "id"], most=most, **ask)) == plain(slices.walk(events, "key", ["at", "id"], most=None, **ask))


def test_a_hot_key_is_many_groups(spark):
    rows = spark.range(200_000).select(F.lit("one").alias("key"), F.col("id"), (F.col("id") * 7919 % 200_003).alias("at"))
    cut = slices.cuts(rows, "key", "at", 10_000).first()
    assert len(cut._walk_cuts) == 19 and max(b - a for a, b in zip([0, *cut._walk_cuts], [*cut._walk_cuts, 200_003])) < 11_000
    walked = slices.walk(rows, "key", ["at"], lag={"at": "before"}, index="n", most=10_000)
    assert walked.filter("before >= at OR (before IS NULL AND n > 1)").isEmpty() and walked.agg(F.sum("n"), F.count_distinct("n")).first()[:] == (200_000 * 200_001 // 2, 200_000)
    assert slices.cuts(rows, "key", "at", 200_000) is None


def test_event_log_and_scd2_in_slices(spark, events):
    log = events.select(F.col("id").alias("transition_id"), F.lit("t").alias("entity_type"), F.col("key").alias("entity_id"), F.lit(None).cast("string").alias("from_state"), F.col("kind").alias("to_state"), F.lit("").alias("reason"), F.col("at").alias("occurred_at"), F.col("at").alias("source_commit_at"))
    found = process.event_log(log, 20)
    assert plain(found) == plain(process.event_log(log, None))
    assert {r.case_id for r in found.collect()} == {"t:hot", "t:warm", "t:cold", None}
    versions = events.select("key", "kind", F.col("id").alias("v"), F.col("at"))
    assert plain(dimensions.scd2(versions, "key", ["kind"], "v", "at", most=20)) == plain(dimensions.scd2(versions, "key", ["kind"], "v", "at", most=None))
    assert plain(dimensions.scd2(versions, "key", ["kind"], "v", "at", most=20, seen=True).drop("seen_version")) == plain(dimensions.scd2(versions, "key", ["kind"], "v", "at"))


def test_a_slice_is_found_by_halving(spark):
    """Of thousands of cuts few are looked at for a row, as the plan shows: no function goes over all of them."""
    marks = sorted(random.Random(5).choices(range(20_000), k=slices.SLICES - 1))
    for cuts in (marks, marks[:1000], marks[:1], []):
        rows = spark.range(-1, 20_001, 7).select("id", F.array(*map(F.lit, cuts)).cast("array<bigint>").alias("cuts")).withColumn("n", slices._place(F.col("id"), F.col("cuts")))
        assert all(r.n == sum(c < r.id for c in cuts) for r in rows.select("id", "n").collect()[:: 1 + len(cuts) // 100])
    rows = spark.range(100).select(F.lit("one").alias("key"), "id")
    assert "filter(" not in slices.walk(rows, "key", ["id"], index="n", most=10)._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_several_columns(events):
    ask = {"lead": {"id": "id_after"}, "index": "n", "sums": {"id": "id_sum"}}
    one = events.withColumn("both", F.struct("key", "kind"))
    for most in (None, 9):
        assert plain(slices.walk(events, ["key", "kind"], ["at", "id"], most=most, **ask)) == plain(slices.walk(one, "both", ["at", "id"], most=None, **ask).drop("both"))


def test_limit_by_a_count(spark):
    rows = spark.range(100).select((F.col("id") % 9).alias("key"))
    assert slices.limit(rows, "key", 4, 48) is None and slices.limit(rows, "key", 4, 47) == 47 and slices.limit(rows.limit(0), "key", 4) is None
