import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.operators import changes, dimensions, ingestion, quality
from spindle.sources import tables
from spindle.sources.schemas import Source
from spindle.streaming import ingest

LOG = "id string, v int, _change_type string, _commit_version bigint, _commit_timestamp timestamp"
AT = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, v, k, n, AT + dt.timedelta(minutes=n)) for i, v, k, n in rows], LOG)


def test_snapshots_and_history(spark):
    df = log(spark, [("a", 1, "insert", 1), ("b", 1, "insert", 1), ("a", 1, "update_preimage", 2), ("a", 2, "update_postimage", 2), ("b", 1, "delete", 3), ("a", None, "update_postimage", 4)])
    at = lambda v: sorted(tuple(r) for r in changes.snapshot(df, ["id"], v).collect())
    assert at(1) == [("a", 1), ("b", 1)] and at(2) == [("a", 2), ("b", 1)] and at(3) == [("a", 2)] and at(None) == [("a", None)]
    commits = changes.history(df)
    assert changes.stable_end(commits, AT + dt.timedelta(minutes=2, seconds=30)) == 2 and changes.stable_end(commits, AT) is None
    assert changes.cutoff(AT, 5) == AT - dt.timedelta(minutes=5)


def test_increments(spark):
    df = log(spark, [("a", k, "insert", k) for k in range(1, 6)])
    assert changes.increment(df, 5, 5) is None and changes.increment(df, 5, None) is None
    assert sorted(r.v for r in changes.increment(df, 2, 4).collect()) == [3, 4]
    with pytest.raises(changes.SourceReset):
        changes.increment(df, 5, 4)
    with pytest.raises(ValueError):
        changes.increment(log(spark, [("a", 1, "delete", 2)]), 1, 2)


def test_ingest_is_idempotent_and_keeps_versions_apart(spark):
    df = log(spark, [("a", 1, "insert", 1), ("a", 2, "update_postimage", 2), ("a", 1, "update_postimage", 3), ("a", 1, "update_postimage", 3)])
    rows = changes.publicize(df, "t", "r")
    once = changes.ingest(rows.limit(0), rows, "state", ["id"])
    twice = changes.ingest(once, rows, "state", ["id"])
    assert once.count() == twice.count() == 3
    assert changes.latest_per_key(twice, ["id"]).first().v == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=12), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=12))
def test_merges(spark, target, source):
    target, source = dict(target), dict(source)
    a, b = (spark.createDataFrame(list(d.items()), "k int, v int") for d in (target, source))
    rows = lambda df: dict(tuple(r) for r in df.collect())
    merged = changes.upsert(a, b, ["k"])
    assert rows(merged) == target | source == rows(changes.upsert(merged, b, ["k"]))
    assert rows(changes.insert_only(a, b, ["k"])) == source | target
    assert rows(changes.upsert_preserving(a, b, ["k"], ["v"])) == source | target
    assert rows(changes.changed_rows(a, b, ["k"])) == {k: v for k, v in source.items() if target.get(k) != v or k not in target}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["x", "y", None])), min_size=1, max_size=14))
def test_scd2_intervals_follow_one_another(spark, versions):
    rows = [(k, v, n, AT + dt.timedelta(days=n)) for n, (k, v) in enumerate(versions)]
    dim = dimensions.scd2(spark.createDataFrame(rows, "k string, v string, source_commit_version bigint, source_commit_at timestamp"), "k", ["v"]).collect()
    for key in {k for k, _ in versions}:
        own = sorted((r for r in dim if r.k == key), key=lambda r: r.effective_from)
        assert [r.effective_to for r in own[:-1]] == [r.effective_from for r in own[1:]] and [r.is_current for r in own] == [False] * (len(own) - 1) + [True]
        assert all(a.v != b.v for a, b in zip(own, own[1:]))


def test_reconciliation_needs_failures_in_a_row(spark):
    state = spark.createDataFrame([], "check_name string, first_failed_at timestamp, last_failed_at timestamp, consecutive_failures int, last_actual bigint, updated_at timestamp")
    seen = []
    for day, actual in enumerate([2, 1, 3, 0, 1]):
        now = F.lit(AT + dt.timedelta(days=day)).cast("timestamp")
        state = spark.createDataFrame(quality.reconcile(state, spark.createDataFrame([("c", actual)], "check_name string, actual bigint"), now).collect(), state.schema)
        gate = quality.gate_values(state)
        seen.append((state.first().consecutive_failures, gate.first().actual))
        if day == 2:
            assert state.first().first_failed_at == AT
            with pytest.raises(quality.QualityError):
                quality.gate(gate)
    assert seen == [(1, 0), (2, 0), (3, 3), (0, 0), (1, 0)]
    quality.gate(gate)


def test_expectations_let_nulls_pass(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    rule = [quality.Rule("positive", F.col("x") >= 0)]
    r = quality.expectations(df, "d", rule).first()
    assert (r.total_rows, r.failed_rows, round(r.pass_rate, 4)) == (3, 1, 0.6667)
    r = quality.expectations(df.limit(0), "d", rule).first()
    assert (r.total_rows, r.failed_rows, r.pass_rate) == (0, 0, 1.0)


def test_runs_are_logged():
    rows = []
    quality.run_logged(lambda: None, rows.append, "r", lambda: AT)
    with pytest.raises(ZeroDivisionError):
        quality.run_logged(lambda: 1 / 0, rows.append, "r", lambda: AT)
    assert [r["status"] for r in rows] == ["RUNNING", "SUCCEEDED", "RUNNING", "FAILED"] and "division" in rows[-1]["error"]


def test_tables_and_streams(spark, tmp_path):
    root = str(tmp_path)
    tables.create_if_absent(spark, root, "runs", "run_id string, n int")
    tables.append_rows(spark, root, "runs", "run_id string, n int", [{"run_id": "a"}, {"run_id": "b", "n": 2}])
    assert tables.create_if_absent(spark, root, "runs", "run_id string, n int").count() == 2
    df = log(spark, [("a", 1, "insert", 1), ("a", 1, "update_preimage", 2), ("a", 2, "update_postimage", 2), ("b", 1, "insert", 2)])
    df.write.parquet(f"{root}/log")
    start = lambda: ingest.ingest_stream(ingest.change_stream(spark, f"{root}/log", LOG), "t", ["id"], "state", f"{root}/out", f"{root}/checkpoint").awaitTermination(60)
    start()
    start()
    assert spark.read.parquet(f"{root}/out").count() == 3
    log(spark, [("a", 3, "update_postimage", 3)]).write.mode("append").parquet(f"{root}/log")
    start()
    latest = changes.latest_per_key(spark.read.parquet(f"{root}/out"), ["id"])
    assert sorted((r.id, r.v) for r in latest.collect()) == [("a", 3), ("b", 1)]


def test_windowed_transitions(spark, tmp_path):
    rows = [(AT + dt.timedelta(minutes=m), "work_order", s) for m, s in ((1, "A"), (2, "A"), (7, "A"), (60, "B"))]
    spark.createDataFrame(rows, "occurred_at timestamp, entity_type string, to_state string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("occurred_at timestamp, entity_type string, to_state string").parquet(f"{tmp_path}/in")
    q = ingest.windowed_transitions(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.transition_count for r in spark.table("windows").collect()) == [1, 1, 2]


def test_merges_into_the_table_they_read(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda: sorted((r.k, r.v) for r in tables.current(spark, root, "t").collect())
    frame = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    assert not tables.exists(spark, root, "t")
    for k in range(4):
        tables.merge_into(frame((1, k), (k + 2, 0)), root, "t", lambda old, new: changes.upsert(old, new, ["k"]))
    assert rows() == [(1, 3), (2, 0), (3, 0), (4, 0), (5, 0)]
    tables.replace(frame((9, 9)), root, "t")
    assert rows() == [(9, 9)]


def test_ingestion_step(spark, tmp_path):
    root = str(tmp_path)
    sources = {"thing": Source("id string, v int", "master"), "thing_state": Source("id string, v int, valid_from_tick bigint", "state"), "event_log_store": Source("id string, occurred_at timestamp", "event")}
    stamp = lambda n: ("insert", n, AT + dt.timedelta(minutes=n))
    meta = ", _change_type string, _commit_version bigint, _commit_timestamp timestamp"
    logs = lambda last: {
        "thing": spark.createDataFrame([("a", n, *stamp(n)) for n in range(1, last)], sources["thing"].ddl + meta),
        "thing_state": spark.createDataFrame([("a", n, n, *stamp(n)) for n in range(1, last)], sources["thing_state"].ddl + meta),
        "event_log_store": spark.createDataFrame([(str(n), AT + dt.timedelta(days=n), *stamp(n)) for n in range(1, last)], sources["event_log_store"].ddl + meta)}
    run = lambda last, minutes: ingestion.step(spark, logs(last).__getitem__, sources, root, AT + dt.timedelta(minutes=minutes))
    assert run(4, 0) == {"thing": 0, "thing_state": 0, "event_log_store": 0} and not tables.exists(spark, root, "thing_raw")
    assert run(4, 8) == {"thing": 1, "thing_state": 1, "event_log_store": 3}
    assert run(4, 8) == {"thing": 0, "thing_state": 0, "event_log_store": 0}
    assert run(6, 60) == {"thing": 2, "thing_state": 2, "event_log_store": 2}
    assert [tables.current(spark, root, t).count() for t in ("thing_raw", "thing_state_raw", "event_log_raw")] == [3, 3, 5]
    assert ingestion.read_checkpoint(spark, root, "thing") == 5 and "valid_from_tick" not in tables.current(spark, root, "thing_state_raw").columns
    done = tables.read(spark, root, "ingestion_run").orderBy("started_at").collect()
    assert [r.rows_ingested for r in sorted(done, key=lambda r: r.rows_ingested)] == [0, 0, 5, 6] and done[-1].data_horizon_at == AT + dt.timedelta(days=5)
    with pytest.raises(changes.SourceReset):
        run(3, 60)


def test_observation_skips_broken_tables(spark):
    def broken():
        raise OSError("gone")

    seen, errors = quality.observe_run({"good": lambda: spark.range(3), "bad": broken}, {}, F.lit(AT), "raw", "run-1")
    assert [(r.run_id, r.asset_name, r.row_count) for r in seen.collect()] == [("run-1", "good", 3)] and errors == {"bad": "gone"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 200), max_size=10), st.lists(st.integers(-20, 260), min_size=1, max_size=20))
def test_as_of_takes_the_version_of_the_time(spark, starts, times):
    starts = sorted(starts)
    hour = lambda n: AT + dt.timedelta(hours=n)
    versions = [(k, n, hour(s), hour(e) if e is not None else None) for k in "ab" for n, (s, e) in enumerate(zip(starts, [*starts[1:], None]))]
    dim = spark.createDataFrame(versions, "id string, key int, effective_from timestamp, effective_to timestamp")
    facts = spark.createDataFrame([(i, "abc"[i % 3], hour(t)) for i, t in enumerate(times)], "n int, id string, at timestamp")
    found = {r.n: r.key for r in dimensions.as_of(facts, dim, "id", "at", "key").collect()}
    assert found == {i: max((n for n, s in enumerate(starts) if s <= t), default=None) if i % 3 < 2 else None for i, t in enumerate(times)}
