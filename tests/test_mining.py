"""The event log of a stream in random batches is that of all its rows."""

import datetime as dt
import random

import pytest

from spindle.operators import process
from spindle.sources import tables
from spindle.streaming import mining

AT = dt.datetime(2024, 1, 1)
DDL = "transition_id string, entity_type string, entity_id string, from_state string, to_state string, reason string, occurred_at timestamp, source_commit_at timestamp"


def plain(df):
    return sorted((tuple(r) for r in df.select(*mining._COLUMNS).collect()), key=str)


@pytest.fixture
def store(spark):
    spark.conf.set(*mining.STORE)
    yield
    spark.conf.unset(mining.STORE[0])


def test_streamed_batches_equal_the_batch(spark, tmp_path, store):
    rng, root = random.Random(8), str(tmp_path)
    rows = []
    for k in range(160):
        at = AT + dt.timedelta(minutes=5 * (k // 2), seconds=rng.choice([0, 7, 7]))
        rows.append((f"x{k:03}", rng.choice(["order", "work"]), rng.choice(["1", "2", "3"]), None, rng.choice("ABC"), rng.choice([None, "r"]), at, at if k % 5 else None))
    # some come up to 40 minutes late, some twice
    comes = sorted(((r[6] + dt.timedelta(minutes=rng.choice([0, 0, 0, 40])), r) for r in rows + rows[10::9]), key=lambda p: p[0])
    steps, batches = sorted(rng.sample(range(len(comes)), 4)), []
    for a, b in zip([0, *steps], [*steps, len(comes)]):
        batches.append([r for _, r in comes[a:b]])
    batches[-1] += [("z1", None, "1", None, "A", None, AT, AT), ("z2", "order", "1", None, "A", None, None, AT)]
    for batch in batches:
        spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        mining.mine_stream(stream, root, "process_event", f"{root}/checkpoint", "1 hour", 4).awaitTermination(180)
    seen = tables.current(spark, root, "process_event")
    want = process.event_log(spark.createDataFrame(rows, DDL))
    assert plain(seen) == plain(want)
    summary = lambda df: sorted(map(str, process.case_summary(df).collect()))
    assert summary(seen) == summary(want)
    moves = lambda df: sorted(map(str, process.transition_summary(df).collect()))
    assert moves(seen) == moves(want)
