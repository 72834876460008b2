"""What grows step by step: snapshots from bases, SCD2 from new versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spindle.operators import changes, dimensions, snapshots
from spindle.sources import tables

AT = dt.datetime(2024, 1, 1)
LOG = "id string, v int, _change_type string, _commit_version bigint, _commit_timestamp timestamp"
VERSIONS = "k string, a string, b int, v bigint, at timestamp"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_snapshots_from_bases(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.randrange(9), rng.choice(["insert", "update_postimage", "update_preimage", "delete"]), n, AT + dt.timedelta(seconds=k)) for n in range(1, 31) for k in range(rng.randrange(1, 4))]
    path = f"{root}/log"
    snapshots.write_log(spark.createDataFrame([r for r in rows if r[3] <= 13], LOG), path)
    log = lambda: spark.read.parquet(path)
    assert plain(snapshots.snapshot(spark, log(), ["id"], root, "t", 13)) == plain(changes.snapshot(log(), ["id"], 13))
    assert snapshots.add_bases(spark, log(), ["id"], root, "t", 5, 13) == [5, 10]
    snapshots.write_log(spark.createDataFrame([r for r in rows if r[3] > 13], LOG), path)
    assert snapshots.add_bases(spark, log(), ["id"], root, "t", 5, 30) == [15, 20, 25, 30] and snapshots.add_bases(spark, log(), ["id"], root, "t", 5, 30) == []
    for version in (1, 4, 5, 6, 14, 22, 29, 30):
        assert plain(snapshots.snapshot(spark, log(), ["id"], root, "t", version)) == plain(changes.snapshot(log(), ["id"], version))
    late = snapshots.snapshot(spark, log(), ["id"], root, "t", 29)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "_commit_version" in plan and "26" in plan
    tail = log().filter(F.col("_commit_version").between(26, 29))
    assert len({f.split("_commit_version=")[1].split("/")[0] for f in tail.select("id", F.input_file_name().alias("f")).select("f").distinct().toPandas().f}) == 4
    assert len([f for f in late.inputFiles() if ".bases.table" in f and "_part=25" in f]) == len([f for f in late.inputFiles() if ".bases.table" in f]) > 0


@pytest.mark.parametrize("seed", range(2))
def test_scd2_grows_to_the_full_build(spark, seed):
    rng = random.Random(seed)
    numbers = rng.sample(range(1, 200), 60)
    every = [(rng.choice("abcde"), rng.choice(["x", "y", None]), rng.randrange(2), n, AT + dt.timedelta(hours=n)) for n in sorted(numbers)]
    late = set(rng.sample(range(60), rng.choice([0, 4, 12])))
    cut = rng.randrange(5, 50)
    first = [r for k, r in enumerate(every[:cut]) if k not in late]
    steps = [every[cut:50], [r for k, r in enumerate(every) if k in late and k < cut] + every[50:] + every[45:48]]  # some come again
    frame = lambda rows: spark.createDataFrame(rows, VERSIONS)
    build = lambda rows: dimensions.scd2(frame(rows), "k", ["a", "b"], "v", "at", seen=True)
    known, seen = build(first), list(first)
    for new in steps:
        seen = list({*seen, *new})
        grown = dimensions.advance_scd2(known, frame(new), frame(seen), "k", ["a", "b"], "v", "at")
        assert {r.k for r in grown.collect()} == {r[0] for r in new}
        known = spark.createDataFrame(changes.upsert(known, grown, ["k"]).collect(), known.schema)
        assert plain(known) == plain(build(seen))


def test_untouched_keys_stay_out_of_the_windows(spark, tmp_path):
    """A step for few keys compares few rows: what a window gets is counted by the rows that it lets through."""
    rows = [(f"k{i}", str(n), n, n, AT) for i in range(300) for n in range(1, 6)]
    known = dimensions.scd2(spark.createDataFrame(rows, VERSIONS), "k", ["a"], "v", "at", seen=True)
    root = str(tmp_path)
    part = F.pmod(F.xxhash64("k"), F.lit(16))
    tables.replace(known, root, "dim", part)
    new = spark.createDataFrame([("k7", "9", 9, 9, AT), ("new", "1", 1, 1, AT)], VERSIONS)
    seen = spark.createDataFrame([*rows, ("k7", "9", 9, 9, AT), ("new", "1", 1, 1, AT)], VERSIONS)
    table = tables.current(spark, root, "dim")
    grown = dimensions.advance_scd2(table, new, seen, "k", ["a"], "v", "at")
    assert grown.count() == 7 and {r.k for r in grown.collect()} == {"k7", "new"}
    files = {p for p in (tmp_path / "dim.table").rglob("*.parquet")}
    after = tables.merge_into(grown, root, "dim", lambda old, rows: changes.upsert(old, rows, ["k"]), ["k"], part, True)
    assert plain(after) == plain(dimensions.scd2(seen, "k", ["a"], "v", "at", seen=True))
    assert len({str(p).split("_part=")[1].split("/")[0] for p in {*(tmp_path / "dim.table").rglob("*.parquet")} - files}) == 2
