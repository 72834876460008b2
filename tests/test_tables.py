"""Sinks: what a merge writes, and what a job that is cut off leaves."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindle.operators import changes
from spindle.sources import tables


def frame(spark, *rows, ddl="k int, v int, day int"):
    return spark.createDataFrame(list(rows), ddl)


def held(spark, root, name="t"):
    return sorted(tuple(r) for r in tables.current(spark, root, name).collect())


def files(root, name="t"):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root, f"{name}.table").rglob("*.parquet")}


def upsert(old, new):
    return changes.upsert(old, new, ["k"])


def test_an_increment_writes_only_its_parts(spark, tmp_path):
    root = str(tmp_path)
    merge = lambda *rows: tables.merge_into(frame(spark, *rows), root, "t", upsert, ["k"], F.col("day"))
    merge(*((k, 0, k // 10) for k in range(50)))
    assert tables.parts(spark, root, "t") == [0, 1, 2, 3, 4]
    first = files(root)
    merge((50, 0, 5), (51, 0, 4))  # new rows only: nothing is written again
    second = files(root)
    assert first.items() <= second.items() and {p.split("_part=")[1][0] for p in second.keys() - first.keys()} == {"4", "5"}
    tables.merge_into(frame(spark, (12, 7, 1)), root, "t", upsert, ["k"], F.col("day"), keep=0)  # one part is written again, others keep their files
    third = files(root)
    assert all(second[p] == third[p] for p in third.keys() & second.keys()) and {p.split("_part=")[1][0] for p in third.keys() ^ second.keys()} == {"1"}
    merge((13, 8, 9))  # a row that moves to another part
    assert held(spark, root) == sorted([(k, 7 if k == 12 else 0, k // 10) for k in range(50) if k != 13] + [(13, 8, 9), (50, 0, 5), (51, 0, 4)])


def test_random_merges_are_upserts(spark, tmp_path):
    root, rng, want = str(tmp_path), random.Random(1), {}
    for step in range(7):
        rows = {rng.choice([*range(30), None]): (step, rng.choice([0, 1, 2, None])) for _ in range(rng.randrange(0, 8))}
        want |= rows
        for _ in range(1 + (step == 5)):  # a repeated run changes nothing
            tables.merge_into(frame(spark, *((k, *v) for k, v in rows.items())), root, "t", upsert, ["k"], F.col("day"), keep=0 if step % 2 else 3600)
        key = lambda r: str(r)
        assert sorted((tuple(r) for r in tables.current(spark, root, "t").collect()), key=key) == sorted(((k, *v) for k, v in want.items()), key=key)
    with pytest.raises(ValueError):
        tables.append(frame(spark, ("x",), ddl="k string"), root, "t")


def test_new_columns_are_null_in_old_parts(spark, tmp_path):
    root = str(tmp_path)
    tables.append(frame(spark, (1, 1, 0)), root, "t", F.col("day"))
    tables.merge_into(frame(spark, (2, 1, 1, "x"), ddl="k int, v int, day int, note string"), root, "t", upsert, ["k"], F.col("day"))
    assert held(spark, root) == [(1, 1, 0, None), (2, 1, 1, "x")]


def test_many_folders_of_a_part_become_one(spark, tmp_path):
    root = str(tmp_path)
    for k in range(tables.FOLDERS + 1):
        tables.merge_into(frame(spark, (k, 0, 0)), root, "t", upsert, ["k"], F.col("day"))
    assert len(tables._newest(tables._Folder(spark, root, "t")).parts[0]) == 1 and len(held(spark, root)) == tables.FOLDERS + 1


class Cut(Exception):
    pass


@pytest.mark.parametrize("work", ["replace", "merge", "append"])
def test_a_job_cut_off_at_any_step_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, work):
    root, plain = str(tmp_path), {m: getattr(tables._Folder, m) for m in ("listed", "text", "write_text", "rename", "delete")}
    tables.merge_into(frame(spark, *((k, 0, k % 3) for k in range(9))), root, "t", upsert, ["k"], F.col("day"), keep=0)
    run = {
        "replace": lambda: tables.replace(frame(spark, (1, 5, 5)), root, "t", keep=0),
        "merge": lambda: tables.merge_into(frame(spark, (1, 5, 1), (99, 5, 5)), root, "t", upsert, ["k"], F.col("day"), keep=0),
        "append": lambda: tables.append(frame(spark, (1000, 5, 5)), root, "t", keep=0)}[work]
    seen = set()
    for stop in [0, 2, 3, 4, 5, 6, 7, 8, 10, 40]:
        before, calls = held(spark, root), 0

        def step(method):
            def cut(self, *args):
                nonlocal calls
                calls += 1
                if calls > stop:
                    raise Cut
                return plain[method](self, *args)
            return cut

        for m in plain:
            monkeypatch.setattr(tables._Folder, m, step(m))
        try:
            run()
            done = True
        except Cut:
            done = False
        monkeypatch.undo()
        after = held(spark, root)
        new = {"replace": [(1, 5, 5)], "merge": sorted([r for r in before if r[0] not in (1, 99)] + [(1, 5, 1), (99, 5, 5)]), "append": sorted([*before, (1000, 5, 5)])}[work]
        assert after == new if done else after in (before, new)
        seen.add((done, after == before))
        if done:
            break
    assert done and (False, True) in seen
    assert held(spark, root) == new


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.replace(frame(spark, (1, 1, 1)), root, "t")
    write = tables._write

    def slow(*args):
        monkeypatch.setattr(tables, "_write", write)
        tables.append(frame(spark, (2, 2, 2)), root, "t")
        return write(*args)

    monkeypatch.setattr(tables, "_write", slow)
    with pytest.raises(tables.ConcurrentWrite):
        tables.replace(frame(spark, (3, 3, 3)), root, "t")
    assert held(spark, root) == [(1, 1, 1), (2, 2, 2)]


def test_old_versions_stay_for_readers_that_have_begun(spark, tmp_path):
    root = str(tmp_path)
    old = tables.replace(frame(spark, (1, 1, 1)), root, "t")
    tables.replace(frame(spark, (2, 2, 2)), root, "t")
    assert [r.k for r in old.collect()] == [1] and len(list(Path(root, "t.table").glob("*-*"))) == 0
    tables.replace(frame(spark, (3, 3, 3)), root, "t", keep=0)
    assert [p.name for p in Path(root, "t.table", "pointers").glob("0*")] == ["000000000003"] and len(files(root)) == 1


def test_shuffled_parts_stay_whole(spark, tmp_path):
    """A part of many rows may be several files; each row is in one of them."""
    tables.replace(spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("v"), (F.col("id") % 7).cast("int").alias("day")).repartition(9), str(tmp_path), "t", F.col("day"))
    assert held(spark, str(tmp_path)) == [(k, 0, k % 7) for k in range(1000)] and len(tables.parts(spark, str(tmp_path), "t")) == 7
