import math
import random
from collections import Counter

from pyspark.sql import functions as F
from test_pipeline import WORD, targets

from spindle.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size long, position string"


def make(seed, n):
    rng = random.Random(seed)
    return [(i, "w " * rng.randint(0, 60), rng.choice(["b", "b", "b", "a", "é", "Z", None]), 1, "x") for i in range(n)]


def test_targets_and_taken(spark):
    rows = make(1, 300) + [(None, "one two", "a", 1, "x"), (7, None, "a", 1, "x"), (8, "again", "b", 1, "x"), (8, "again", "b", 1, "x"), (900, "", "empty", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = M.mixture(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter({s: 0 for _, _, s, *_ in rows})
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    assert sorted(r.target for r in found) == sorted(r.target for r in M.mixture(df).collect())
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))
    assert all(any(math.isclose(r.target, want[s]) and r.source_size == sizes[s] for s in sizes) for r in found)
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in found)
    rest = M.curriculum(df).collect()
    taken = Counter()
    for r in rest:
        taken[r.source] += size(r.text)
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    positions = [r[-1] for r in rest]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert M.curriculum(df).columns == df.columns


def test_schedule_moves_documents(spark):
    rows = [(i, "w " * 10, s) for i in range(400) for s in (("a",) if i % 2 else ("b",))]
    found = M.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mean = {s: sum(r.position for r in found if r.source == s) / sum(r.source == s for r in found) for s in "ab"}
    assert mean["a"] < 0.45 < 0.55 < mean["b"]  # weight 3 leads, weight 1 follows


def test_reruns_agree_and_empty(spark):
    df = spark.createDataFrame(make(2, 200), SCHEMA)
    rows = lambda d: sorted(map(str, M.mixture(d).collect()))
    assert rows(df.repartition(3)) == rows(df.repartition(7))
    assert M.mixture(df.limit(0)).count() == 0 and M.curriculum(df.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in M.mixture(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect())


def test_query_places_every_copy(spark, tmp_path, monkeypatch):
    from spindle.llm import queries

    # many small files, as a large table has
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    written, real = [], M.C.materialize
    monkeypatch.setattr(M.C, "materialize", lambda df: written.append(real(df)) or written[-1])

    rows = make(3, 200) + [(8, "again", "b", 1, "x"), (8, "again", "b", 1, "x"), (None, "one two", "a", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op5_mixing(spark, str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # the copies are written in training order: every file is sorted, and files don't overlap
    order = written[-1].select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"), "position").collect()
    files = [[r.position for r in sorted(order, key=lambda r: r.row) if r.file == f] for f in sorted({r.file for r in order})]
    assert len(files) > 1 and all(f == sorted(f) for f in files) and all(a[-1] <= b[0] for a, b in zip(files, files[1:]))
    want = M.mixture(df).collect()
    plain = lambda rs: sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in rs)
    assert plain(found.collect()) == plain(want)
    places = lambda rs: sorted((str(r.doc_id), r.taken, sorted(r.positions or [])) for r in rs)
    assert places(M.placed_digest(df).collect()) == places(want)


def test_equal_rows_of_two_sources_and_any_weights(spark):
    rows = [(1, "same words here", s, k) for s in ("a", "b") for k in range(1000)] + [(2 + k, "w " * 9, "c", k) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    first, again = (sorted((r.source, r.n, r.position) for r in M.curriculum(d, weights=(1, 1, 2), slopes=(0.5,)).collect()) for d in (df.repartition(3), df.repartition(5)))
    assert first == again
    taken = Counter(s for s, *_ in first)
    want = {s: t for s, t in ((r.source, r.target) for r in M.mixture(df, weights=(1, 1, 2), slopes=(0.5, 0.1, 0.2, -0.3)).collect())}
    assert abs(taken["a"] * 3 - want["a"]) <= 3 and abs(taken["b"] * 3 - want["b"]) <= 3
