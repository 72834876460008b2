import math
import random

import numpy as np
import pytest

from spindle.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n double"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in vectors], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(rng.integers(0, 3, n)).astype(float), np.zeros((n, n)), np.ones((n, n))):
        a = a + a.T
        values, axes = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * n)
        assert np.allclose(axes @ axes.T, np.eye(n), atol=1e-12) and np.allclose(axes @ a @ axes.T, np.diag(values), atol=1e-11 * n)


def test_moments_merge_as_if_whole():
    rng = np.random.default_rng(0)
    x = rng.integers(99_000, 101_000, (300, 5))
    parts = []
    for cut in np.split(x, [0, 1, 1, 40, 299]):
        parts.append(whitening.Moments.none(5, True))
        parts[-1].add(cut)
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(whitening.Moments.of(p.row(0)))
    assert total.n == 300 and total.sums == x.sum(axis=0).tolist()
    assert np.allclose(total.co / 300, np.cov(x.T, bias=True), rtol=1e-12)


def test_against_direct_computation(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 12)) @ np.diag(np.linspace(1, 0.1, 12)) @ rng.normal(size=(12, 12)) * 0.1
    vectors = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    odd = [(900, None), (901, [0.1, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0, 2.0]), (None, vectors[0][1]), (1, vectors[1][1])]
    good = [*vectors, odd[-2], odd[-1]]
    got = whitening.whiten(table(spark, vectors + odd).repartition(7)).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = np.array(x, dtype=float) - np.array(sums) / n
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 8 * n and {r.component for r in got} == set(range(1, 9)) and {r.n for r in got} == {n}
    assert {r.vec_id for r in got} == {i for i, _ in good}
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(row, sums)) for (i, _), row in zip(good, x)}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    for k in range(8):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        want = {i: float(v) for (i, _), v in zip(good, d @ axes[:, k] / math.sqrt(values[k]))}
        sign = 1 if mine[5] * want[5] > 0 else -1
        assert all(abs(sign * mine[i] - want[i]) < 1e-8 for i in want)
        assert all(abs(r.explained - values[k] / values.sum()) < 1e-10 for r in got if r.component == k + 1)
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1
    again = whitening.whiten(table(spark, vectors + odd).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_degenerate_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5, -0.5])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one)] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    line = whitening.whiten(table(spark, [(k, [k / 16, k / 8, 0.0]) for k in range(10)])).collect()
    assert {r.component: round(r.explained, 9) for r in line} == {1: 1.0, 2: 0.0, 3: 0.0} and all(r.whitened == 0 for r in line if r.component > 1)
    huge = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id < 3)


def test_many_partitions_are_merged_in_a_tree(spark):
    rng = random.Random(4)
    rows = [(k, [rng.random() for _ in range(4)]) for k in range(500)]
    df = whitening.usable(table(spark, rows).repartition(40), "vec_id", "embedding")[0]
    found = whitening.moments(df, 4, True)
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float32).astype(float)) + 100000
    assert found.n == 500 and found.sums == x.sum(axis=0).astype(int).tolist() and np.allclose(found.co / 500, np.cov(x.T, bias=True), rtol=1e-11)
