import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spindle.llm import lm as L

SCHEMA = "doc_id long, text string, score string, ord long"


def base(rows):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return sorted([(i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) for i, t in rows], key=str)


def make(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcDEé", k=rng.randint(1, 5))) for _ in range(200)]
    return [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(200)], k=rng.randint(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("frequent", [3, 4096])
def test_base_against_brute_force(spark, frequent):
    rows = make(1, 120) + [(500, None), (501, ""), (502, " \n"), (None, "a null id"), (7, "again"), (9, "unseen words"), (9, "unseen words")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    found = sorted(L.lm_scores(df, frequent=frequent).collect(), key=lambda r: str(tuple(r)))
    for r, w in zip(found, base(rows), strict=True):
        assert tuple(r)[:5] == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9)
        assert r.score < 0


def test_model_prefers_text_like_its_corpus(spark):
    rng = random.Random(4)
    pairs = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}

    def chain():
        w, out = "a", []
        for _ in range(60):
            w = rng.choice(pairs[w])
            out.append(w * 3)
        return " ".join(out)

    rows = [(i, chain()) for i in range(400)]
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), 60))) for i, t in rows[:60] if zlib.crc32(str(1000 + i).encode()) % 7 == 2]
    found = {r.doc_id: r for r in L.lm_scores(spark.createDataFrame(rows + shuffled, "doc_id long, text string")).collect()}
    held = [r.score for r in found.values() if r.held_out and r.doc_id < 1000]
    assert np.mean(held) > np.mean([found[i].score for i, _ in shuffled]) + 10
    assert np.mean(held) > np.mean([r.base_score for r in found.values() if r.held_out and r.doc_id < 1000]) + 10


def test_filter_never_loses_a_count():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 1000, len(keys))
    found = L.Filter([L.Filter.segment(keys[keys % 4 == b] >> np.uint64(32), counts[keys % 4 == b]) for b in range(4)])
    got, want = found.levels(keys), np.frexp(counts.astype(float))[1]
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (found.levels(keys + np.uint64(1 << 40)) > 0).mean() < 0.05


def scores(rows):
    return {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in rows.collect()}


def test_model_scores_a_table_it_did_not_learn_from(spark):
    learnt, other = make(5, 150), [(1000 + i, t) for i, t in make(6, 60)] + [(2000, None), (None, "new Words only")]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = L.fit(df(learnt))
    found = scores(L.score(model, df(other)))
    assert set(found) == {i for i, _ in other}
    c = Counter(w for _, t in learnt for w in [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)), None])
    assert (model.tokens, model.vocab) == (sum(c.values()), len(c))
    assert found[None][:2] == (4, 1) and found[2000][:2] == (1, 1)
    assert math.isclose(found[2000][2], math.log10((c[None] + 1) / (model.tokens + model.vocab + 1)), rel_tol=1e-9)
    # the same model again, and a model of nothing
    assert scores(L.score(model, df(other[:5]))) == {i: found[i] for i, _ in other[:5]}
    nothing = scores(L.score(L.fit(df(learnt).limit(0)), df(other)))
    assert all(v[1] == 0 for v in nothing.values())


def test_filter_by_segments_gives_the_same_scores(spark):
    df = spark.createDataFrame(make(7, 150) + [(None, "a"), (900, None)], "doc_id long, text string").repartition(4)
    model = L.fit(df, frequent=20, n_buckets=11)
    assert scores(L.score(model, df)) == scores(L.score(model, df, broadcast=0))


def test_counts_dealt_in_two_steps_are_the_same(spark):
    df = spark.createDataFrame(make(8, 150), "doc_id long, text string").repartition(4)
    one, two = (L.fit(df, frequent=20, n_buckets=23, fan=fan) for fan in (256, 3))
    rows = lambda m: sorted(map(str, m.table.filter(L.F.col("kind") != L.HOT).collect()))
    assert rows(one) == rows(two) and (one.hot_counts == two.hot_counts).all()


def test_empty(spark):
    assert L.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_end_in_a_full_segment():
    keys = np.arange(1, 50, dtype=np.uint64) << np.uint64(32)
    assert (L.Filter([(b"\xff" * 8, 64, 5)]).levels(keys) == 5).all()


def test_filter_follows_the_corpus(spark):
    # words of one letter, so a corpus has many more n-grams than a bit a byte could hold
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    for n in (60, 600):
        rows = [(i, " ".join(rng.choices(letters, k=300))) for i in range(n)]
        model = L.fit(spark.createDataFrame(rows, "doc_id long, text string"), frequent=100, n_buckets=4)
        pairs = {p for _, t in rows for p in zip(t.split(), t.split()[1:])}
        # 8 bits an entry
        assert model.n_bytes > len(pairs) and 0 < model.false_positives < 0.05


def test_batches_of_identical_rows(spark):
    rows = [(1, "the same row again")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = sorted(L.lm_scores(df).collect(), key=lambda r: str(tuple(r)))
    assert len(found) == 40
    for r, w in zip(found, base(rows), strict=True):
        assert tuple(r)[:5] == w[:5] and math.isclose(r.base_score, w[5], rel_tol=1e-9)


def test_what_travels_to_segments_is_packed(spark):
    """Pairs that are probed in segments go there and back in less room than twice their texts take."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(400))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = L.fit(df, frequent=20, n_buckets=4)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    assert len(scores(L.score(model, df, broadcast=0))) == 500
    moved = sum(n for k, n in stages().items() if k not in before)
    assert 0 < moved < 2 * sum(len(t) for _, t in rows)
