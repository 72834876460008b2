import random
import re

import numpy as np
from pyspark.sql import functions as F

from spindle.llm import minhash as M

SCHEMA = "doc_id long, text string, component string, est long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    sets = [shingles(d[2]) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    where = {d: k for k, d in enumerate(docs)}
    out = []
    for i, t in rows:
        k = where[i is None, i or 0, t or ""]
        r = find(k)
        out.append((i, len(sets[k]), None if docs[r][0] else docs[r][1], r == k))
    return sorted(out, key=str)


def make(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcDEé", k=rng.randint(2, 5)))
    bases = [[word() for _ in range(rng.randint(5, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        if rng.random() < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(0, 60))]
        rows.append((i + 10, rng.choice([" ", "  ", "\n"]).join(w)))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, M.near_dedup(df).drop("text_key").collect()), key=str) == brute(rows)


def test_against_brute_force(spark):
    rows = make(1, 250)
    want = brute(rows)
    assert sum(not r[3] for r in want) > 80 and len({r[2] for r in want}) > 20
    check(spark, rows)


def test_ids_that_repeat_and_are_null(spark):
    rows = make(2, 60)
    check(spark, rows + rows[:4] + [(None, rows[0][1]), (None, None), (None, "solo words of a null id row"), (12, "another text under one id"), (900, ""), (901, None), (902, " \t"), (903, "one two"), (904, "ONE  two")])


def test_empty(spark):
    assert M.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(205, 201), (203, 205), (203, 209)]
    found = {r.node: r.component for r in M.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + k] == 100 for k in range(30))
    assert {found[k] for k in (201, 203, 205, 209)} == {201}


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(0)
    rows, want = [], []
    for k, share in enumerate([0.3, 0.6, 0.75, 0.9, 1.0] * 8):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        m = int(400 * share)
        b = np.concatenate([a[:m], rng.integers(0, 2**63, 400 - m, dtype=np.uint64)])
        sig, _ = M.signatures([a, b])
        rows.append((sig[0].tolist(), sig[1].tolist()))
        want.append(m / (800 - m))
    got = [r[0] for r in spark.createDataFrame(rows, "x array<long>, y array<long>").select(M.estimate("x", "y")).collect()]
    assert np.abs(np.array(got) - want).max() < 0.16 and abs(np.mean(np.array(got) - want)) < 0.02


def around_a_template(n, seed=5):
    """n texts of 200 words, of which 160 are one template's; every tenth repeats its predecessor but for two words."""
    rng = random.Random(seed)
    shared = [f"t{k}" for k in range(160)]
    rows = []
    for i in range(n):
        if i % 10 == 9:
            w = rows[-1][1].split()
            w[170], w[190] = f"x{i}", f"y{i}"
        else:
            w = shared + [f"own{i}-{k}-{rng.random()}" for k in range(40 + i % 3)]
        rows.append((i, " ".join(w)))
    return rows


def test_crowded_buckets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "CROWD", 1)
    for seed in (1, 3):
        check(spark, make(seed, 200))


def test_documents_around_one_template(spark):
    rows = around_a_template(400)
    want = brute(rows)
    assert sum(not r[3] for r in want) == 40  # the template alone links nothing
    check(spark, rows)


def test_rare_shingles_of_a_template_grow_with_its_documents(spark):
    met = []
    for n in (500, 2000):
        docs = spark.createDataFrame([(i, t) for i, t in around_a_template(n)], "ord long, text string")
        crowd = docs.select("ord", F.col("ord").alias("component"))
        pairs = M.shared_rarest(M.rarest(docs, crowd, 5, 75, lambda df: df), 75)
        met.append(pairs.count())
    assert met == [50, 200]


def two_families(n, seed=2):
    """n texts in two families that share 400 of 500 words, so their texts are similar to each other by about 0.65; each text has a word of its own."""
    rng = random.Random(seed)
    base = [f"s{k}" for k in range(400)]
    own = [[f"f{f}-{k}" for k in range(100)] for f in range(2)]
    rows = []
    for i in range(n):
        w = base + own[i % 2]
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_two_families_are_not_compared_member_by_member(spark, monkeypatch):
    rows = two_families(60)
    assert {c for _, _, c, _ in brute(rows)} == {0, 1}
    compared = []
    plain = M.shared_rarest
    monkeypatch.setattr(M, "shared_rarest", lambda *a: compared.append(plain(*a).count()) or plain(*a))
    docs = spark.createDataFrame(two_families(1200), "doc_id long, text string")
    got = M.near_dedup(docs).collect()
    assert {(r.doc_id % 2, r.component_id) for r in got} == {(0, 0), (1, 1)} and sum(r.kept for r in got) == 2
    # two families of 600 have 360,000 pairs between them
    assert compared == [0] or compared == []
