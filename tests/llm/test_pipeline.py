import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from test_minhash import brute as near
from test_toxicity import make as labelled
from tokenizers import Tokenizer

from spindle.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(seed=4, n=400):
    rng = random.Random(seed)
    made = labelled(seed, n)
    rows = [(i, t, "en", rng.choice(["a", "b", "b", "b", None]), len(t)) for i, t, _ in made]
    for k in range(80):
        i, t, *_ = rng.choice(rows[:n])
        t = t.replace(" ", "  ", 2) if k % 2 else " ".join(w if rng.random() > 0.02 else "changed" for w in t.split())
        rows.append((n + k, t, "en", rng.choice("ab"), len(t)))
    rows += [(9000, None, None, None, None), (9001, "", "en", "a", 0), (9002, " ", "en", "b", 1), rows[3], rows[3]]
    return rows, [(i, y, y) for i, _, y in made]


def targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    budget = 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        level = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = rows_of()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for name, stage in P.STAGES:
        before = docs
        docs = P.C.materialize(stage(spark, docs, str(tmp_path)))
        found[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
        assert name == "bpe" or docs.columns == before.columns
    key = lambda r: str(tuple(r))

    before, after = found["toxicity"]
    model = toxicity.fit_on(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score = dict(zip(before, toxicity.score_texts([r[1] or "" for r in before], model)))
    assert sorted(after, key=key) == sorted((r for r in before if score[r] < 0.3), key=key)
    assert len(after) < len(before) - 40

    before, after = found["exact_dedup"]
    groups = defaultdict(list)
    for r in set(before):
        groups["".join(WORD.findall(r[1] or ""))].append(r)
    assert sorted(after, key=key) == sorted((min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()), key=key)

    before, after = found["minhash_dedup"]
    kept = {r[0] for r in near([(r[0], r[1]) for r in before]) if r[3]}
    assert sorted(after, key=key) == sorted((r for r in before if r[0] in kept), key=key) and len(after) < len(before)

    before, after = found["mixing"]
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes = Counter()
    for r in before:
        sizes[r[3]] += size(r)
    want, taken = targets(sizes), Counter()
    for r in after:
        taken[r[3]] += size(r)
    most = {s: max(size(r) for r in before if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes) and math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))
    assert max(Counter(after).values()) <= 2 and set(after) <= set(before)

    before, after = found["bpe"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = lambda r: t.encode(r[1] or "", add_special_tokens=False).ids
    assert sorted(after, key=key) == sorted(((r[0], len(ids(r)), sha(np.array(ids(r), "<u4").tobytes()), sha((r[1] or "").encode()), ids(r)) for r in before), key=key)
    assert sorted((tuple(r) for r in P.run(spark, str(tmp_path)).collect()), key=key) == sorted(after, key=key)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_columns_of_clashing_names(spark, tmp_path):
    rows, labels = rows_of(9, 60)
    taken = ["score", "held_out", "position", "tie", "_tie", "kept", "ord"]
    schema = SCHEMA + "".join(f", {c} string" for c in taken)
    made = [(*r, *(f"{c} {r[0]}" for c in taken)) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(made, schema)
    for name, stage in P.STAGES[:-1]:
        docs = P.C.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == schema.replace(",", "").split()[::2]
        assert {tuple(r) for r in docs.collect()} <= set(made), name
    assert docs.count() > 20
