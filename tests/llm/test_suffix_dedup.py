import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, items string, start long"
L = 100


def brute(rows):
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, gone = set(), {}
    for d in docs:
        raw = d[2].encode()
        mask = np.zeros(len(raw), bool)
        for s in range(len(raw) - L + 1):
            w = raw[s : s + L]
            if w in seen:
                mask[s : s + L] = True
            seen.add(w)
        gone[d] = mask
    out = []
    for i, t in rows:
        raw, mask = (t or "").encode(), gone[i is None, i or 0, t or ""]
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((i, len(raw), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    passages = [text(rng.randint(10, 60)) for _ in range(8)]
    base = text(150)
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 60)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        t = " ".join(parts)
        if i % 9 == 0:  # near copies
            x = base.split(" ")
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(len(x))] = rng.choice(words)
            t = " ".join(x)
        if i % 17 == 0:
            t += rng.choice(["a", "ab", "xyz "]) * rng.randint(50, 200)
        rows.append((i, t))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, S.suffix_dedup(df).collect()), key=str) == brute(rows)


def test_against_brute_force(spark):
    rows = make(1, 150)
    assert sum(r[2] for r in brute(rows)) > 10000
    check(spark, rows)


def test_ids_that_repeat_and_are_null(spark):
    rows = make(2, 40)
    check(spark, rows + rows[:5] + [(None, rows[1][1] * 3), (None, None), (3, "other text " * 30), (900, ""), (901, None), (902, "é" * 50), (903, "é" * 49 + "ab")])


def test_windows_that_cross_slices(spark, monkeypatch):
    rows = make(3, 30)
    data = " ".join(t for _, t in rows).encode()
    whole = S.items(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), L)
    monkeypatch.setattr(S, "SLICE", 1000)
    cut = S.items(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), L)
    owner = lambda x: dict((s + k, s + a) for s, n, a in zip(*x[:3]) for k in range(n))
    assert owner(whole) == owner(cut) and len(owner(whole)) == len(data) - L + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=30), st.randoms())
def test_deep_shallow_order(strings, rng):
    strings += [b"\0" * 60 + s for s in strings]
    width = max(map(len, strings)) or 1
    rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    group = np.array([rng.randrange(3) for _ in strings])
    order, shared = S.deep_shallow_sort(rows, np.array(list(map(len, strings))), group)
    key = [(group[i], rows[i].tobytes()) for i in order]
    assert key == sorted(key)
    for a, b, k in zip(order, order[1:], shared[1:]):
        x, y = strings[a], strings[b]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert k == (n if group[a] == group[b] else -1)


def test_empty(spark):
    assert S.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
