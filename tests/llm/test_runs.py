import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.llm import runs


def brute(w):
    """Every run by its definition: each period's stretches, those with a smaller period left out."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)  # periods rise, so the first is the smallest
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_runs_of_small_alphabets(texts):
    assert runs.all_runs(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), min_size=1, max_size=6), st.integers(1, 3))
def test_runs_inside_repeated_passages(parts, times):
    text = [x for word, n in parts for x in word * n] * times
    assert runs.all_runs([text]) == [brute(text)]


def test_longest_previous_factors():
    rng = random.Random(3)
    for _ in range(60):
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        s = runs.Suffixes(runs.np.array([*t, -1]))
        length, source = runs.previous_factors(s.order.tolist(), s.shared().tolist())
        for i in range(len(t)):
            best = max((next((k for k in range(len(t) - i + 1) if i + k == len(t) or t[j + k] != t[i + k]), 0) for j in range(i)), default=0)
            assert length[i] == best
            if best:
                assert t[source[i] : source[i] + best] == t[i : i + best] and source[i] < i


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(None, "a a a a a a a"), (0, None), (1, ""), (2, " \t\n"), (3, "a b " * 3), (3, "a b " * 4), (3, "a b " * 4), (4, "x y\x1cz " * 7)]
    for k in range(5, 160):
        text = []
        while len(text) < rng.randrange(1, 120):
            text += [rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7))] * rng.choice([1, 1, 1, 4, 7])
        out.append((k, rng.choice([" ", "\n", "  "]).join(text)))
    return out


def test_documents(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in rows], "doc_id long, text string, n_runs string, crc double, start int")
    got = sorted((tuple(r) for r in runs.periodic_runs(docs).collect()), key=str)
    want = sorted((expected(i, t) for i, t in rows), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 20 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[5:])


def test_very_long_and_empty(spark):
    rng = random.Random(1)
    text = " ".join(["p q r"] * 40_000 + [str(rng.randrange(10**6)) for _ in range(100_000)] + ["z"] * 50_000)
    r = runs.periodic_runs(spark.createDataFrame([(7, text)], "doc_id long, text string"), repeated_tails=False).first()
    assert (r.n_runs, r.start, r.length, r.period) == (2, 220_000, 50_000, 1)
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
