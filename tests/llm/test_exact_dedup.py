import hashlib
import random
import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spindle.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, norm string, name long"


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, t or ""))
    out, kept = [], set()
    for i, t in rows:
        group = groups[norm(t)]
        best = min(group)
        mine = (-len(t or ""), i is None, i or 0, t or "")
        first = mine[:3] == best[:3] and best[:3] not in kept
        if first:
            kept.add(best[:3])
        out.append((i, None if best[1] else best[2], len(group), first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, block):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, X.exact_dedup(df, block=block).drop("key_tie").collect()), key=str) == brute(rows)


def test_copies_with_other_white_space(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é\n", k=rng.choice([0, 1, 3, 7, 8, 20, 33, 150]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + k, "".join(c + " " * rng.randint(0, 2) for c in rng.choice(texts))) for k in range(120)]
    for block in (1, 8, 4096):
        check(spark, rows, block)


def test_ids_that_repeat_and_are_null(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "a  b"), (None, "a    b"), (None, None), (3, ""), (4, " \t"), (None, "only"), (None, "only"), (5, "x" * 50), (6, "x" * 50)]
    check(spark, rows, 8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", max_size=24), min_size=1, max_size=14))
def test_any_texts(spark, texts):
    check(spark, list(enumerate(texts)), 4)


def test_names_are_whole_contents(spark):
    # same length, same hash-like structure, one character apart at the end
    rows = [(i, "x" * 99 + c) for i, c in enumerate("aabbc")]
    found = X.identities(spark.createDataFrame(rows, "doc_id long, text string"), block=10).collect()
    assert len({r.name for r in found}) == 2 and len(found) == 4


def test_one_hot_text_and_nothing(spark):
    rows = [(i, "the same text again and again") for i in range(500)]
    found = X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.filter("kept").count() == 1 and found.first().group_size == 500
    assert X.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
