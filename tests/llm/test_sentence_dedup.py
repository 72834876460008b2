import random
import re

from spindle.llm import sentence_dedup as S

SCHEMA = "doc_id long, text string, ord string, at long"
RUN, LONGEST, LEAST = 3, 12, 12


def units(text):
    """Lists of (start, word) in characters."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        unit = []
        for w in re.finditer(r"[^\x20\x09-\x0D]+", line.group()):
            unit.append((line.start() + w.start(), w.group()))
            if len(unit) == LONGEST or w.group()[-1] in ".!?":
                out.append(unit)
                unit = []
        if unit:
            out.append(unit)
    return out


def brute(rows):
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, gone = {}, {}
    for d in docs:
        u = units(d[2])
        for k in range(len(u) - RUN + 1):
            key = tuple(tuple(w for _, w in x) for x in u[k : k + RUN])
            if sum(map(len, key)) >= LEAST and seen.setdefault(key, (d, k)) != (d, k):
                gone.setdefault(d, set()).update(range(k, k + RUN))
    out = []
    for i, t in rows:
        d = (i is None, i or 0, t or "")
        u, g = units(d[2]), gone.get(d, set())
        ends = [x[0][0] for x in u[1:]] + [len(d[2])]
        text = d[2] if not g else d[2][: u[0][0][0]] + "".join(d[2][x[0][0] : e] for k, (x, e) in enumerate(zip(u, ends)) if k not in g)
        out.append((i, len(u), len(g), sum(len(u[k]) for k in g), text))
    return sorted(out, key=str)


def make(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 30))) + rng.choice([". ", "! ", ".\n", "\n", " \t"])
    passages = ["".join(sentence() for _ in range(rng.randint(3, 8))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(sentence() if rng.random() < 0.8 else rng.choice(passages) for _ in range(rng.randint(0, 12)))
        rows.append((i, t))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, S.sentence_dedup(df).collect()), key=str) == brute(rows)


def test_against_brute_force(spark):
    rows = make()
    assert any(r[2] for r in brute(rows))
    check(spark, rows)


def test_ids_that_repeat_and_are_null(spark):
    # rows of one id and text are one document; other texts of an id are kept apart, so they share no passages here
    rows = make(5, 40)
    check(spark, rows + rows[:7] + [(None, rows[1][1]), (None, None), (500, None), (501, ""), (502, " \n ")])


def test_one_hot_passage(spark):
    passage = "This is the passage here. It is in every text. And all but the first lose it now. "
    check(spark, [(i, f"Own {i}. {passage}End {i}.") for i in range(300)])


def test_empty(spark):
    assert S.sentence_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_finds_a_passage_at_any_offset(spark, tmp_path):
    from spindle.llm import queries

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    for trial in range(5):
        passage = " ".join(word() for _ in range(60))
        texts = [" ".join([*(word() for _ in range(k)), passage, *(word() for _ in range(9))]) for k in range(14)]
        path = str(tmp_path / str(trial))
        spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{path}/documents.parquet")
        found = sorted(queries.op10_sentence_dedup(spark, path).collect())
        assert found[0].n_removed == 0
        # what is lost at either edge is less than two pieces
        assert all(r.n_words_removed >= 60 - 2 * 2 * LONGEST and r.n_removed >= RUN for r in found[1:])
        assert sum(r.n_words_removed for r in found[1:]) >= 13 * 42
        assert all(set(t.split()) - set(r.text.split()) <= set(passage.split()) for r, t in zip(found, texts))


def test_closing_quotes_end_sentences():
    text = 'One two." Three four.) Five ”six!” Seven。 eight. ) nine " ten'
    begins, _ = S.sentences(S.C.Words([text]), 12)
    assert [text.split()[b] for b in begins] == ["One", "Three", "Five", "Seven。", "eight.", ")"]
