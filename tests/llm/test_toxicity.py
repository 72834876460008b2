import random
import zlib

import zstandard

from spindle.llm import toxicity as X

SCHEMA = "doc_id long, text string, score string, held_out long"
MARKS = ["gruffle", "snorbat", "plixer", "vomtag"]


def make(seed, n):
    rng = random.Random(seed)
    part = ["an", "er", "in", "th", "ou", "re", "on", "ti", "es", "or", "st"]
    word = lambda: "".join(rng.choices(part, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w, y = [word() for _ in range(rng.randint(5, 120))], int(i % 6 == 0)
        for _ in range(y * rng.randint(1, 5)):
            w.insert(rng.randrange(len(w)), rng.choice(MARKS) + rng.choice(["", "er"]))
        rows.append((i, " ".join(w).capitalize() + ".", y))
    return rows


def test_held_out_accuracy(spark):
    rows = make(1, 900)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(5000, None, "x", 1), (5001, "", "y", 2), (None, "than there", "z", 3), (None, "than there", "z", 3)], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = X.toxicity(docs, X.fit_on(docs, labels, most=300))
    assert found.columns == ["doc_id", "text", "score", "held_out", "predicted"]
    found = found.collect()
    assert len(found) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    label = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out and r.doc_id in label]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    caught = [r.predicted for r in held if label[r.doc_id]]
    wrong = [r.predicted for r in held if not label[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.05 * len(wrong)
    assert not any(r.predicted for r in found if not r.text)


def test_held_out_labels_change_nothing(spark):
    rows = make(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    a, b = (X.fit_on(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")) for f in (lambda i, y: y, flip))
    assert a == b


def test_one_class_and_nothing(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.predicted for r in X.toxicity(docs, X.fit_on(docs, none)).collect())
    assert X.toxicity(docs.limit(0), X.fit_on(docs, none)).count() == 0
    assert X.fit([("a b c", 0), ("d e f", 0)]).weights[0] < 0


def test_both_dictionaries_are_trained(monkeypatch):
    seen, real = [], zstandard.train_dictionary

    def spy(size, samples, **options):
        seen.append((size, b" ".join(samples)))
        return real(size, samples, **options)

    monkeypatch.setattr(zstandard, "train_dictionary", spy)
    model = X.fit([(t, y) for _, t, y in make(3, 900)])
    assert len(seen) == 7 and model.ordinary != model.toxic
    # the last two are the pair that counts: ordinary, then toxic windows
    assert b"gruffle" in seen[-1][1] and b"gruffle" not in seen[-2][1] and b"gruffle" in model.toxic and b"gruffle" not in model.ordinary


def test_gains_are_compressed_lengths():
    model = X.fit([(t, y) for _, t, y in make(4, 600)])
    texts = ["", "one", "Gruffle and SNORBATER on\tthe way\nhome again", "x" * 5000, " \n ", "a b c d"]
    data, start, length, count = X.windows(texts, 4, 2)
    assert count.tolist() == [0, 1, 3, 52, 0, 1]
    shown = [data[a : a + n] for a, n in zip(start, length)]
    assert shown[:4] == [b"one", b"gruffle and snorbater on", b"snorbater on the way", b"the way home again"]
    found = X.gains(data, start, length, model.ordinary, model.toxic)
    size = lambda w, d: len(X._compressor(d).compress(w + X.CARRIER))
    assert found.tolist() == [size(w, model.ordinary) - size(w, model.toxic) for w in shown]


def test_slices_change_nothing(monkeypatch):
    model = X.fit([(t, y) for _, t, y in make(5, 300)])
    texts = [" ".join(t for _, t, _ in make(6, 400)), "short", "", "gruffle plixer vomtag"]
    whole = X.score_texts(texts, model)
    monkeypatch.setattr(X, "SLICE", 37)
    assert (X.score_texts(texts, model) == whole).all() and (X.score_texts(texts[::-1], model)[::-1] == whole).all()


def test_few_samples_are_trained_on_by_zstandard(monkeypatch):
    seen, real = [], zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples, **o: seen.append(len(samples)) or real(size, samples, **o))
    few = [b"gruffle snorbat plixer", b"vomtag and gruffle again"]
    assert b"gruffle" in X._trained(few, 4096, 24) and len(seen) > 1 and X._trained([], 4096, 24) == b""
    model = X.fit([("gruffle plixer snorbat", 1), ("the other one in thoure", 0), ("gruffle vomtag", 1), ("an inter on tion", 0)])
    assert all(0 <= s <= 1 for s in X.score_texts(["", "gruffle"], model))


def test_settings_are_compared_on_folds():
    rows = [(t, y) for _, t, y in make(7, 500)]
    narrow, wide = X.compare(rows, [{"width": 2, "step": 1}, {"width": 40, "step": 20}], prior=1 / 6)
    assert 0 < narrow < wide
    # labels that say nothing can't be learnt
    rng = random.Random(1)
    assert X.compare([(t, rng.randrange(2)) for t, _ in rows], [{}], prior=0.5)[0] > 0.6
