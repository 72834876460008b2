"""Toxicity by compression distance: windows of words, compressed with zstandard dictionaries of toxic and of ordinary text.

All dictionaries are trained with zstandard. A large one of ordinary text is the common ground. A first small pair,
one of toxic and one of ordinary text, is trained on one half of each class and shows which windows of the other half
its own class serves better; on those the pair that counts is trained. A window's gain is the number of bytes
by which it gets shorter with the toxic dictionary than with the ordinary one, each followed by the common ground.
A logistic calibration over the gains of a text, fitted on labelled texts that trained no dictionary, gives its score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Words of a window, and words from one window to the next. ``compare`` chose them, and the sizes in ``fit``, by folds
#: of rows that may be learnt from.
WIDTH, STEP = 2, 1
#: Longer words count as several, of so many bytes.
WORD = 48
#: Follows every window and every dictionary, so that short windows can be compressed at all.
CARRIER = b" " + bytes(range(1, 9)) * 4
#: Windows compressed at a time, which bounds memory for texts of any length.
SLICE = 1 << 15
#: Gains that are counted, and losses.
GAINS, LOSSES, TOP = range(1, 8), range(1, 5), 5


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    width: int = WIDTH
    step: int = STEP


def windows(texts: list[str], width: int = WIDTH, step: int = STEP) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts in lower case, one blank between; where windows start and how long they are; each text's number of windows.

    A text of fewer words than a window has one window, one without words none. Windows reach a text's last word.
    """
    # a word of one text is never in a window with a word of another, as windows are laid text by text
    words = [[p for w in t.lower().encode("utf-8").split() for p in ([w] if len(w) <= WORD else [w[i : i + WORD] for i in range(0, len(w), WORD)])] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    data = b" ".join(w for own in words for w in own)
    lengths = np.fromiter((len(w) for own in words for w in own), np.int64, int(n.sum()))
    ends = np.cumsum(lengths + 1) - 1
    count = np.where(n > 0, np.maximum(0, -(-(n - width) // step)) + 1, 0)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(np.cumsum(n) - n, count)
    last = np.minimum(first + place * step + width, np.repeat(np.cumsum(n), count)) - 1
    first = first + place * step
    start = ends[first] - lengths[first]
    return data, start, ends[last] - start, count


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=17, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
    content = zstandard.ZstdCompressionDict(dictionary + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=content)


def gains(data: bytes, start: np.ndarray, length: np.ndarray, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes by which each window, with the carrier behind it, gets shorter with the toxic dictionary than with the ordinary one."""
    raw, out = np.frombuffer(data, np.uint8), [np.zeros(0, np.int64)]
    for lo in range(0, len(start), SLICE):
        at, own = start[lo : lo + SLICE], length[lo : lo + SLICE]
        size = own + len(CARRIER)
        begin = np.cumsum(size) - size
        packed = raw[np.minimum(np.repeat(at - begin, size) + np.arange(size.sum()), len(raw) - 1)]
        for k, byte in enumerate(CARRIER):
            packed[begin + own + k] = byte
        both = zstandard.BufferWithSegments(packed.tobytes(), np.column_stack([begin, size]).astype("<u8").tobytes())
        sizes = [np.array([len(found[i]) for i in range(len(found))]) for found in (_compressor(d).multi_compress_to_buffer(both, threads=1) for d in (ordinary, toxic))]
        out.append(sizes[0] - sizes[1])
    return np.concatenate(out)


def features(gain: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row for each text: its largest gains, how many and what share of its windows gain and lose so many bytes, and products of them."""
    text = np.repeat(np.arange(len(count)), count)
    number = lambda mask: np.bincount(text[mask], minlength=len(count)).astype(float)
    order = np.lexsort((-gain, text))
    place = np.arange(len(gain)) - np.repeat(np.cumsum(count) - count, count)
    top = np.zeros((len(count), TOP))
    top[text[order][place < TOP], place[place < TOP]] = np.maximum(0, gain[order][place < TOP])
    more, less = np.column_stack([number(gain >= k) for k in GAINS]), np.column_stack([number(gain <= -k) for k in LOSSES])
    n = count.astype(float)[:, None]
    share = lambda x: np.log((x + 0.2) / (n + 4))
    size, some = np.log1p(n), np.log1p(more)
    mean = np.bincount(text, gain, len(count))[:, None] / (n + 4)
    return np.column_stack([
        np.ones(len(count)), top[:, 0], top[:, :3].mean(axis=1), top.mean(axis=1), some, share(more), share(less), np.log1p(less), mean, size,
        share(more)[:, :5] * size, share(more)[:, :5] ** 2, some[:, 1:5] * size])


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    """Scores from 0 to 1."""
    out = [np.zeros(0)]
    for lo, hi in C.chunks(texts, 1 << 20):
        data, start, length, count = windows(texts[lo:hi], model.width, model.step)
        z = features(gains(data, start, length, model.ordinary, model.toxic), count) @ np.array(model.weights)
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out)


# ------------------------------------------------------------------ fitting


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary of at most size bytes trained on the samples, repeated until zstandard has enough to train on; nothing without samples."""
    samples = [s for s in samples if len(s) >= 8]
    for times in (1, 4, 16, 64, 256, 1024) if samples else ():
        try:
            raw = zstandard.train_dictionary(size, samples * times, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            continue
        return raw[-min(len(raw), int(size * 0.97)) :]  # entropy tables come first
    return b""


def _pieces(texts: list[str], size: int = 512) -> list[bytes]:
    return [raw[i : i + size] for raw in (t.lower().encode("utf-8") for t in texts) for i in range(0, len(raw), size)]


def _served(texts: list[str], own: bytes, other: bytes, least: int = 2) -> list[bytes]:
    """Of each text the windows of three words that get shorter with its own dictionary than with the other by so many bytes."""
    out = []
    for lo, hi in C.chunks(texts, 1 << 20):
        data, start, length, count = windows(texts[lo:hi], 3, 1)
        good = np.flatnonzero(gains(data, start, length, other, own) >= least)
        text = np.repeat(np.arange(len(count)), count)[good]
        for own_windows in np.split(good, np.flatnonzero(np.diff(text)) + 1) if len(good) else []:
            raw = b" ".join(data[start[j] : start[j] + length[j]] for j in own_windows)
            out += [b" " + raw[i : i + 4096] + b" " for i in range(0, len(raw), 4096)]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression on standardised columns, by Newton's method; the first column is constant."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    middle[0], spread[0] = 0, 1
    x = (x - middle) / spread
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    w[0] -= middle[1:] @ w[1:]
    return w


def fit(rows: list[tuple[str, int]], ground: int = 32 << 10, first: int = 16 << 10, size: int = 4 << 10, prior: float | None = None, width: int = WIDTH, step: int = STEP) -> Model:
    """A model from (text, toxic) rows. Two thirds train the dictionaries, the rest the calibration.

    ground, first and size are the bytes of the common ground, of the first pair and of the pair that counts, width and
    step shape the windows. ``prior`` is the share
    of toxic texts where the model will be used; None takes the share in rows. A text with both labels counts as
    toxic. With no toxic or no ordinary rows every score is the label they have.
    """
    rows = sorted({t: y for t, y in sorted(rows) if t}.items())
    if len({y for _, y in rows}) < 2:
        known = rows[0][1] if rows else 0
        return Model(b" ", b" ", (30.0 if known else -30.0, *[0.0] * (features(np.zeros(0, int), np.zeros(1, int)).shape[1] - 1)))
    fold = lambda t, n: zlib.crc32(t.encode()) % n
    train = [(t, y) for t, y in rows if fold(t, 3)]
    if len({y for _, y in train}) < 2:
        train = rows
    of = lambda y, half=None: [t for t, label in train if label == y and (half is None or fold(t[::-1], 2) == half)]
    common = _trained(_pieces(of(0)), ground, 64)
    served: tuple[list[bytes], list[bytes]] = ([], [])
    for half in (0, 1):
        pair = [_trained(_pieces(of(y, half)), first, 24) + common for y in (0, 1)]
        for y in (0, 1):
            served[y].extend(_served(of(y, 1 - half), pair[y], pair[1 - y]))
    ordinary, toxic = (_trained(served[y] or _pieces(of(y)), size, 24) + common for y in (0, 1))
    rest = [(t, y) for t, y in rows if not fold(t, 3)]
    if len({y for _, y in rest}) < 2:
        rest = rows
    share = sum(y for _, y in rest) / len(rest)
    prior = sum(y for _, y in rows) / len(rows) if prior is None else min(max(prior, 1e-4), 1 - 1e-4)
    # short ordinary pieces as well, and nothing at all, so that little text is little evidence
    rest = rest + [(" ".join(t.split()[: fold(t, 24)]), 0) for t, y in rest if not y] + [("", 0)]
    data, start, length, count = windows([t for t, _ in rest], width, step)
    w = _logistic(features(gains(data, start, length, ordinary, toxic), count), np.array([y for _, y in rest], float))
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(ordinary, toxic, tuple(w.tolist()), width, step)


def compare(rows: list[tuple[str, int]], settings: list[dict], prior: float, folds: int = 3) -> list[float]:
    """For each of the settings, which are arguments of ``fit``, the log loss on folds of rows that it wasn't fitted on, both classes weighed by prior.

    rows are those that may be learnt from, as ``fit`` takes them; held-out rows have no part in a choice.
    """
    fold = lambda t: zlib.crc32(b"fold" + t.encode()) % folds
    y = np.array([y for _, y in rows])
    weigh = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    losses = []
    for own in settings:
        score = np.zeros(len(rows))
        for k in range(folds):
            model = fit([(t, y) for t, y in rows if fold(t) != k], prior=prior, **own)
            at = [i for i, (t, _) in enumerate(rows) if fold(t) == k]
            score[at] = score_texts([rows[i][0] for i in at], model)
        p = np.clip(np.where(y == 1, score, 1 - score), 1e-6, 1)
        losses.append(float((weigh * -np.log(p)).mean()))
    return losses


def fit_on(docs: DataFrame, labels: DataFrame, folds: int = 4, most: int = 2000, longest: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted on at most ``most`` labelled texts of each class, those of least hash of the id, of at most ``longest`` characters each.

    Rows whose crc32 of the id as text leaves 2 on division by ``folds`` are held out. Null labels and ids are left
    out; of several labels of one id the highest counts. The share of toxic texts comes from all labels that may be learnt from.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~C.held_out("doc_id", folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("_toxic"))
    share = known.agg(F.avg("_toxic")).first()[0]
    # ids only, at most 2 * most of them, so the broadcast has a fixed bound
    picked = [r for y in (0, 1) for r in known.filter(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not picked:
        return fit([])
    ids = docs.sparkSession.createDataFrame([(int(r.doc_id), r._toxic) for r in picked], "_id long, _toxic int")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter(F.length("_text") <= longest)
    # of ids that repeat in docs, as many rows as were asked for
    rows = texts.join(F.broadcast(ids), "_id").orderBy(F.xxhash64("_text"), "_toxic").limit(2 * most)
    return fit([(r._text, r._toxic) for r in rows.collect()], prior=share)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs and held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Scores see the text alone; null counts as empty, and an empty text has the score of no evidence. Texts of any length
    are scored whole, in slices of windows. Columns of docs with those names are replaced. Repeated rows stay; an
    empty table gives an empty result.
    """
    taken = ("held_out", "score", "predicted")
    docs = docs.drop(*(c for c in taken if c in docs.columns))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            scores = score_texts([t or "" for t in batch.column(at).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    out = C.spread(docs).mapInArrow(run, schema)
    return out.withColumns({"held_out": C.held_out(id_col, folds), "predicted": (F.col("score") >= threshold).cast("int")})
