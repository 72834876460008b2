"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

``fit`` counts words and word pairs. Counts are quantised to powers of two; an n-gram of level q is in the filter
once for each of 1..q, and probing levels until one is missing gives its count back, a little too high now
and then but never lost. The filter is in segments, one for each bucket of keys, and each has ``BITS`` bits for
every entry it holds, so its error doesn't grow with the corpus.

``score`` scores any table with a model. A filter of at most ``BROADCAST`` bytes goes to all workers, which probe it
text by text; a larger one stays in its table and probes travel to its segments, with the same results. Exact counts
of rare words, for the unigram base alone, are asked for in the same way. Probes and answers are packed, a row for each
batch of texts and group of buckets, and of a pair only what the filter looks at goes along: its bucket and 32 bits. Pair probabilities are smoothed with word probabilities.

Very frequent words, picked from a bounded sample, are counted in a table of fixed size, so none of them fills a bucket.
A batch of texts deals its counts to at most ``FAN`` groups of buckets and what meets there is added up before it goes
on to its buckets, so rows grow with the corpus and not with its square.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The token after the last word of a text, also the history of the first.
END = np.uint64(0x5BD1E995C0FFEE11)
PROBES = 3
#: Bits of a segment for each entry, a key at a level.
BITS = 8
#: A larger filter is not broadcast.
BROADCAST = 64 << 20
#: Buckets that a batch deals its counts to at once; more buckets are reached in a second step.
FAN = 256
WORDS, PAIRS, HOT, SEGMENT, SUMS = range(5)
COUNTED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
TEXTS = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "tokens", "lengths", "words"))])
ASKED = pa.schema([("group", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
ANSWERED = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("group", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
ROW, TEXT = "bucket int, kind int, a binary, b binary", "batch long, ids binary, nulls binary, tokens binary, lengths binary, words binary"
ASK, ANSWER = "group int, batch long, kind int, bucket int, a binary, b binary", "batch long, kind int, group int, a binary, b binary"


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts end to end, and the n + 1 places where texts begin; about a megabyte is worked on at a time."""
    found, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in C.chunks(texts, 1 << 20):
        words = C.Words(texts[lo:hi], lower=True)
        ends = words.first[1:]
        found.append(np.insert(words.hashes(), ends, END))
        first.append(ends + np.arange(1, hi - lo + 1) + first[-1][-1])
    return np.concatenate(found), np.concatenate(first)


def pieces(texts: pa.Array, limit: int = 6 << 20):
    """Where each run of texts of about limit bytes begins and ends, and its texts; a longer text is a run of its own."""
    lo, total = 0, 0
    for i, n in enumerate([*pc.binary_length(texts).to_pylist(), limit]):
        if i == len(texts) or total and total + n > limit:
            if i > lo:
                yield lo, i, texts.slice(lo, i - lo).to_pylist()
            lo, total = i, 0
        total += n


def pair_hashes(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's history, and the hash of history and token."""
    before = np.concatenate([[END], found[:-1]]).astype(np.uint64)
    before[first[:-1]] = END
    return before, C.mix64(before * C._LONG_STEP + found)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Filter:
    """Segments of bits, one for each bucket of keys: (bits, their number, largest level stored) of each."""

    def __init__(self, segments: list[tuple[bytes, int, int]]):
        self.n = len(segments)
        self.bits = np.frombuffer(b"".join(s[0] for s in segments), np.uint8)
        self.start = (np.cumsum([0, *(len(s[0]) for s in segments)])[:-1] * 8).astype(np.uint64)
        self.size, self.top = np.array([s[1] for s in segments], np.uint64), np.array([s[2] for s in segments], np.int64)

    @staticmethod
    def places(fingerprint: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
        """The bits of a segment that stand for a fingerprint at a level, one column a probe."""
        h = C.mix64(fingerprint * C._STEP + np.full(1, level, np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % size[:, None]

    @classmethod
    def segment(cls, fingerprints: np.ndarray, counts: np.ndarray) -> tuple[bytes, int, int]:
        top, level = np.frexp(counts.astype(np.float64))[1], 1
        size = max(64, -(-BITS * int(top.sum()) // 8) * 8)
        bits = np.zeros(size, np.uint8)
        while (own := fingerprints[top >= level]).size:
            bits[cls.places(own, level, np.full(1, size, np.uint64))] = 1
            level += 1
        return np.packbits(bits).tobytes(), size, int(top.max(initial=0))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level q for which all of 1..q are there; 0 for none."""
        return self.levels_in((keys % np.uint64(self.n)).astype(np.int64), keys >> np.uint64(32))

    def levels_in(self, of: np.ndarray, own: np.ndarray) -> np.ndarray:
        """``levels`` of fingerprints, each in the segment that of numbers."""
        out, left, level = np.zeros(len(own), np.int64), np.arange(len(own)), 1
        start, size, top = self.start[of], self.size[of], self.top[of]
        while (left := left[top[left] >= level]).size:
            places = self.places(own[left], level, size[left])
            for k in range(PROBES):
                at = start[left] + places[:, k]
                hit = (self.bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                left, places = left[hit], places[hit]
            out[left] = level
            level += 1
        return out


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for."""
    return np.where(levels > 0, np.floor(1.5 * 2.0 ** (levels - 1)), 0.0)


@dataclass(frozen=True)
class Model:
    """What fit learnt, in a table of the shared folder, and numbers of bounded size.

    ``table`` has the filter's segments and packed exact word counts by bucket; ``hot`` and ``hot_counts`` are the
    frequent words. ``false_positives`` is the share of absent n-grams that the filter takes for known, by probing
    each segment with as many as it has entries.
    """

    table: DataFrame
    hot: np.ndarray
    hot_counts: np.ndarray
    n_buckets: int
    tokens: int
    vocab: int
    n_bytes: int
    false_positives: float

    def filter(self) -> Filter:
        """The whole filter; for the driver only if ``n_bytes`` is bounded."""
        segments = [(bytes(8), 64, 0)] * self.n_buckets
        for r in self.table.filter(F.col("kind") == SEGMENT).toLocalIterator():
            segments[r.bucket] = (bytes(r.a), *(int(x) for x in np.frombuffer(r.b, np.int64)))
        return Filter(segments)


def frequent_words(docs: DataFrame, n: int, sample: int) -> np.ndarray:
    """Sorted hashes of END and the n most frequent words of about ``sample`` rows of docs (text), picked by hash (``common.by_share``).

    The choice only says which counts travel in the fixed table; every result is the same for any choice but for
    levels that the filter has too high. Each task counts its own part of the sample, so no text is moved.
    """
    schema = "key long, n long"

    def run(batches):
        for batch in batches:
            for _, _, texts in pieces(batch.column(0)):
                keys, counts = np.unique(tokens(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    rows = C.by_share(docs, F.col("text"), sample).select("text")
    top = rows.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(n).collect()
    return np.unique(np.append(np.array([r.key for r in top], np.int64).view(np.uint64), END))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts."""
    own, n = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(own)
    own, n = own[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.add.reduceat(n, first) if len(own) else n


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys, packed."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def keys_of(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def placed(pairs: np.ndarray, n_buckets: int, groups: int) -> np.ndarray:
    """All that the filter asks of pairs: group of buckets (16 bits), place of the bucket in the group (16) and fingerprint (32).

    A bucket's keys then differ in 32 bits of 64, so they take half the room on their way.
    """
    bucket = pairs % np.uint64(n_buckets)
    return bucket % np.uint64(groups) << np.uint64(48) | bucket // np.uint64(groups) << np.uint64(32) | pairs >> np.uint64(32)


def by_group(place: np.ndarray) -> list[tuple[int, int, int]]:
    """Each group of sorted places, where it begins and where it ends."""
    group = (place >> np.uint64(48)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    return [(int(group[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(group)])]


IN_GROUP = np.uint64((1 << 48) - 1)
PRINT = np.uint64((1 << 32) - 1)


def _packed(bucket: np.ndarray, kind: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """A row for each bucket with its keys, which are sorted, as steps, and their counts."""
    return [(b, kind, steps(keys[i]), pack(counts[i].astype(np.int64))) for b, i in C.deal(bucket, 0)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def counted(docs: DataFrame, hot: np.ndarray, n_buckets: int, fan: int = FAN) -> DataFrame:
    """Of every bucket its segment of the filter, packed word counts and sums; of every task the counts of frequent words. docs: text.

    Sums are the numbers of words, of their tokens, of absent keys that were probed, and of those that the filter takes for known.
    """
    groups = min(n_buckets, fan)

    def spread(batches):
        frequent = np.zeros(len(hot), np.int64)
        for batch in batches:
            for _, _, texts in pieces(batch.column(0)):
                found, first = tokens(texts)
                at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                is_hot = hot[at] == found
                frequent += np.bincount(at[is_hot], minlength=len(hot))
                place, counts = np.unique(placed(pair_hashes(found, first)[1], n_buckets, groups), return_counts=True)
                rows = [(g, PAIRS, steps(place[a:b] & IN_GROUP), pack(counts[a:b].astype(np.int64))) for g, a, b in by_group(place)]
                keys, counts = np.unique(found[~is_hot], return_counts=True)
                rows += _packed((keys % np.uint64(n_buckets)).astype(np.int64) % groups, WORDS, keys, counts)
                if rows:
                    yield _batch(rows, COUNTED)
        yield _batch([(TaskContext.get().partitionId() % groups, HOT, frequent.tobytes(), b"")], COUNTED)

    def regroup(batches):
        held, size, now = [], 0, None

        def flush():
            keys, counts = _added([keys_of(a) for a, _ in held], [unpack(b, np.int64) for _, b in held])
            if now[1] == PAIRS:
                return _batch(_packed((keys >> np.uint64(32)).astype(np.int64) * groups + now[0], PAIRS, keys & PRINT, counts), COUNTED)
            return _batch(_packed((keys % np.uint64(n_buckets)).astype(np.int64), WORDS, keys, counts), COUNTED)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[1] == HOT:
                    yield _batch([r], COUNTED)
                    continue
                if held and (now != r[:2] or size > 32 << 20):
                    yield flush()
                    held, size = [], 0
                now, size = r[:2], size + len(r[2])
                held.append(r[2:])
        if held:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        rows = [tuple(r.values()) for r in table.to_pylist()]
        bucket = rows[0][0]
        of = lambda kind: _added([keys_of(r[2]) for r in rows if r[1] == kind], [unpack(r[3], np.int64) for r in rows if r[1] == kind])
        (word, count), (pair, seen) = of(WORDS), of(PAIRS)
        prints = np.concatenate([word >> np.uint64(32), pair])
        bits, size, top = Filter.segment(prints, np.concatenate([count, seen]))
        absent = C.mix64(prints * C._LONG_STEP) >> np.uint64(32)
        absent = absent[~np.isin(absent, prints)]
        false = Filter([(bits, size, top)]).levels(absent << np.uint64(32)) > 0
        out = [r for r in rows if r[1] == HOT]
        out.append((bucket, SEGMENT, bits, np.array([size, top], np.int64).tobytes()))
        out.append((bucket, WORDS, steps(word), pack(count)))
        out.append((bucket, SUMS, np.array([len(word), count.sum(), len(absent), false.sum()], np.int64).tobytes(), b""))
        return pa.Table.from_batches([_batch(out, COUNTED)])

    rows = docs.select("text").mapInArrow(spread, ROW)
    if groups < n_buckets:
        n = min(groups, C.partitions(docs.sparkSession))
        rows = rows.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket", "kind").mapInArrow(regroup, ROW)
    return C.by_bucket(rows, n_buckets, settle, ROW)


def _sums(table: DataFrame, kind: int, n: int) -> np.ndarray:
    """The sum of all rows of a kind, each n numbers; n rows come to the driver."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for a in batch.column(0).to_pylist():
                total += np.frombuffer(a, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total)], names=["k", "n"])

    out = np.zeros(n, np.int64)
    for r in table.filter(F.col("kind") == kind).select("a").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def fit(docs: DataFrame, text_col: str = "text", frequent: int = 1 << 16, sample: int = 4000, n_buckets: int | None = None, fan: int = FAN) -> Model:
    """A model of all texts of docs, of any length; null counts as empty, and a text without words has its end token only.

    Identical rows are learnt from each for itself. An empty table gives a model that knows nothing.
    """
    texts = docs.select(C.text_or_empty(text_col).alias("text"))
    if n_buckets is None:
        n_buckets = max(C.partitions(docs.sparkSession), -(-int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (64 << 20)))
    hot = frequent_words(texts, frequent, sample)
    table = C.materialize(counted(texts, hot, n_buckets, fan))
    hot_counts, sums = _sums(table, HOT, len(hot)), _sums(table, SUMS, 4)
    n_bytes = int(table.filter(F.col("kind") == SEGMENT).agg(F.sum(F.octet_length("a"))).first()[0] or 0)
    return Model(table, hot, hot_counts, n_buckets, int(sums[1] + hot_counts.sum()), int(sums[0] + (hot_counts > 0).sum()), n_bytes, float(sums[3] / max(1, sums[2])))


def _found(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys among known ones, which are sorted; 0 for others."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = 4.0, broadcast: int = BROADCAST) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A pair's probability is (count(h, w) + weight * p(w)) / (count(h) + weight), with
    p(w) = (count(w) + 1) / (N + V + 1), from the filter; the levels of the frequent words come from their own
    table. Null and empty texts have the end token only; a very long text is a batch of its own. Repeated rows stay; an empty table gives an empty result.
    A filter of more than ``broadcast`` bytes is probed where its segments are.
    """
    spark, hot, hot_counts, n_buckets = docs.sparkSession, model.hot, model.hot_counts, model.n_buckets
    n_tokens, vocab = model.tokens, model.vocab
    whole = spark.sparkContext.broadcast(model.filter()) if model.n_bytes <= broadcast else None
    probed = whole is None

    groups = min(n_buckets, FAN)

    def spread(batches):
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, texts in pieces(batch.column(1)):
                found, first = tokens(texts)
                own = batch.column(0).slice(lo, hi - lo)
                at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                other = hot[at] != found
                words, which = np.unique(found[other], return_inverse=True)
                at[other] = len(hot) + which.reshape(-1)
                yield _batch([(name, own.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), np.array(own.is_null()).astype(np.uint8).tobytes(), pack(at.astype(np.uint32)), pack(np.diff(first)), steps(words))], TEXTS)
                name += 1

    def read(tokens: bytes, lengths: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of a batch's tokens, where texts begin, its words that aren't frequent, in which order they are asked for, and hashes of its pairs."""
        at, first, own = unpack(tokens, np.uint32), np.cumsum([0, *unpack(lengths, np.int64)]), keys_of(words)
        order = np.argsort((own % np.uint64(n_buckets)).astype(np.int64) % groups, kind="stable")
        return at, first, own, order, pair_hashes(np.concatenate([hot, own])[at], first)[1]

    def ask(batches):
        for batch in batches:
            for name, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                _, _, words, _, pairs = read(*packed)
                rows = [(g, name, WORDS, None, steps(words[i]), None) for g, i in C.deal((words % np.uint64(n_buckets)).astype(np.int64) % groups, 0)]
                if probed:
                    place = np.unique(placed(pairs, n_buckets, groups))
                    rows += [(g, name, PAIRS, None, steps(place[a:b] & IN_GROUP), None) for g, a, b in by_group(place)]
                if rows:
                    yield _batch(rows, ASKED)

    def answer(batches):
        """Rows of a group: first what the model has of its buckets, then what batches ask, which is answered row by row."""
        now, segments, known, own = None, {}, [], None
        for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
            out = []
            for group, name, kind, bucket, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now:
                    now, segments, known, own = group, {}, [], None
                if name < 0:
                    if kind == SEGMENT:
                        segments[bucket // groups] = (a, *(int(x) for x in np.frombuffer(b, np.int64)))
                    else:
                        known.append((keys_of(a), unpack(b, np.int64)))
                    continue
                if own is None:
                    own = Filter([segments.get(k, (bytes(8), 64, 0)) for k in range(-(-(n_buckets - group) // groups))])
                    key, n = _added([k for k, _ in known], [n for _, n in known])
                    segments, known = {}, []
                keys = keys_of(a)
                if kind == WORDS:
                    levels = own.levels_in(((keys % np.uint64(n_buckets)) // np.uint64(groups)).astype(np.int64), keys >> np.uint64(32))
                    out.append((name, kind, group, pack(levels.astype(np.uint8)), pack(_found(keys, key, n))))
                else:
                    levels = own.levels_in((keys >> np.uint64(32)).astype(np.int64), keys & PRINT)
                    out.append((name, kind, group, pack(levels.astype(np.uint8)), b""))
            if out:
                yield _batch(out, ANSWERED)

    def scored(text: pa.Table, answers: pa.Table) -> pa.Table:
        (own,) = text.to_pylist()
        rows = sorted(answers.select(["kind", "group", "a", "b"]).to_pylist(), key=lambda r: r["group"])
        of = lambda kind, c, t: np.concatenate([np.zeros(0, t), *(unpack(r[c], t) for r in rows if r["kind"] == kind)]).astype(np.int64)
        at, first, words, order, pairs = read(own["tokens"], own["lengths"], own["words"])
        asked = np.argsort(order)
        level = np.concatenate([np.frexp(hot_counts.astype(np.float64))[1].astype(np.int64), of(WORDS, "a", np.uint8)[asked]])[at]
        exact = np.concatenate([hot_counts, of(WORDS, "b", np.int64)[asked]])[at]
        count = counts_of(level)
        of_before = np.concatenate([[0.0], count[:-1]])
        of_before[first[:-1]] = counts_of(np.frexp(hot_counts[hot == END].astype(np.float64))[1])[0]
        pair, which = np.unique(placed(pairs, n_buckets, groups) if probed else pairs, return_inverse=True)
        both = counts_of(of(PAIRS, "a", np.uint8) if probed else whole.value.levels(pair))[which.reshape(-1)]
        single = (count + 1) / (n_tokens + vocab + 1)
        p = np.minimum(1.0, (both + weight * single) / (np.maximum(of_before, both) + weight))
        total_of = lambda x: np.add.reduceat(x, first[:-1])
        base = total_of(np.log10(exact + 1.0)) - np.diff(first) * np.log10(n_tokens + vocab + 1.0)
        ids = pa.array(np.frombuffer(own["ids"], np.int64), mask=np.frombuffer(own["nulls"], np.uint8).astype(bool))
        return pa.table({"doc_id": ids, "n_tokens": np.diff(first).astype(np.int64), "n_known": total_of((exact > 0).astype(np.int64)), "base_score": base, "score": total_of(np.log10(p))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"))
    found = C.materialize(rows.mapInArrow(spread, TEXT))
    asks = found.select("batch", "tokens", "lengths", "words").mapInArrow(ask, ASK)
    held = model.table.filter(F.col("kind").isin(SEGMENT, WORDS)).select((F.col("bucket") % groups).alias("group"), F.lit(-1).cast("long").alias("batch"), "kind", "bucket", "a", "b")
    n = min(groups, C.partitions(spark))
    dealt = held.unionByName(asks).repartitionById(n, (F.col("group") % n).cast("int")).sortWithinPartitions("group", "batch")
    answers = dealt.mapInArrow(answer, ANSWER)
    out = found.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, weight: float = 4.0, broadcast: int = BROADCAST, **options) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A model is fitted (``options``, see ``fit``) on texts of which crc32 of the id as text doesn't leave 2 on division by ``folds``
    (a null id is learnt from), and scores all. Nulls, repeats, long texts and empty tables: as ``fit`` and ``score`` have them.
    """
    model = fit(docs.filter(~C.held_out(id_col, folds)), text_col, **options)
    out = score(model, docs, id_col, text_col, weight, broadcast)
    return out.select("doc_id", C.held_out("doc_id", folds).alias("held_out"), *out.columns[1:])
