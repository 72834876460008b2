"""Substring deduplication over sliding spans of sentences.

A text is cut into sentences; a sentence longer than ``longest`` words counts as several, cut every ``longest``
words or, if ``steady``, where its own words say, so that a passage has the same cuts whatever stands before it. Every run of ``run``
consecutive sentences of at least ``least`` words is hashed, equal runs are found over all documents, and each
sentence that a run other than the first of its kind covers is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?")] = True
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[list(b"\"')]}")] = True
#: Closing quotes, and full stops, exclamation and question marks, of several bytes.
_LONG_CLOSES = tuple(x.encode() for x in "”’»")
_LONG_ENDS = tuple(x.encode() for x in "。！？।؟…")
#: A steady cut stands before a word whose hash is least among so many words on either side.
REACH = 3


def _ending(data: np.ndarray, ends: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """The length of the mark that stands before each end, or 0."""
    out = np.zeros(len(ends), np.int64)
    for mark in marks:
        same = ends >= len(mark)
        for k, byte in enumerate(reversed(mark), 1):
            same &= data[np.maximum(ends - k, 0)] == byte
        out[same] = len(mark)
    return out


def _stops(words: C.Words) -> np.ndarray:
    """Whether each word ends with a full stop, exclamation or question mark, or closing quotes and brackets behind one."""
    ends = words.ends.copy()
    while True:
        step = np.where(_CLOSES[words.data[ends - 1]], 1, _ending(words.data, ends, _LONG_CLOSES))
        step[ends - step <= words.starts] = 0
        if not step.any():
            return _ENDS[words.data[ends - 1]] | (_ending(words.data, ends, _LONG_ENDS) > 0)
        ends -= step


def sentences(words: C.Words, longest: int, steady: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each sentence, and the first sentence of each text (n + 1 entries).

    A sentence ends with a text, after a word that ends in a full stop, exclamation or question mark (closing quotes
    and brackets may follow), and at a line feed. Steady cuts of a long sentence stand before words of locally least
    hash, and every ``longest`` words after such a cut.
    """
    n = len(words.starts)
    first = np.zeros(n + 1, dtype=bool)
    first[words.first] = True
    feeds = np.concatenate([[0], np.cumsum(words.data == 10)])
    if n:
        first[1:n] |= _stops(words)[:-1] | (feeds[words.starts[1:]] > feeds[words.ends[:-1]])
    begins = np.flatnonzero(first[:n])
    if steady and n:
        lengths = np.diff(np.append(begins, n))
        of, left, right = words.hashes(), np.arange(n) - np.repeat(begins, lengths), np.repeat(begins + lengths, lengths) - np.arange(n)
        least = (np.repeat(lengths, lengths) > longest) & (left >= REACH) & (right > REACH)
        for k in range(1, min(REACH, n - 1) + 1):
            least[k:] &= of[k:] < of[:-k]
            least[:-k] &= of[:-k] <= of[k:]
        begins = np.flatnonzero(first[:n] | least)
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    begins = np.flatnonzero(place % longest == 0)
    return begins, np.searchsorted(begins, words.first)


def _runs(words: C.Words, run: int, longest: int, least: int, steady: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and sentence number in its text of every run that counts."""
    begins, first = sentences(words, longest, steady)
    lengths = np.diff(np.append(begins, len(words.starts)))
    hashes = C.hash_ngrams(C.hash_runs(words.hashes(), lengths), run)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.concatenate([[0], np.cumsum(lengths)])
    k = len(hashes)
    good = (text[:k] == text[run - 1 :][:k]) & (total[run:][:k] - total[:k] >= least)
    at = np.arange(k)[good]
    return hashes[good], text[:k][good], at - first[text[at]]


def repeated_runs(docs: DataFrame, n_buckets: int, run: int, longest: int, least: int, steady: bool = False) -> DataFrame:
    """ord and at of every run that is not the first of its kind.

    A task finds the repeats among its own rows and sends on one row for each distinct run, so a hot run costs a
    bucket at most one row for each batch.
    """

    def spread(batches):
        for batch in batches:
            ords, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo, hi in C.chunks(texts):
                key, text, at = _runs(C.Words(texts[lo:hi]), run, longest, least, steady)
                doc = ords[lo:hi][text] if len(text) else np.zeros(0, np.int64)
                order = np.lexsort((at, doc, key))
                key, doc, at = key[order], doc[order], at[order].astype(np.int32)
                new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
                # the same text place may come twice, from identical rows: then it is as much the first
                heads = np.flatnonzero(new)
                lead = np.repeat(heads, np.diff(np.append(heads, len(key))))
                again = ~new & ((doc != doc[lead]) | (at != at[lead]))
                rows = []
                for b, i in C.deal((key[new] % np.uint64(n_buckets)).astype(np.int64), n_buckets):
                    rows.append((b, True, key[new][i].tobytes(), doc[new][i].tobytes(), at[new][i].tobytes()))
                for b, i in C.deal(doc[again] % n_buckets, n_buckets):
                    rows.append((b, False, b"", doc[again][i].tobytes(), at[again][i].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "ask", "keys", "docs", "ats"])

    def settle(table: pa.Table) -> pa.Table:
        join = lambda name, ask, kind: np.frombuffer(b"".join(x for x, a in zip(table[name].to_pylist(), asks) if a == ask), dtype=kind)
        asks = table["ask"].to_pylist()
        key, doc, at = join("keys", True, np.uint64), join("docs", True, np.int64), join("ats", True, np.int32)
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        lead = np.repeat(heads, np.diff(np.append(heads, len(key))))
        again = (doc != doc[lead]) | (at != at[lead])
        return pa.table({"ord": np.concatenate([doc[again], join("docs", False, np.int64)]), "at": np.concatenate([at[again], join("ats", False, np.int32)])})

    spread_rows = docs.select("ord", "text").mapInArrow(spread, "bucket int, ask boolean, keys binary, docs binary, ats binary")
    return spread_rows.groupBy("bucket").applyInArrow(settle, "ord long, at int")


def sentence_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, longest: int = 12, least: int = 12, steady: bool = False) -> DataFrame:
    """One row a document: doc_id, n_sentences, n_removed, n_words_removed, text (what is left).

    First means the smallest id (null last), then the earliest place. Rows with the same id and text count as one
    document and get the same result; rows with the same id and other text are documents in the order of their
    hashes. Null and empty texts have no sentences. An empty table gives an empty result.
    """
    spark, size = docs.sparkSession, C.profile(docs, id_col, text_col)
    n_buckets = C.buckets_for(spark, size.n_bytes)
    rows = C.ordered(docs, id_col, text_col, size.unique)
    found = repeated_runs(rows, n_buckets, run, longest, least, steady).groupBy("ord").agg(F.collect_set("at").alias("ats"))
    schema = T.StructType.fromDDL("doc_id long, n_sentences int, n_removed int, n_words_removed int, text string")

    def cut(batches):
        for batch in batches:
            ids, texts, ats = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for lo, hi in C.chunks(texts):
                words = C.Words(texts[lo:hi])
                begins, first = sentences(words, longest, steady)
                begin_byte = np.append(words.starts[begins], len(words.data)) if len(begins) else np.array([len(words.data)])
                lengths = np.diff(np.append(begins, len(words.starts)))
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    gone = np.zeros(b - a, dtype=bool)
                    for at in ats[lo + i] or ():
                        gone[at : at + run] = True
                    text = texts[lo + i]
                    if gone.any():
                        edges = np.append(begin_byte[a:b], words.at[i + 1] - 1)
                        start = words.at[i]
                        text = (words.raw[start : edges[0]] + b"".join(words.raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone))).decode("utf-8")
                    out.append((ids[lo + i], b - a, int(gone.sum()), int(lengths[a:b][gone].sum()), text))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=schema.names)

    both = rows.join(found, "ord", "left").select("doc_id", "text", F.coalesce("ats", F.array().cast("array<int>")).alias("ats"))
    return both.mapInArrow(cut, schema)
