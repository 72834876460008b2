"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be joined by a merge, so a text may be
cut there for certain. Each piece that the vocabulary's pre-tokenizer gives is cut at such pairs, the fragments
are encoded independently (each once, then from a bounded memo), and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

#: Unicode white space, as the pre-tokenizer's pattern means it. A fixed value.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Entries kept in each memo of a worker, and bytes of an entry's key; beyond the first it starts anew, longer keys aren't kept.
MEMO, MEMO_KEY = 300_000, 256


@lru_cache(1)
def _classes() -> tuple[str, str]:
    """Regular-expression ranges of letters and of numbers."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        runs = ranges.get(unicodedata.category(chr(c))[0])
        if runs is None:
            continue
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in ranges[k]) for k in "LN")


def _pattern(letters: str, numbers: str) -> re.Pattern:
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@lru_cache(1)
def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files of this kind write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_KEY:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


class Codec:
    """A byte-level BPE vocabulary file and its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        raw = {token: bytes(letters[c] for c in token) for token in vocab}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        inside = np.zeros((256, 256), dtype=bool)
        for token, i in vocab.items():
            b = np.frombuffer(raw[token], dtype=np.uint8)
            self.tokens[i] = raw[token]
            inside[b[:-1], b[1:]] = True
        for token, i in self.special.items():
            self.tokens[i] = token.encode("utf-8")
        self.boundary = frozenset(bytes((a, b)) for a, b in zip(*np.nonzero(~inside)))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ascii = _pattern("A-Za-z", "0-9")
        self.wide: re.Pattern | None = None
        self.fragments = _Memo(self._fragment)
        self.pieces = _Memo(self._piece)

    def _fragment(self, fragment: bytes) -> bytes:
        """Ids of one fragment as little-endian 32-bit integers: lowest rank first, leftmost of equal ones."""
        ids = [self.of_byte[b] for b in fragment]
        after, before, heap = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], []
        for i, pair in enumerate(zip(ids, ids[1:])):
            if found := self.merges.get(pair):
                heap.append((found[0], i, *pair, found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (found := self.merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        raw, boundary, start, out = piece.encode("utf-8"), self.boundary, 0, []
        for i in range(1, len(raw)):
            if raw[i - 1 : i + 1] in boundary:
                out.append(raw[start:i])
                start = i
        return b"".join(map(self.fragments.__getitem__, [*out, raw[start:]]))

    def _ordinary(self, text: str):
        if text.isascii():
            pattern = self.ascii
        else:
            pattern = self.wide = self.wide or _pattern(*_classes())
        return map(self.pieces.__getitem__, pattern.findall(text))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; special tokens in it are recognised."""
        if self.split_special is None or not self.split_special.search(text):
            return b"".join(self._ordinary(text))
        parts = self.split_special.split(text)
        return b"".join(chain.from_iterable([np.array([self.special[p]], dtype="<u4").tobytes()] if p in self.special else self._ordinary(p) for p in parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)))


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null counts as empty, which has no ids. Repeated rows and null ids stay; an empty table gives an empty result."""

    def run(batches):
        c = codec(vocab)
        for batch in batches:
            found = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], names=["doc_id", "ids"])

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return C.spread(slim).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """doc_id and text of the ids that ``encode`` gives; null or no ids give the empty text. Repeated rows stay; an empty table gives an empty result."""

    def run(batches):
        c = codec(vocab)
        for batch in batches:
            texts = [c.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for, of every whole text, encoded and decoded again in one pass.

    Null and empty texts have no tokens and decode to the empty text; repeated rows and null ids stay as they are; an
    empty table gives an empty result. A text is encoded whole whatever its length, pre-token by pre-token.
    """
    schema = T.StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def run(batches):
        c, sha = codec(vocab), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            found = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([sha(x) for x in found], pa.string()),
                pa.array([sha(c.decode(x).encode("utf-8")) for x in found], pa.string()), *([_lists(found)] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return C.spread(slim).mapInArrow(run, schema)
