"""Detection of periodic runs of words: suffix array, longest previous factors, LZ blocks, boundary extensions, copies.

The texts of a batch are sorted together by prefix doubling; each text has an end mark of its own and never meets
another. Ranks of all doublings are kept, so that common extensions of many pairs of places are found at once. Of a
run of period q and length 4 q or more, either an end lies on or across a boundary of LZ blocks, where q is below a
third of the two blocks' length (Main), or the run lies inside a block and is a copy of one inside the block's
earlier occurrence.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A run has at least so many words and so many periods.
LEAST, PERIODS = 6, 4
#: Words sorted at a time; a longer text is sorted by itself.
BATCH = 1 << 18

_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


# ------------------------------------------------------------------ suffix array and extensions


class Suffixes:
    """Suffix array of a sequence by prefix doubling. levels[k] ranks the strings of 2**k items from each place.

    Strings that run over the end of the sequence must differ from all others, as they do if its last item is unique.
    """

    def __init__(self, items: np.ndarray):
        n = len(items)
        order = np.argsort(items, kind="stable")
        first = np.concatenate([[True], items[order][1:] != items[order][:-1]])[:n]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.levels, step = [rank], 1
        while True:
            tied = ~first
            tied[:-1] |= ~first[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            place = order[at]
            after = place + step
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
            both = rank[place].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(both, kind="stable")
            place, both = place[by], both[by]
            new = np.concatenate([[True], both[1:] != both[:-1]])
            order[at], first[at] = place, new
            rank = rank.copy()
            rank[place] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.levels.append(rank)
            step *= 2
        self.order = order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items from places i and j on are the same; i and j differ."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            out += (rank[i + out] == rank[j + out]).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items up to and with places i and j are the same; i is before j and may be -1."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            out += ((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def shared(self) -> np.ndarray:
        """The length of the prefix that each suffix shares with the one before it in order."""
        out = np.zeros(len(self.order), np.int64)
        out[1:] = self.forward(self.order[:-1], self.order[1:])
        return out


def previous_factors(order: list[int], shared: list[int]) -> tuple[list[int], list[int]]:
    """Of each place, the length of the longest string from it that also starts earlier, and where it starts (-1: nowhere)."""
    length, source, stack = [0] * len(order), [-1] * len(order), []
    for place, common in zip([*order, -1], [*shared, 0]):
        while stack and stack[-1][0] > place:
            over, below = stack.pop()
            # the nearest earlier places in order, on both sides
            if below >= common:
                length[over], source[over] = below, stack[-1][0] if stack else -1
            else:
                length[over], source[over] = common, place
            common = min(common, below)
        stack.append((place, common if stack else 0))
    return length, source


def blocks(length: list[int]) -> list[int]:
    """Where the LZ blocks begin: a block is the longest string that also starts earlier, or one item. The end mark is the last block."""
    out, at = [], 0
    while at < len(length):
        out.append(at)
        at += max(1, length[at])
    return out


# ------------------------------------------------------------------ runs


def _crossing(suffixes: Suffixes, cut: np.ndarray, most: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start, length and period of runs on or across the boundaries ``cut``, with periods up to most, in texts from begin to end (their mark)."""
    cut, begin, end = (np.repeat(x, most) for x in (cut, begin, end))
    period = np.arange(len(cut)) - np.repeat(np.cumsum(most) - most, most) + 1
    found = []
    # at least one period before the boundary, or at least one after it
    for near, far in ((cut - period, cut), (cut, cut + period)):
        ok = (near >= begin) & (far <= end)
        near, far, p = near[ok], far[ok], period[ok]
        left = suffixes.backward(near - 1, far - 1)
        length = left + p + suffixes.forward(near, far)
        run = length >= np.maximum(LEAST, PERIODS * p)
        found.append(np.stack([(near - left)[run], length[run], p[run]], axis=1))
    return np.concatenate(found)


def _copied(runs: dict[tuple[int, int], int], starts: list[int], length: list[int], source: list[int]) -> None:
    """Adds to runs (period by start and length) those inside LZ blocks: copies of runs inside earlier occurrences, from buckets by start."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, n), p in runs.items():
        buckets.setdefault(s, []).append((n, p))
    at = sorted(buckets)
    for b in starts:
        size, begin = length[b], source[b]
        if size < LEAST + 2 or begin < 0:
            continue
        k = bisect_right(at, begin)
        while k < len(at) and at[k] < begin + size - 1:
            s = at[k]
            for n, p in buckets[s]:
                to = (s + b - begin, n)
                if s + n < begin + size and to not in runs:
                    runs[to] = p
                    if to[0] not in buckets:
                        insort(at, to[0])
                        buckets[to[0]] = []
                    buckets[to[0]].append((n, p))
            k += 1


def all_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """start, length and smallest period of every run of each text, by start, then period. Texts are lists of numbers from 0 up."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes) - 1
    begins = ends - sizes + 1
    symbols = np.concatenate([np.array([*t, -1], dtype=np.int64) for t in texts]) + 1
    items = symbols + np.repeat(np.arange(len(texts)), sizes) * (int(symbols.max()) + 1)
    suffixes = Suffixes(items)
    shared = suffixes.shared()
    # in a run some five words at least also start earlier, so a text without five shared words has none
    some = np.flatnonzero(np.maximum.reduceat(shared, begins) >= LEAST - 1)
    parts, factors = [], {}
    for t in some.tolist():
        a, z = int(begins[t]), int(ends[t])
        own = shared[a : z + 1].copy()
        own[0] = 0
        length, source = previous_factors((suffixes.order[a : z + 1] - a).tolist(), own.tolist())
        starts = blocks(length)
        factors[t] = starts, length, source
        width = np.diff([*starts, z - a + 1])
        parts.append((np.array(starts[1:]) + a, (width[:-1] + width[1:] - 1) // 3, np.full(len(starts) - 1, a), np.full(len(starts) - 1, z)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    met = _crossing(suffixes, *(np.concatenate(x) for x in zip(*parts)))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for t, s, n, p in zip(np.searchsorted(ends, met[:, 0]).tolist(), *met.T.tolist()):
        own, key = found.setdefault(t, {}), (s - int(begins[t]), n)
        own[key] = min(p, own.get(key, p))
    for t, own in found.items():
        _copied(own, *factors[t])
        out[t] = sorted(((s, n, p) for (s, n), p in own.items()), key=lambda r: (r[0], r[2]))
    return out


# ------------------------------------------------------------------ documents


def repeat_tail(words: list[bytes], crc: int | None) -> list[bytes]:
    """words, of which those from some place on go round a few of them if the id's crc32 is a multiple of 10."""
    n = len(words)
    if crc is None or crc % 10 or not n:
        return words
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that stand in a run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        edge[s + p] += 1
        edge[s + n] -= 1
    return [w for w, over in zip(words, np.cumsum(edge).tolist()) if not over]


def _digest(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    s, n, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeated_tails: bool = True) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and digests of all runs and of the collapsed text, of every row.

    A null or empty text, or one of white space, has no words and no runs. Repeated rows have a result each. A null
    id has no crc32, so its tail isn't repeated. Of runs of equal exponent the first counts. Other columns are ignored; an
    empty table gives no rows. Texts of any length are worked on whole: time grows with n log n, memory with 4 bytes a
    word for each doubling of the longest repeat. ``repeated_tails`` is the contract's change of one text in ten.
    """
    crc = F.crc32(F.col(id_col).cast("string")) if repeated_tails else F.lit(None).cast("long")
    rows = C.spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"), crc.alias("crc")))

    def flush(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        texts = [[number.setdefault(w, len(number)) for w in words] for _, words in held]
        made = [_digest(i, words, runs) for (i, words), runs in zip(held, all_runs(texts))]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=[c.split()[0] for c in _RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                # bytes are split at the six ASCII blanks and nowhere else
                words = repeat_tail(text.encode("utf-8").split(), h)
                if held and size + len(words) > BATCH:
                    yield flush(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words)
        if held:
            yield flush(held)

    return rows.mapInArrow(run, _RESULT)
