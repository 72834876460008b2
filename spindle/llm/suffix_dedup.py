"""Removal of repeated substrings with a distributed sparse suffix array.

A window is a string of ``length`` bytes of one text. Its anchor is the leftmost ``K``-byte string in it of least
hash, so equal windows have equal anchors at equal places. Consecutive windows with the same anchor form an item.
Three shuffles follow: anchors, to find those that occur more than once; the bytes of their items, dealt by
anchor, where suffixes from the anchor (and reversed prefixes before it) are put in order by deep-shallow sorting
and windows with a common prefix long enough are the same; and the covered places, back to their texts. At each
step a task first settles the repeats among its own rows, so a hot string costs a bucket one row a task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

K = 32
#: Window starts handled at a time, which bounds memory for texts of any length.
SLICE = 1 << 21
#: Bytes that multikey quicksort looks at before groups that are still equal go to blind tries.
SHALLOW = 32


# ------------------------------------------------------------------ deep-shallow sorting


class BlindTrie:
    """A Patricia trie over bits of equally long strings, given as integers; branches keep the place of a bit only."""

    def __init__(self, bits: int):
        self.bits, self.root, self.keys = bits, None, []

    def insert(self, key: int) -> None:
        i = len(self.keys)
        self.keys.append(key)
        if self.root is None:
            self.root = [None, [i], None]
            return
        node = self.root
        while node[0] is not None:  # any leaf below shows the first bit that differs
            node = node[2] if key >> (self.bits - 1 - node[0]) & 1 else node[1]
        differ = self.keys[node[1][0]] ^ key
        if not differ:
            node[1].append(i)
            return
        bit = self.bits - differ.bit_length()
        node = self.root
        while node[0] is not None and node[0] < bit:
            node = node[2] if key >> (self.bits - 1 - node[0]) & 1 else node[1]
        old, new = list(node), [None, [i], None]
        node[:] = [bit, old, new] if key >> (self.bits - 1 - bit) & 1 else [bit, new, old]

    def in_order(self) -> tuple[list[int], list[int]]:
        """Numbers of the keys in order, and the bits each shares with the one before (all for equal keys)."""
        order, shared, stack, branch = [], [], [(self.root, 0)], 0
        while stack:
            node, branch = stack.pop()
            if node[0] is None:
                order += node[1]
                shared += [branch] + [self.bits] * (len(node[1]) - 1)
            else:
                stack += [(node[2], node[0]), (node[1], branch)]
        return order, shared


def deep_shallow_sort(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of zero-padded byte rows within their groups, and the length of the prefix shared with the row before.

    Shallow: multikey quicksort on characters of eight bytes, each level over the rows still tied. Deep: one blind
    trie for each group that is tied at SHALLOW bytes. The first row of a group shares -1.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])[:n]
    shared = np.where(first, -1, 8 * words.shape[1])
    depth = 0
    while depth * 8 < min(SHALLOW, width):
        tied = ~first
        tied[:-1] |= ~first[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        segment = np.cumsum(first)[at]
        word = words[order[at], depth]
        by = np.lexsort((word, segment))
        order[at], word = order[at][by], word[by]
        split = np.concatenate([[False], (word[1:] != word[:-1]) & (segment[1:] == segment[:-1])])
        differ = (word[1:] ^ word[:-1])[split[1:]]
        first[at[split]] = True
        # the place of the highest byte that differs
        shared[at[split]] = depth * 8 + (differ.astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        depth += 1
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, n))
    skip = min(depth * 8, width)
    for head, size in zip(heads[sizes > 1], sizes[sizes > 1]):
        if skip >= width:
            break
        trie = BlindTrie((width - skip) * 8)
        for i in order[head : head + size]:
            trie.insert(int.from_bytes(rows[i, skip:].tobytes(), "big"))
        found, bits = trie.in_order()
        order[head : head + size] = order[head : head + size][found]
        shared[head + 1 : head + size] = skip + np.array(bits[1:]) // 8
    limit = np.minimum(lengths[order], np.concatenate([[0], lengths[order][:-1]]))
    return order, np.where(shared < 0, -1, np.minimum(shared, limit))


# ------------------------------------------------------------------ windows, anchors, items


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place, by doubling."""
    h, step, size = C._OF_BYTE[data], C._LONG_STEP, 1
    while size < K:
        h = h[:-size] * step + h[size:]
        step, size = step * step, 2 * size
    return C.mix64(h)


def items(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, n, anchor - start and the anchor's hash of every item of the texts data[starts[i]:ends[i]]."""
    w, out = length - K + 1, []
    span = np.arange(w)
    for lo in range(0, len(data) - length + 1, SLICE):
        part = data[lo : lo + SLICE + length - 1]
        with np.errstate(over="ignore"):
            h = _gram_hashes(part)
        least, size = h, 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        count = len(part) - length + 1
        least = np.minimum(least[:count], least[w - size :][:count])
        edge = np.zeros(count + 1, np.int8)  # windows from each start that lie inside one text
        a, b = np.clip(starts - lo, 0, count), np.clip(ends - length + 1 - lo, 0, count)
        a, b = a[b > a], b[b > a]
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        valid = np.cumsum(edge[:-1]) > 0
        new = np.ones(count, bool)
        new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        new[a] = True
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, count))
        head, size = head[valid[head]], size[valid[head]]
        if not len(head):
            continue
        anchor = np.concatenate([(h[x[:, None] + span] == least[x][:, None]).argmax(axis=1) for x in np.array_split(head, -(-len(head) // 65536))])
        tie = size - 1 > anchor  # the anchor leaves before the run ends: the same string follows
        if tie.any():
            windows = np.repeat(head[tie], size[tie]) + np.arange(size[tie].sum()) - np.repeat(np.cumsum(size[tie]) - size[tie], size[tie])
            own = np.concatenate([x + (h[x[:, None] + span] == least[x][:, None]).argmax(axis=1) for x in np.array_split(windows, -(-len(windows) // 65536))])
            cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)]))
            head = np.concatenate([head[~tie], windows[cut]])
            anchor = np.concatenate([anchor[~tie], own[cut] - windows[cut]])
            size = np.concatenate([size[~tie], np.diff(np.append(cut, len(windows)))])
        out.append((head + lo, size, anchor, least[head]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(at: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << 20) | ((n - 1).astype(np.int64) << 10) | anchor.astype(np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 20, (packed >> 10 & 1023) + 1, packed & 1023


def _frames(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])


def repeated_anchors(docs: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """ord and items (packed) whose anchor may occur more than once; none that occurs twice is missed."""
    kinds = [("bucket", pa.int32()), ("ask", pa.bool_()), ("keys", pa.binary()), ("many", pa.binary()), ("docs", pa.binary()), ("items", pa.binary())]

    def spread(batches):
        for batch in batches:
            ords, parts = batch.column(0).to_numpy(), []
            texts = batch.column(1).to_pylist()
            for lo, hi in C.chunks(texts):
                data, at = C.joined_bytes(texts[lo:hi])
                start, n, anchor, key = items(data, at[:-1], at[1:], length)
                doc = np.searchsorted(at, start, side="right") - 1
                parts.append((key, ords[lo:hi][doc], _pack(start - at[doc], n, anchor)))
            key, doc, item = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
            order = np.argsort(key, kind="stable")
            key = key[order].astype(np.uint64)
            head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            many = np.diff(np.append(np.flatnonzero(head), len(key))) > 1
            lead, rest, rows = order[head], np.sort(order[~head]), []
            key = key[head]
            by_doc = np.argsort(lead)  # in the order of the texts, whose numbers and places then compress well
            key, lead, many = key[by_doc], lead[by_doc], many[by_doc]
            bucket, short = (key % np.uint64(n_buckets)).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32)
            for b, i in C.deal(bucket, n_buckets):
                rows.append((b, True, short[i].tobytes(), many[i].tobytes(), doc[lead[i]].tobytes(), item[lead[i]].tobytes()))
            for b, i in C.deal(doc[rest] % n_buckets, n_buckets):
                rows.append((b, False, b"", b"", doc[rest][i].tobytes(), item[rest][i].tobytes()))
            yield from _frames(rows, kinds)

    def settle(table: pa.Table) -> pa.Table:
        asks = table["ask"].to_pylist()
        join = lambda name, kind, ask: np.frombuffer(b"".join(x for x, a in zip(table[name].to_pylist(), asks) if a == ask), dtype=kind)
        key, many, doc, item = join("keys", np.uint32, True), join("many", np.bool_, True), join("docs", np.int64, True), join("items", np.int64, True)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = np.bincount(inverse, many, len(count))[inverse] + count[inverse] > 1 if len(key) else many
        return pa.table({"ord": np.concatenate([doc[again], join("docs", np.int64, False)]), "item": np.concatenate([item[again], join("items", np.int64, False)])})

    dealt = docs.select("ord", "text").mapInArrow(spread, "bucket int, ask boolean, keys binary, many binary, docs binary, items binary")
    return dealt.groupBy("bucket").applyInArrow(settle, "ord long, item long")


def _covered(contents: list[bytes], anchor: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For distinct items, which of each item's windows occur earlier in another one: booleans by place of the anchor in the window.

    Items stand in the order of (doc, anchor's place).
    """
    w = length - K + 1
    group = np.unique([c[a : a + K] for c, a in zip(contents, anchor.tolist())], return_inverse=True)[1].reshape(-1)
    covered = np.zeros((len(contents), w), bool)
    use = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(use):
        return covered
    right = [contents[i][anchor[i] + K :] for i in use]
    left = [contents[i][: anchor[i]][::-1] for i in use]
    classes = []
    for strings, base in ((right, K), (left, 0)):
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        width = max(1, int(size.max()))
        rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
        order, shared = deep_shallow_sort(rows, size, group[use])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        classes.append((np.where(shared < 0, -1, shared + base), rank))
    (shared_r, rank_r), (shared_l, rank_l) = classes
    lo, hi = anchor[use] - n[use] + 1, anchor[use]
    for place in range(w):
        own = np.flatnonzero((lo <= place) & (place <= hi))
        if len(own) < 2:
            continue
        key = np.cumsum(shared_r < length - place)[rank_r[own]] * (len(use) + 1) + np.cumsum(shared_l < place)[rank_l[own]]
        first = np.unique(key, return_index=True)[1]
        again = np.ones(len(own), bool)
        again[first] = False
        covered[use[own[again]], place] = True
    return covered


def covered_places(found: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """ord, start and stop of stretches of texts covered by windows that also start earlier. found: ord, text, items."""
    kinds = [("bucket", pa.int32()), ("ask", pa.bool_()), ("contents", pa.binary()), ("docs", pa.binary()), ("items", pa.binary())]

    def spread(batches):
        for batch in batches:
            first: dict[tuple[bytes, int], tuple[int, int]] = {}
            again: list[tuple[int, int, int]] = []
            known = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for doc, text, packed in sorted(known, key=lambda r: r[0]):
                raw, packed = text.encode("utf-8"), np.unique(np.array(packed, np.int64))
                for item, at, n, anchor in zip(packed.tolist(), *(x.tolist() for x in _unpack(packed))):
                    content = raw[at : at + n + length - 1]
                    if first.setdefault((content, anchor), (doc, item)) != (doc, item):
                        if again and again[-1][0] == doc and at <= again[-1][2]:
                            again[-1] = (doc, again[-1][1], at + n + length - 1)
                        else:
                            again.append((doc, at, at + n + length - 1))
            rows, by_bucket = [], {}
            for (content, anchor), (doc, item) in first.items():
                by_bucket.setdefault(zlib.crc32(content[anchor : anchor + K]) % n_buckets, []).append((content, doc, item))
            for b, own in by_bucket.items():
                rows.append((b, True, b"".join(c for c, _, _ in own), np.array([d for _, d, _ in own]).tobytes(), np.array([i for _, _, i in own]).tobytes()))
            gone = np.array(again, np.int64).reshape(-1, 3)
            for b, i in C.deal(gone[:, 0] % n_buckets, n_buckets):
                rows.append((b, False, b"", gone[i, 0].tobytes(), gone[i, 1:].tobytes()))
            yield from _frames(rows, kinds)

    def settle(table: pa.Table) -> pa.Table:
        asked, out = [], [np.zeros((0, 3), np.int64)]
        for ask, contents, docs, packed in zip(*(table[c].to_pylist() for c in ("ask", "contents", "docs", "items"))):
            docs = np.frombuffer(docs, np.int64)
            if not ask:
                out.append(np.column_stack([docs, np.frombuffer(packed, np.int64).reshape(-1, 2)]))
                continue
            at, n, anchor = _unpack(np.frombuffer(packed, np.int64))
            ends = np.cumsum(n + length - 1)
            asked += zip(docs.tolist(), (at + anchor).tolist(), anchor.tolist(), n.tolist(), (contents[e - k : e] for e, k in zip(ends.tolist(), (n + length - 1).tolist())))
        asked.sort(key=lambda x: x[:2])
        seen: dict[tuple[bytes, int], tuple] = {}
        gone = [(doc, p - a, p - a + n + length - 1) for doc, p, a, n, content in asked if (mine := (doc, p, n, a)) != seen.setdefault((content, a), mine)]
        out.append(np.array(gone, np.int64).reshape(-1, 3))
        if len(seen) > 1:
            doc, p, n, a = (np.array(x, np.int64) for x in zip(*seen.values()))
            covered = _covered([c for c, _ in seen], a, n, length)
            edges = np.diff(covered.astype(np.int8), axis=1, prepend=0, append=0)
            i, lo = np.nonzero(edges == 1)
            hi = np.nonzero(edges == -1)[1] - 1
            out.append(np.column_stack([doc[i], p[i] - hi, p[i] - lo + length]))
        rows = np.concatenate(out)
        return pa.table({"ord": rows[:, 0], "start": rows[:, 1], "stop": rows[:, 2]})

    dealt = found.mapInArrow(spread, "bucket int, ask boolean, contents binary, docs binary, items binary")
    return dealt.groupBy("bucket").applyInArrow(settle, "ord long, start long, stop long")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_bytes: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) if asked for.

    A byte is removed if a window that covers it starts earlier too: in a document of smaller id (null last), or
    before it in the same document. Rows with the same id and text count as one document and get the same result;
    rows with the same id and other text are documents in the order of their hashes. Null counts as empty. Texts
    shorter than a window stay whole; an empty table gives an empty result.
    """
    spark, size = docs.sparkSession, C.profile(docs, id_col, text_col)
    n_buckets = C.buckets_for(spark, size.n_bytes, 16 << 20)
    rows = C.ordered(docs, id_col, text_col, size.unique)
    asked = repeated_anchors(rows, n_buckets, length).groupBy("ord").agg(F.collect_list("item").alias("items"))
    # both joins with the texts take the same columns, so they read one exchange
    places = covered_places(rows.join(asked, "ord").select("ord", "text", "items", "doc_id"), n_buckets, length)
    places = places.groupBy("ord").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, start, stop in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw, kept, end, removed, spans = text.encode("utf-8"), [], 0, 0, 0
                for a, b in sorted(zip(start or (), stop or ())):
                    if a > end or not spans and a == 0:
                        kept.append(raw[end:a])
                        spans += 1
                    a = max(a, end)
                    removed += max(0, b - a)
                    end = max(end, b)
                kept = b"".join([*kept, raw[end:]])
                out.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_bytes else [])))
            cols = list(zip(*out)) if out else [()] * len(schema)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    return rows.join(places, "ord", "left").select("doc_id", "text", "start", "stop").mapInArrow(cut, schema)
