"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct word shingles. Minima of many hash functions give band keys, which propose
candidates, and a packed signature of the low bits of each minimum. Bit counts of signatures, corrected for chance
collisions, estimate similarity; whoever passes with a wide margin is confirmed on the full sets.

Equal sets are one class from the start. In a bucket, members are compared with two pivots, not with each
other, which joins most families into components. Only members of different components in one bucket are
then compared directly, the likeliest first, until every such candidate is in one component or refuted.

Documents around one template meet in the same buckets however few of them are near. So members of a crowded
bucket are compared only if they share one of their rarest shingles, which every pair similar enough does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Hash functions of the sharp signatures, for documents that share a bucket with others they aren't connected to.
SHARP = 1280
#: A bucket in which more pairs than this would be compared is crowded: its members meet by their rarest shingles instead.
CROWD = 4096
_FACTORS = np.random.default_rng(75).integers(1, 2**63, (SHARP, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as the one shingle."""
    words = C.Words(texts, lower=True)
    hashes = words.hashes()
    grams = C.hash_ngrams(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(C.hash_ngrams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: BITS planes of the low bits of the minima as 64-bit words, and the band keys."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((hashes, len(sets)), np.uint64)
    for k, (factor, other) in enumerate(_FACTORS[:hashes]):
        least[k] = np.minimum.reduceat(values * factor ^ other, starts)
    least = C.mix64(np.ascontiguousarray(least.T))
    planes = [np.packbits((least >> np.uint64(j) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for j in range(BITS)]
    keys = least[:, :HASHES].reshape(len(sets), BANDS, ROWS)
    band = np.arange(BANDS, dtype=np.uint64) * C._STEP
    for r in range(ROWS):
        band = C.mix64(band * C._LONG_STEP + keys[:, :, r])
    return np.concatenate(planes, axis=1), band.view(np.int64)


def features(docs: DataFrame, size: int, hashes: int = HASHES) -> DataFrame:
    """ord, n_shingles, set_key (digest of the set), sig (array of long), bands (array of long)."""
    schema = T.StructType.fromDDL("ord long, n_shingles long, set_key binary, sig array<long>, bands array<long>")

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))

    def run(batches):
        for batch in batches:
            ords, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in C.chunks(texts, 2 << 20):
                sets = shingle_sets(texts[lo:hi], size)
                # an empty set links with nothing; its signature is never looked at
                sig, bands = signatures([s if len(s) else np.zeros(1, np.uint64) for s in sets], hashes)
                yield pa.RecordBatch.from_arrays([
                    ords.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                    lists(sig), lists(bands)], names=schema.names)

    return docs.select("ord", "text").mapInArrow(run, schema)


def estimate(a: str, b: str, hashes: int = HASHES) -> Column:
    """Similarity from two signatures: the share of minima whose low bits agree, less the share that would by chance."""
    words = hashes // 64
    differ = [reduce(lambda x, y: x.bitwiseOR(y), (F.get(a, words * j + i).bitwiseXOR(F.get(b, words * j + i)) for j in range(BITS))) for i in range(words)]
    agree = 1 - reduce(lambda x, y: x + y, map(F.bit_count, differ)) / hashes
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def spread(percent: int, hashes: int) -> float:
    """The standard deviation of an estimate at the limit."""
    agree = percent / 100 * (1 - 2.0**-BITS) + 2.0**-BITS
    return (agree * (1 - agree) / hashes) ** 0.5 / (1 - 2.0**-BITS)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ords whose full sets are similar enough: 100 * shared >= percent * all."""
    texts = docs.select("ord", "text")
    both = pairs.select("a", "b").join(texts.select(F.col("ord").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("ord").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            for lo, hi in C.chunks(x, 4 << 20):
                left = shingle_sets(x[lo:hi], size)
                number: dict[str, int] = {}
                at = [number.setdefault(t, len(number)) for t in y[lo:hi]]
                right = shingle_sets(list(number), size)
                keep = []
                for i, s in enumerate(left):
                    t = right[at[i]]
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
                good = [lo + i for i, k in enumerate(keep) if k]
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node that has a link. links: a, b.

    Each round hooks a root to its smallest lower neighbour, follows hooks to where they lead, and
    contracts the links; a round leaves only links between different roots.
    """
    # min() combines before the shuffle, so a node of many links costs one row a task
    made: list[DataFrame] = []
    table = lambda df: made.append(C.materialize(df)) or made[-1]
    edges = table(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
    hooks = []
    while not edges.isEmpty():
        up = table(edges.groupBy("hi").agg(F.min("lo").alias("lo")))
        for _ in range(2):
            nxt = up.select(F.col("hi").alias("lo"), F.col("lo").alias("to"))
            up = up.join(nxt, "lo", "left").select("hi", F.coalesce("to", "lo").alias("lo"))
        up = table(up)
        hooks.append(up)
        for side in ("hi", "lo"):
            to = up.select(F.col("hi").alias(side), F.col("lo").alias("to"))
            edges = edges.join(to, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = table(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).filter("hi > lo").distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    for up in hooks:
        nodes = nodes.join(up.select(F.col("hi").alias("component"), F.col("lo").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = C.materialize(nodes)
    C.discard(*made)
    return out


def mixed(cells: DataFrame, key: str, also: str = "true") -> DataFrame:
    """The rows of cells (key, component, ...) whose key several components have, with the largest of them, main, and pairs: rows outside main times all rows.

    Of those only the keys for some row of which ``also`` holds.
    """
    sizes = cells.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(also)).alias("also"))
    several = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"), F.max("also").alias("also")).filter("k > 1 AND also")
    pairs = (F.col("all") - F.col("main.n")) * F.col("all").cast("double")
    return cells.join(several.select(key, pairs.alias("pairs"), F.col("main.component").alias("main")), key)


def rarest(docs: DataFrame, crowd: DataFrame, size: int, percent: int, table: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rarest shingles of the documents of crowd (ord, component): ord, component, n (size of the set), shingle, place, short.

    Shingles stand in the order of their frequency among crowd. Sets of n and m >= n shingles that are similar enough
    share at least 2 * percent * n / (100 + percent) of them and percent * m / 100, so the first that they share is
    among the first of either that are left when all but one of so many are taken off: ``short`` marks these
    for the smaller set, and all rows are those for the larger. A shingle of a template stands behind what documents have of their own.
    """
    def run(batches):
        for batch in batches:
            ords, parts, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in C.chunks(texts, 2 << 20):
                sets = shingle_sets(texts[lo:hi], size)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ords.slice(lo, hi - lo), pa.array(parts[lo:hi], pa.int64()), lists], names=["ord", "component", "shingles"])

    sets = docs.select("ord", "text").join(crowd, "ord").select("ord", "component", "text").mapInArrow(run, "ord long, component long, shingles array<long>")
    rows = table(sets.dropDuplicates(["ord"])).select("ord", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    listed = rows.join(often, "shingle").groupBy("ord", "component", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    left = lambda part, whole: (F.col("n") - F.ceil(F.col("n") * part / whole) + 1).cast("int")
    first = listed.select("ord", "component", "n", left(2 * percent, 100 + percent).alias("few"), F.posexplode(F.slice("all", F.lit(1), left(percent, 100))).alias("place", "at"))
    return first.select("ord", "component", "n", F.col("at.shingle").alias("shingle"), "place", (F.col("place") < F.col("few")).alias("short"))


def shared_rarest(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of ords and their components ca, cb, which differ, that share a rare shingle in places that allow enough similarity. rows: as of ``rarest``."""
    cells = mixed(rows, "shingle", "short")
    side = lambda df, s: df.select("shingle", *(F.col(c).alias(c + s) for c in ("ord", "component", "n", "place", "main")))
    small, large = cells.filter("short"), cells
    # if this is the first shingle that both have, they share at most it and what follows
    most = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    enough = (100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y"))
    order = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("ord_x") < F.col("ord_y")))
    fits = (F.col("component_x") != F.col("component_y")) & order & enough

    def met(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
        both = side(left, "_x").join(side(right, "_y"), "shingle").filter(fits)
        return both.select(F.col(f"ord_{a}").alias("a"), F.col(f"ord_{b}").alias("b"), F.col(f"component_{a}").alias("ca"), F.col(f"component_{b}").alias("cb"))

    # a is outside the largest component, as that has no pairs of its own
    out = met(small.filter("component <> main"), large, "x", "y").unionByName(met(small.filter("component = main"), large.filter("component <> main"), "y", "x"))
    return out.distinct()


def near_links(docs: DataFrame, reps: DataFrame, size: int, percent: int, margin: float) -> DataFrame:
    """Links (a, b) between representatives that connect just what all links would. reps: ord, sig, bands."""
    made: list[DataFrame] = []
    out = _near_links(docs, reps, size, percent, margin, lambda df: made.append(df) or df)
    C.discard(*(df for df in made if df is not out))
    return out


def _near_links(docs: DataFrame, reps: DataFrame, size: int, percent: int, margin: float, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``near_links``; kept notes each table on the way, so that it can be deleted in the end."""
    table = lambda df: kept(C.materialize(df))
    floor, sharp_floor = (percent / 100 - margin * spread(percent, h) for h in (HASHES, SHARP))
    cells = reps.select("ord", F.explode("bands").alias("bucket"))
    pivots = cells.groupBy("bucket").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
    pivots = pivots.filter("low < high").select("bucket", F.array_distinct(F.array("low", "high")).alias("pivots"))
    # of a member's pivots the few that it meets in most buckets; every other link is found below
    meets = cells.join(pivots, "bucket").select(F.col("ord").alias("a"), F.explode("pivots").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = meets.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "b"))), 1, 3).alias("top")).select("a", F.explode("top.b").alias("b"))
    slim = reps.select("ord", "sig")
    rated = pairs.join(slim.select(F.col("ord").alias("a"), F.col("sig").alias("sig_a")), "a").join(slim.select(F.col("ord").alias("b"), F.col("sig").alias("sig_b")), "b")
    rated = rated.select("a", "b", estimate("sig_a", "sig_b").alias("est")).filter(F.col("est") >= floor)
    best = table(rated.groupBy("a").agg(F.max(F.struct("est", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    links = table(confirmed(best, docs, size, percent))
    # members of one bucket that are not connected yet
    labels = kept(components(links))
    known = reps.join(labels.select(F.col("node").alias("ord"), "component"), "ord", "left").select("ord", "bands", F.coalesce("component", "ord").alias("component"))
    known = table(known)
    inside = table(mixed(known.select("ord", "component", F.posexplode("bands").alias("band", "bucket")), "bucket"))
    if inside.isEmpty():
        return links
    sharp = table(features(docs.join(inside.select("ord").distinct(), "ord", "left_semi"), size, SHARP).dropDuplicates(["ord"]).select("ord", "sig", "bands"))
    small = inside.filter(F.col("pairs") <= CROWD).join(sharp, "ord")
    x = small.filter("component <> main").select("bucket", F.col("ord").alias("a"), F.col("component").alias("ca"), F.col("sig").alias("sig_a"), F.col("bands").alias("bands_a"), "band")
    y = small.select("bucket", F.col("ord").alias("b"), F.col("component").alias("cb"), F.col("sig").alias("sig_b"), F.col("bands").alias("bands_b"), (F.col("component") == F.col("main")).alias("in_main"))
    # a pair that meets in several buckets comes from the first of them only; if that is crowded, from its rarest shingles
    est = estimate("sig_a", "sig_b", SHARP)
    first = F.array_position(F.zip_with("bands_a", "bands_b", lambda p, q: p == q), True) == F.col("band") + 1
    meet = x.alias("x").join(y.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & (est >= sharp_floor) & first)
    pairs = meet.select("a", "b", "ca", "cb", est.alias("est"))
    crowd = table(inside.filter(F.col("pairs") > CROWD).select("ord", "component").distinct())
    if not crowd.isEmpty():
        slim = sharp.select("ord", "sig")
        rated = shared_rarest(rarest(docs, crowd, size, percent, table), percent)
        rated = rated.join(slim.select(F.col("ord").alias("a"), F.col("sig").alias("sig_a")), "a").join(slim.select(F.col("ord").alias("b"), F.col("sig").alias("sig_b")), "b")
        pairs = pairs.unionByName(rated.select("a", "b", "ca", "cb", est.alias("est")).filter(F.col("est") >= sharp_floor))
    pairs = table(pairs.dropDuplicates(["a", "b"]))
    if pairs.isEmpty():
        return links
    likely = table(pairs.groupBy("a", "cb").agg(F.max(F.struct("est", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    links = table(links.unionByName(confirmed(likely, docs, size, percent)))
    labels = kept(components(links))
    rest = pairs
    for side in ("a", "b"):
        rest = rest.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"now_{side}")), side, "left").withColumn(f"now_{side}", F.coalesce(f"now_{side}", side))
    rest = table(rest.filter("now_a <> now_b").select("a", "b").join(likely, ["a", "b"], "left_anti"))
    return links if rest.isEmpty() else table(links.unionByName(confirmed(rest, docs, size, percent)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, margin: float = 5.0) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, text_key (hash of the text).

    Documents are linked when 100 * shared >= percent * all over their sets of distinct ``size``-word shingles
    (A-Z in lower case; fewer words: the whole sequence). component_id is the smallest id reachable by links, itself
    included; kept says whether it is the document's own. A document without words, or with a null text, is linked
    with nothing. Rows with the same id and text are one document; a null id comes last in order, and a null-id
    document is kept if its component has no other. Pairs whose estimate is more than ``margin`` standard
    deviations below the limit are not confirmed. An empty table gives an empty result.
    """
    rows = C.ordered(docs, id_col, text_col)
    found = C.materialize(features(rows, size))
    sets = C.materialize(found.filter("n_shingles > 0").groupBy("set_key").agg(F.min("ord").alias("rep")))
    reps = C.materialize(found.join(sets.select(F.col("rep").alias("ord")), "ord", "left_semi").dropDuplicates(["ord"]).select("ord", "sig", "bands"))
    links = near_links(rows, reps, size, percent, margin)
    labels = components(links)
    C.discard(links, reps)
    parts = sets.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    slim = found.select("ord", "n_shingles", "set_key")
    out = slim.join(parts, "set_key", "left").select("ord", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("ord")).alias("component"))
    names = rows.select("ord", "doc_id", F.xxhash64("text").alias("text_key"))
    out = names.join(out.dropDuplicates(["ord"]), "ord")
    ids = names.select(F.col("ord").alias("component"), F.col("doc_id").alias("component_id")).dropDuplicates(["component"])
    if C.ids_are_unique(docs, id_col):
        return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("component") == F.col("ord")).alias("kept"), "text_key")
    return out.join(ids, "component").select("doc_id", "n_shingles", "component_id", (F.col("component") == F.col("ord")).alias("kept"), "text_key")

