"""Secret scans with DataFrame functions only: fixed patterns, and Markov models of random strings and identifiers.

Each model is a table of the probabilities of one character after another. A candidate's score is the mean over
its character pairs of the logarithm of the ratio of both, and candidates above a threshold taken from the
labelled identifiers are secrets as well. Candidates are looked for in what base matches leave: whole runs of the
characters of secrets first, then, in runs that aren't taken, the pieces between ``=``, ``/``, ``_`` and ``-``.
Positions come from the lengths of matches and of what lies between. All work is linear in the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The base patterns and the least number of characters of the group that counts. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SET = "A-Za-z0-9+/_=-"
#: Candidates for the models: whole runs of such characters, long enough for a score to mean something.
CANDIDATE = rf"(?<![{_SET}])[{_SET}]{{16,}}"
#: Parts of a run that isn't taken as a whole.
PIECE = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{16,}"
#: Matches handled at a time when positions are summed up.
BLOCK = 256


@dataclass(frozen=True)
class Models:
    ratios: tuple[float, ...]
    threshold: float


def _ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio over the character pairs of a token of the alphabet."""
    n = len(ALPHABET)
    # split once, as taking the i-th character of a text means walking there
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.length(token) - 1), F.slice(codes, F.lit(2), F.length(token) - 1), lambda a, b: (a - 1) * n + b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.element_at(ratios, i)) / (F.length(token) - 1)


def fit(samples: DataFrame, smoothing: float = 0.5, quantile: float = 0.9995, margin: float = 0.1) -> Models:
    """Models from labelled samples: token (of the alphabet, two characters or more), label (1 random, 0 identifier).

    The threshold is the given quantile of the identifiers' scores and a margin, 0 at least. The table has one
    cell for each pair of the alphabet, whatever the samples.
    """
    n = len(ALPHABET)
    codes = F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    known = samples.filter("token IS NOT NULL AND length(token) > 1").select("label", codes.alias("c"))
    follow = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cells = known.select("label", F.explode(follow).alias("p")).select("label", "p.a", "p.b").filter("a > 0 AND b > 0").groupBy("a", "b").pivot("label", [0, 1]).count().collect()
    table = {(r.a, r.b): (r["0"] or 0, r["1"] or 0) for r in cells}
    rows = [[sum(table.get((a, b), (0, 0))[y] for b in range(1, n + 1)) for a in range(1, n + 1)] for y in (0, 1)]
    chance = lambda a, b, y: (table.get((a, b), (0, 0))[y] + smoothing) / (rows[y][a - 1] + smoothing * n)
    ratios = tuple(log(chance(a, b, 1) / chance(a, b, 0)) for a in range(1, n + 1) for b in range(1, n + 1))
    scored = samples.filter(f"label = 0 AND token RLIKE '^[{_SET}]{{8,}}$'").select(_ratio(F.col("token"), F.lit(list(ratios))).alias("s"))
    high = scored.agg(F.percentile_approx("s", quantile, 10000)).first()[0]
    return Models(ratios, max(0.0, high + margin) if high is not None else 0.5)


def labelled_samples(docs: DataFrame, text_col: str = "text", most: int = 4000) -> DataFrame:
    """Samples for ``fit``, written to the shared folder: token and label.

    Random strings (label 1) have six alphabets and are made from digests of numbers. Identifiers (label 0) are
    each row's distinct words of 8 characters or more in about ``most`` rows of docs, picked by the hash of their text, with base
    matches taken out; a word of 16 or more with both digits and letters may be a secret itself, so it teaches neither side.
    """
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    made = F.array(digest, F.substring(digest, 1, 24), coded, F.translate(coded, "+/", "-_"), F.regexp_replace(coded, "[^A-Za-z0-9]", ""), F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")))
    rows = C.by_share(docs.select(F.coalesce(text_col, F.lit("")).alias("t")), F.col("t"), most)
    # a hot text counts once, and its copies are met before the shuffle
    rows = rows.groupBy(F.xxhash64("t")).agg(F.first("t").alias("t"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"(?<![{_SET}])[{_SET}]{{8,}}"), F.lit(0)))).alias("token"))
    words = words.filter("NOT (token RLIKE '[0-9]' AND token RLIKE '[A-Za-z]' AND length(token) >= 16)")
    return C.materialize(spark.range(3000).select(F.explode(made).alias("token"), F.lit(1).alias("label")).unionByName(words.select("token", F.lit(0).alias("label"))))


def _placed(docs: DataFrame, name: str, pattern: str, text: str = "_text") -> DataFrame:
    """docs with a column ``name``: start, end and text of every match of pattern in the column text, in code points."""
    docs = docs.withColumns({f"{name}_m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))})
    # most texts have no match, and then nothing is split
    docs = docs.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn(f"{name}_c", F.zip_with(f"{name}_m", F.slice(f"{name}_g", F.lit(1), F.size(f"{name}_m")), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(f"{name}_c") - 1) / BLOCK).cast("int")), lambda b: F.slice(f"{name}_c", b * BLOCK + 1, F.lit(BLOCK)))
    docs = docs.withColumn(f"{name}_b", F.when(F.size(f"{name}_c") > 0, blocks).otherwise(F.array().cast("array<array<struct<g:int,n:int,m:string>>>")))
    length = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["g"] + x["n"])
    starts = F.aggregate(f"{name}_b", F.array(F.lit(0)), lambda s, block: F.array_append(s, F.element_at(s, -1) + length(block)))
    docs = docs.withColumn(f"{name}_s", starts)
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def inside(block: Column, start: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            begin = s["p"] + x["g"]
            return F.struct((begin + x["n"]).alias("p"), F.array_append(s["out"], F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["m"].alias("m"))).alias("out"))

        return F.aggregate(block, F.struct(start.alias("p"), none.alias("out")), step, lambda s: s["out"])

    placed = F.flatten(F.zip_with(f"{name}_b", F.slice(f"{name}_s", F.lit(1), F.size(f"{name}_b")), inside))
    return docs.withColumn(name, placed).drop(*(f"{name}_{x}" for x in "mgcbs"))


def _blanked(text: str, pattern: str, gone) -> Column:
    """The text with blanks in the place of each match for which gone holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = F.transform(found, lambda m: F.when(gone(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    parts = F.flatten(F.zip_with(F.split(text, pattern, -1), shown, lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(F.col(text))


def find_secrets(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs with ``secrets``: an array of start, kind and end (kind as numbered in KINDS; code points, end exclusive), sorted.

    Base matches come first: leftmost and non-overlapping for each kind, those too short dropped. In the text without
    them, runs that the models take for random are added, and pieces of other runs. Null counts as empty text.
    Rows are looked at one by one, so repeated rows and any other columns stay as they are, but for a column
    named secrets, which is replaced, and names that begin with _, which are kept for the work. An empty table gives
    an empty result; a text of any length is looked at whole.
    """
    long = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12
    ratios = F.lit(list(models.ratios))
    random = lambda m: _ratio(m, ratios) > models.threshold
    of = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    docs = docs.withColumn("_text", F.coalesce(text_col, F.lit("")))
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX)):
        docs = _placed(docs, name, pattern)
    docs = docs.withColumn("_base", F.concat(of(F.filter("_assign", lambda x: long(x["m"])), 0), of("_access", 1), of("_hex", 2)))
    docs = docs.withColumn("_text", F.when(F.size("_base") > 0, _blanked("_text", ASSIGN, long)).otherwise(F.col("_text")))
    for pattern in (ACCESS, HEX):
        docs = docs.withColumn("_text", F.when(F.size("_base") > 0, _blanked("_text", pattern, lambda m: F.lit(True))).otherwise(F.col("_text")))
    docs = _placed(docs, "_run", CANDIDATE).withColumn("_run", F.filter("_run", lambda x: random(x["m"])))
    docs = docs.withColumn("_text", F.when(F.size("_run") > 0, _blanked("_text", CANDIDATE, random)).otherwise(F.col("_text")))
    docs = _placed(docs, "_piece", PIECE).withColumn("_piece", F.filter("_piece", lambda x: random(x["m"])))
    return docs.withColumn("secrets", F.array_sort(F.concat("_base", of("_run", 3), of("_piece", 3)))).drop("_text", "_assign", "_access", "_hex", "_run", "_piece", "_base")


def secret_digest(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined).

    Null and empty texts have no spans; repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    slim = C.spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = find_secrets(slim, models).select("doc_id", "secrets")
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, shown), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text(F.filter("secrets", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), text("secrets").alias("spans"))
