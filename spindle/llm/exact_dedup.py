"""Exact deduplication by deterministic block naming.

Normalised texts are cut into blocks of a fixed length. Equal blocks at the same place of texts of the same
length get one integer name, by sorting; then adjacent pairs of names are named, again and again, until each
text has one name. Names compare whole contents, so equal names mean equal texts. A text with a block or pair
that occurs nowhere else is settled as unique at once and takes no further part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

KEY = ["key_id", "key_null", "key_tie"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = C.text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("key_id"),
        F.col(id_col).isNull().alias("key_null"),
        F.xxhash64(text).alias("key_tie"),
        F.length(text).alias("n_points"),
        F.regexp_replace(text, C.SPACE + "+", "").alias("norm"),
    )


def _named(cells: DataFrame, place: list[str]) -> DataFrame:
    """Integer names, in sorted order, of the places and contents that occur more than once.

    Counting combines before its shuffle, so a hot content costs one row a task. The sort is over distinct
    repeated contents and by ranges, and a row's number in it is the name.
    """
    repeated = cells.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # ranges by a prefix keep the order and spare the driver whole contents when it samples the bounds
    ranges = [F.substring(c, 1, 16) if c == "content" else F.col(c) for c in place]
    return C.materialize(repeated.repartitionByRange(*ranges).sortWithinPartitions(*place).withColumn("name", F.monotonically_increasing_id()))


def _regroup(cells: DataFrame, names: DataFrame, place: list[str], total: Column) -> DataFrame:
    """The documents all of whose cells have names, with those names in order."""
    kept = ["doc_id", *KEY, "n_points", "n_norm", "rows"]
    found = cells.join(names, place).groupBy(*kept[1:], "n_cells").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_set(F.struct("at", "name"))).alias("cells"), F.count(F.lit(1)).alias("n_rows"))
    found = found.filter(F.size("cells") == total)
    return found.select(*(c for c in kept if c != "rows"), F.coalesce("rows", (F.col("n_rows") / F.col("n_cells")).cast("long")).alias("rows"), F.col("cells.name").alias("names"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """One row for each document whose normalised text occurs more than once: its key, length and single name.

    Rows with the same id and the same text count as one document of ``rows`` rows. Documents that are not
    returned are unique.
    """
    base = _keyed(docs, id_col, text_col).withColumn("n_norm", F.length("norm"))
    n = F.greatest(F.ceil(F.col("n_norm") / block).cast("int"), F.lit(1))
    cells = base.select(
        "doc_id", *KEY, "n_points", "n_norm", F.lit(None).cast("long").alias("rows"), n.alias("n_cells"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("norm"), i * block + 1, F.lit(block)))).alias("at", "content"))
    place = ["n_norm", "at", "content"]
    state = C.materialize(_regroup(cells, _named(cells, place), place, F.col("n_cells")))
    done = state.filter(F.size("names") == 1)
    longest = state.agg(F.max(F.size("names"))).first()[0] or 1
    while longest > 1:
        rest = state.filter(F.size("names") > 1)
        half = ((F.size("names") + 1) / 2).cast("int")
        pairs = rest.select(
            "doc_id", *KEY, "n_points", "n_norm", "rows", half.alias("n_cells"),
            F.posexplode(F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))).alias("at", "pair"),
        ).select("*", F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).drop("pair")
        # a document of several rows is one row here, so a pair may be repeated by its rows alone
        place = ["n_norm", "at", "a", "b"]
        repeated = pairs.groupBy(*place).agg(F.sum("rows").alias("n")).filter("n > 1").drop("n")
        names = C.materialize(repeated.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("name", F.monotonically_increasing_id()))
        state = C.materialize(_regroup(pairs, names, place, F.col("n_cells")))
        done = done.unionByName(state.filter(F.size("names") == 1))
        longest = (longest + 1) // 2
    return done.withColumn("name", F.element_at("names", 1)).drop("names")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """Every row of docs with the row that stays of its group of equal texts.

    Texts are equal when identical without ASCII white space; null counts as empty, and empty texts are equal to
    one another. The row with the most code points stays, of those the smallest id (null last); of identical rows
    with the same id, one. An empty table gives an empty result; other columns of docs are not looked at.

    Columns: doc_id, keep_id, group_size, kept, text_sha256 (normalised text), key_tie (hash of the text).
    """
    same = ["n_norm", "name"]
    found = identities(docs, id_col, text_col, block)
    # a table of its own, so that the join with a hot group is dealt anew and can be split
    best = C.materialize(found.groupBy(*same).agg(
        F.min(F.struct((-F.col("n_points")).alias("p"), "key_null", "key_id", "key_tie")).alias("best"), F.sum("rows").alias("group_size")))
    info = found.join(best, same).select(
        *KEY, F.when(~F.col("best.key_null"), F.col("best.key_id")).alias("keep_id"), "group_size",
        ((F.col("best.key_null") == F.col("key_null")) & (F.col("best.key_id") == F.col("key_id")) & (F.col("best.key_tie") == F.col("key_tie"))).alias("is_best"))
    rows = _keyed(docs, id_col, text_col).select("doc_id", *KEY, F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    first = F.row_number().over(W.partitionBy(*KEY).orderBy("text_sha256")) == 1
    out = rows.join(C.materialize(info), KEY, "left").withColumn("first", first)
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (single | (F.col("is_best") & F.col("first"))).alias("kept"), "text_sha256", "key_tie")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
