"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1. Its integral is the source's cumulative token
demand; a document's place in its source's running token count, put through the inverse of that demand, is its
training position. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: Hex digits of the md5 that cut each source into parts for running sums.
PART_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """One row a source: source, source_size, turn, weight, target. sizes: source, size.

    Sources by code point, null last, take the weights in turn (``turn``: 0, 1, ...). They share ``budget`` times all sizes by weight;
    a target stops at ``most`` times its source's size and the excess is shared again by weight. That process ends
    at one level L for which the targets min(most * size, L * weight) use up the budget, so L comes from running
    sums over sources in the order of most * size / weight. These sums are over one row a source, in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = by_source.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), F.col("turn") % len(weights) + 1))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = weighed.select(
        "*", (F.sum("source_size").over(everything) * budget - most * F.coalesce(F.sum("source_size").over(so_far), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0))).alias("weights_left"))
    level_holds = F.col("left") * F.col("weight") <= F.col("source_size") * most * F.col("weights_left")
    first = F.min(F.when(level_holds, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", F.col("left").alias("left"), F.col("weights_left").alias("weights_left")))).over(everything)
    return ranked.withColumn("first", first).select(
        "source", "source_size", "turn", "weight",
        F.least(F.col("source_size") * float(most), F.coalesce(F.col("first.left") * F.col("weight") / F.col("first.weights_left"), F.col("source_size") * float(most))).alias("target"))


def position(u: Column, slope: Column) -> Column:
    """The time t at which the integral of the schedule 1 + slope * (2t - 1) over 0..t is u."""
    root = F.sqrt(F.pow(1 - slope, F.lit(2)) + 4 * slope * u)
    return F.when(F.abs(slope) < 1e-9, u).otherwise((root - (1 - slope)) / (2 * slope))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, slopes: tuple[float, ...] = (-0.5, 0.5, 0.0)) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies, taken, positions, source, tie (hash of the text).

    Size is the number of words, 0 for a null or empty text. A source's documents stand in the order of the md5
    of their ids and are taken whole from the front, at most twice round, while a document's middle lies
    before the target; so a source's taken words miss the target by at most half a document. ``positions`` has
    the training position of each copy; ``slopes`` are the ramps of the schedules, which sources take in turn like the weights, however
    many there are of either. Equal rows are taken one by one; ids may repeat or be null. A text of any length is
    one document. An empty table gives an empty result.
    """
    doc, tie = F.col(id_col).cast("long"), F.xxhash64(C.text_or_empty(text_col))
    slim = C.materialize(docs.select(
        doc.alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
        # rows without an id are spread over the parts as well
        tie.alias("tie"), F.md5(F.coalesce(doc.cast("string"), F.concat(F.lit("null "), tie.cast("string")))).alias("h")))
    slim = slim.withColumn("part", F.substring("h", 1, PART_DIGITS))
    targets = C.materialize(source_targets(slim, weights, budget))
    part = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = slim.groupBy("source", "part").agg(F.sum("size").alias("part_size")).withColumn("before", F.coalesce(F.sum("part_size").over(part), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    placed = slim.alias("a").join(before.alias("b"), same & (F.col("a.part") == F.col("b.part"))).select("a.*", "before")
    run = W.partitionBy("source", "part").orderBy("h", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    slope = F.element_at(F.array(*(F.lit(float(s)) for s in slopes)), F.col("turn") % len(slopes) + 1)
    middle = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.col("start") + k * F.col("source_size") + F.col("size") / 2)
    taken = F.filter(middle, lambda m: (m <= F.col("target")) & (F.col("target") > 0))
    out = placed.alias("a").join(targets.alias("b"), same).select("a.doc_id", "a.source", "a.tie", "a.size", "b.source_size", "b.target", taken.alias("middles"), slope.alias("slope"))
    return out.select(
        "doc_id", "size", "source_size", "target", F.size("middles").alias("copies"), (F.col("size") * F.size("middles")).alias("taken"),
        F.transform("middles", lambda m: position(m / F.col("target"), F.col("slope"))).alias("positions"), "source", "tie")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The taken copies of docs, with all its columns and ``position``, range-sorted by position.

    A column of docs with that name is replaced; names that begin with _mix_ are kept for the work. Rows with the same
    id, text and source have places of their own, in the order of a hash of all columns, so reruns agree. Rows
    of which nothing is taken, such as null and empty texts of a source without target, are left out.
    """
    return _placed(docs, mixture(docs, id_col, text_col, source_col, **options).withColumn("_mix_row", F.lit(0)), id_col, text_col, source_col).drop("_mix_row")


def _placed(docs: DataFrame, plan: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The taken copies with ``position`` and ``_mix_row`` of their plan row, range-sorted by position."""
    docs = docs.drop("position")
    # of equal rows each has a plan row of its own: number both sides alike, which moves the texts once more
    single = C.ids_are_unique(docs, id_col)
    key = ["_mix_id", "_mix_source", "_mix_tie"]
    nth = lambda order: F.lit(1) if single else F.row_number().over(W.partitionBy(*key).orderBy(order))
    rows = docs.withColumns({"_mix_id": F.col(id_col).cast("long"), "_mix_source": F.col(source_col), "_mix_tie": F.xxhash64(C.text_or_empty(text_col))})
    rows = rows.withColumn("_mix_nth", nth(F.xxhash64(F.to_json(F.struct(*docs.columns)))))
    plan = plan.filter("copies > 0").select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("tie").alias("_mix_tie"), "positions", "_mix_row")
    plan = plan.withColumn("_mix_nth", nth(F.col("positions")))
    same = F.lit(True)
    for c in (*key, "_mix_nth"):
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    both = rows.alias("r").join(plan.alias("p"), same)
    out = both.select(*(F.col(f"r.{c}") for c in docs.columns), "p._mix_row", F.explode("p.positions").alias("position"))
    return out.repartitionByRange("position").sortWithinPartitions("position")


def placed_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, positions; the last two from the copies that the curriculum placed.

    The placed copies (row, words, position) are written in training order to the shared folder; whole texts aren't moved.
    ``taken`` counts the words of the placed texts, ``positions`` are where they stand, null for none. Texts of any length
    are counted whole. Nulls, repeats and empty tables: as ``mixture`` and ``curriculum`` have them.
    """
    plan = C.materialize(mixture(docs, id_col, text_col, source_col, **options).withColumn("_mix_row", F.monotonically_increasing_id()))
    words = F.coalesce(F.regexp_count(text_col, F.lit(C.WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col), F.col(text_col), F.col(source_col), words.alias("_mix_words"))
    order = C.materialize(_placed(slim, plan, id_col, text_col, source_col).select("_mix_row", "_mix_words", "position"))
    found = order.groupBy("_mix_row").agg(F.sum("_mix_words").alias("words"), F.array_sort(F.collect_list("position")).alias("places"))
    return plan.join(found, "_mix_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), F.col("places").alias("positions"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3, 1, 2])[turn % 3 + 1] AS weight, ([-0.5e0, 0.5e0, 0e0])[turn % 3 + 1] AS slope
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s)
), r AS (
  SELECT *, (sum(source_size) OVER ()) * 1.5e0 - 2 * coalesce(sum(source_size) OVER so_far, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER so_far, 0) AS weights_left,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM w WINDOW so_far AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT rest, weights_left FROM r WHERE rest * weight <= source_size * 2 * weights_left ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, slope, least(source_size * 2.0e0, l.rest * weight / l.weights_left) AS target FROM w, l
), p AS (
  SELECT doc_id, size, source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN target > 0 AND start + size / 2e0 <= target THEN 1 ELSE 0 END
                  + CASE WHEN target > 0 AND start + source_size + size / 2e0 <= target THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CASE WHEN target > 0 AND start + size / 2e0 <= target THEN round(CASE WHEN abs(slope) < 1e-9 THEN (start + size / 2e0) / target
         ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * ((start + size / 2e0) / target)) - (1 - slope)) / (2 * slope) END, 6) END AS first_position
FROM p
"""
