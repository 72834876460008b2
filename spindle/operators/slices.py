"""Windows over keys of any number of rows: a key with too many is cut into slices, each a group of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that one window group may have.
MOST = 1_000_000
#: Slices of a key at most, as the places of cuts are kept in one row a key.
SLICES = 4096


def _same(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _place(at: Column, cuts: Column) -> Column:
    """How many of the sorted cuts, SLICES - 1 at most, are less than at, by halving; 0 where either is null."""
    steps = [SLICES >> k for k in range(1, SLICES.bit_length())]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, step: F.when(F.get(cuts, found + step - 1) < at, found + step).otherwise(found))


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def limit(rows: DataFrame, key: str | list[str], times: int, most: int = MOST) -> int | None:
    """``most`` for windows over what is made of rows, ``times`` rows of a key from each at most; None, any key is one group, if no key can have more than ``most``.

    Runs a count of keys. It spares the windows their own counts, each of which would make their rows once more.
    """
    largest = rows.groupBy(*_names(key)).agg(F.count(F.lit(1)).alias("_walk_n")).agg(F.max("_walk_n")).first()[0] or 0
    return most if times * largest > most else None


def cuts(rows: DataFrame, key: str | list[str], by: str, most: int) -> DataFrame | None:
    """key and _walk_cuts, values of ``by`` (numbers or times) that cut each key of more than ``most`` rows into slices of about that many; None if there is no such key.

    Runs a count of keys, and for keys above the limit, of which there can't be more than rows / most, approximate
    quantiles. Both combine within tasks. Rows of one value of ``by`` stay together.
    """
    keys = _names(key)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_walk_n")).filter(F.col("_walk_n") > most)
    top = counts.agg(F.max("_walk_n")).first()[0]
    if top is None:
        return None
    pieces = min(-(-top // most), SLICES)
    hot = rows.alias("r").join(counts.alias("h"), _same("r", "h", keys), "left_semi")
    return hot.groupBy(*keys).agg(F.percentile_approx(by, [k / pieces for k in range(1, pieces)], 10 * SLICES).alias("_walk_cuts"))


def walk(
    rows: DataFrame, key: str | list[str], order: list[str], lag: dict[str, str] | None = None, lead: dict[str, str] | None = None, index: str | None = None, sums: dict[str, str] | None = None, most: int | None = MOST,
) -> DataFrame:
    """rows with values of the row before (lag: new column by column) and after (lead), sums up to each row, and its number in its key.

    The same as windows by key in rising order of ``order``, nulls first; rows that tie in all of it have no defined order.
    A key of more than ``most`` rows is worked on in slices by the first column of the order: a slice finds its own rows'
    neighbours, and its ends get theirs from a window over one row a slice. ``most`` None: any key is one group.
    """
    lag, lead, sums, keys = lag or {}, lead or {}, sums or {}, _names(key)
    where = cuts(rows, key, order[0], most) if most is not None else None
    if where is None:
        over = W.partitionBy(*keys).orderBy(*order)
        new = {n: F.lag(c).over(over) for c, n in lag.items()} | {n: F.lead(c).over(over) for c, n in lead.items()}
        new |= {n: F.sum(c).over(over.rowsBetween(W.unboundedPreceding, 0)) for c, n in sums.items()}
        return rows.withColumns(new | ({index: F.row_number().over(over)} if index else {}))
    cut = rows.alias("r").join(where.alias("w"), _same("r", "w", keys), "left").select("r.*", _place(F.col(f"r.{order[0]}"), F.col("w._walk_cuts")).alias("_walk_slice"))
    over = W.partitionBy(*keys, "_walk_slice").orderBy(*order)
    local = cut.withColumns({f"_walk_lag_{n}": F.lag(c).over(over) for c, n in lag.items()} | {f"_walk_lead_{n}": F.lead(c).over(over) for c, n in lead.items()} | {f"_walk_sum_{n}": F.sum(c).over(over.rowsBetween(W.unboundedPreceding, 0)) for c, n in sums.items()} | {"_walk_at": F.row_number().over(over), "_walk_left": F.lead(F.lit(1)).over(over)})
    place = F.struct(*order)
    # a constant stands in for no columns at all
    ends = cut.groupBy(*keys, "_walk_slice").agg(
        F.count(F.lit(1)).alias("_walk_n"), F.max_by(F.struct(F.lit(1).alias("_"), *lag), place).alias("_walk_last"), F.min_by(F.struct(F.lit(1).alias("_"), *lead), place).alias("_walk_first"),
        *(F.sum(c).alias(f"_walk_sum_{n}") for c, n in sums.items()))
    along = W.partitionBy(*keys).orderBy("_walk_slice")
    past = along.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "_walk_slice", *(F.sum(f"_walk_sum_{n}").over(past).alias(f"_walk_past_{n}") for n in sums.values()), F.lag("_walk_last").over(along).alias("_walk_before"), F.lead("_walk_first").over(along).alias("_walk_after"), F.coalesce(F.sum("_walk_n").over(past), F.lit(0)).alias("_walk_base"))
    both = local.alias("l").join(ends.alias("e"), _same("l", "e", [*keys, "_walk_slice"]))
    out = [F.col(f"l.{c}") for c in rows.columns]
    out += [F.when(F.col("_walk_at") == 1, F.col(f"_walk_before.{c}")).otherwise(F.col(f"_walk_lag_{n}")).alias(n) for c, n in lag.items()]
    out += [F.when(F.col("_walk_left").isNull(), F.col(f"_walk_after.{c}")).otherwise(F.col(f"_walk_lead_{n}")).alias(n) for c, n in lead.items()]
    # a sum is null until a value comes that isn't
    total = lambda n: F.when(F.col(f"_walk_past_{n}").isNull(), F.col(f"_walk_sum_{n}")).otherwise(F.col(f"_walk_past_{n}") + F.coalesce(F.col(f"_walk_sum_{n}"), F.lit(0)))
    out += [total(n).alias(n) for n in sums.values()]
    return both.select(*out, *([(F.col("_walk_base") + F.col("_walk_at")).cast("int").alias(index)] if index else []))
