"""Metric views from mergeable states: a row for each day and combination of fields, which any coarser question adds up.

Sums, counts, maxima and averages have exact states. Distinct counts of whole numbers keep a row
for each value and what it meets, never more than the fact has rows, and stay exact; of other values they are sketches with a standard error of 1.6 % (1.04 / sqrt(4096)). A new day
writes its own states only, and a day that is worked out again replaces them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.operators import changes
from spindle.sources import tables as stored

from .cubes import A, Distinct, MetricView, S

#: Binary logarithm of a sketch's number of registers.
REGISTERS = 12
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class ViewStates:
    """States of a view by ``day`` (a field that is a date) and some of its fields, for some of its measures."""

    view: MetricView
    day: str
    fields: tuple[str, ...]
    measures: tuple[str, ...]
    #: Days to a part of the kept states; an update writes the parts of its days.
    span: int = 1

    @property
    def _keys(self) -> list[str]:
        return list(dict.fromkeys([self.day, *self.fields]))

    def _plain(self) -> tuple[dict[str, Column], dict[str, tuple[str, Column]]]:
        """Measures over states, and the states, of all but distinct counts."""
        states: dict[str, tuple[str, Column]] = {}
        return {m: A.collected(self.view.measures[m], states) for m in self.measures if not isinstance(self.view.measures[m], Distinct)}, states

    def _distinct(self) -> dict[str, Distinct]:
        return {m: self.view.measures[m] for m in self.measures if isinstance(self.view.measures[m], Distinct)}

    def build(self, tables: Callable[[str], DataFrame], days: list | None = None) -> tuple[DataFrame, DataFrame | None]:
        """States of sums, and of distinct values if there are such measures; of all days or of those given (None: rows without day)."""
        rows, columns = self.view.rows(tables, self._keys)
        if days is not None:
            known = [d for d in days if d is not None]
            rows = rows.filter(columns[self.day].isin(known) | (columns[self.day].isNull() if None in days else F.lit(False)))
        keys = [columns[k].alias(k) for k in self._keys]
        sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("state_rows"), *(state.alias(name) for name, state in self._plain()[1].values()))
        parts = []
        for column in dict.fromkeys(d.column for d in self._distinct().values()):
            own = {m: F.when(d.condition(), S(column)) if d.condition else S(column) for m, d in self._distinct().items() if d.column == column}
            whole = isinstance(rows.select(S(column)).schema[0].dataType, _WHOLE)
            value = (S(column).cast("long") if whole else F.lit(None).cast("long")).alias("state_value")
            kept = lambda v, whole=whole: F.max(v.isNotNull()) if whole else F.hll_sketch_agg(v.cast("string"), F.lit(REGISTERS))
            parts.append(rows.filter(S(column).isNotNull()).groupBy(*keys, F.lit(column).alias("state_column"), value).agg(*(kept(v).alias(f"{'met' if whole else 'sketch'}_{m}") for m, v in own.items())))
        return sums, stored.union_all(*parts) if parts else None

    def answer(self, sums: DataFrame, distinct: DataFrame | None, fields: list[str] = (), measures: list[str] | None = None, where: str | None = None) -> DataFrame:
        """What ``view.query`` gives for fields and measures that the states have. where: a condition on the states' fields."""
        fields, measures = list(fields), list(self.measures if measures is None else measures)
        if unknown := [*(set(fields) - set(self._keys)), *(set(measures) - set(self.measures))]:
            raise ValueError(f"the states have no {', '.join(sorted(unknown))}")
        pick = lambda df: df.filter(where) if where else df
        plain, sources = self._plain()[0], {m: d.column for m, d in self._distinct().items() if m in measures}
        out = pick(sums).groupBy(*fields).agg(F.sum("state_rows").alias("_rows"), *(plain[m].alias(m) for m in measures if m in plain))
        for column in dict.fromkeys(sources.values()):
            own = [m for m, c in sources.items() if c == column]
            rows = pick(distinct).filter(F.col("state_column") == column)
            if f"met_{own[0]}" in rows.columns:
                values = rows.groupBy(*fields, "state_value").agg(*(F.max(f"met_{m}").alias(m) for m in own))
                found = values.groupBy(*fields).agg(*(F.count(F.when(F.col(m), 1)).alias(m) for m in own))
            else:
                found = rows.groupBy(*fields).agg(*(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{m}")).alias(m) for m in own))
            same = F.lit(True)
            for f in fields:
                same &= F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}"))
            out = out.alias("x").join(found.alias("y"), same, "left").select("x.*", *(F.coalesce(F.col(f"y.{m}"), F.lit(0)).alias(m) for m in own))
        return out.select(*fields, *measures)

    # ------------------------------------------------------------------ kept states

    def update(self, tables: Callable[[str], DataFrame], root: str, days: list | None = None) -> None:
        """Works out the states of days, or of all, and writes them in place of the days' old ones; parts of other days keep their files."""
        sums, distinct = self.build(tables, days)
        part = F.floor(F.datediff(F.col(self.day), F.lit("1970-01-01").cast("date")) / self.span)
        for kind, rows in (("sums", sums), ("distinct", distinct)):
            if rows is not None:
                stored.merge_into(rows, root, f"{self.view.name}.{kind}", lambda old, new: changes.upsert(old, new, [self.day]), [self.day], part, True)

    def query(self, spark: SparkSession, root: str, fields: list[str] = (), measures: list[str] | None = None, where: str | None = None) -> DataFrame:
        """``answer`` from the kept states."""
        distinct = stored.current(spark, root, f"{self.view.name}.distinct") if self._distinct() else None
        return self.answer(stored.current(spark, root, f"{self.view.name}.sums"), distinct, fields, measures, where)
