"""Reading and writing tables as Parquet folders under one root.

A table that is rebuilt or merged into is a folder ``<name>.table`` of data folders and numbered pointers. A pointer is a
small file that names the data folders of each part of the table; it is written aside and renamed to the next free
number, which fails if another writer has taken that, and the pointer of greatest number is the table. So a job
that is cut off at any step leaves the old table or the new one, and a merge may read what it replaces.

Merges write only parts that hold keys of the source, and new rows: other parts keep their files.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SOURCES

#: Seconds that superseded pointers and data folders are kept for readers that have begun.
KEEP = 24 * 3600
#: A part of more data folders is written anew by the next merge that adds to it.
FOLDERS = 8


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the table meanwhile; nothing of this write counts."""


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` under root; a source table's declared schema spares reading footers for it."""
    reader = spark.read.schema(SOURCES[name].ddl) if name in SOURCES else spark.read
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def create_if_absent(spark: SparkSession, root: str, name: str, ddl: str) -> DataFrame:
    """Table ``name``, made with no rows first if it isn't there."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    spark.createDataFrame([], ddl).write.mode("ignore").parquet(path)
    return spark.read.schema(ddl).parquet(path)


def append_rows(spark: SparkSession, root: str, name: str, ddl: str, rows: list[dict]) -> None:
    """Adds a few rows, as operational logs do; columns that a row lacks are null."""
    fields = [f.name for f in spark.createDataFrame([], ddl).schema]
    spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], ddl).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; where that is unset a local master gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindle-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/spindle-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ files


class _Folder:
    """A table's folder, as Hadoop's file systems see it."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.top, self._hadoop = spark, f"{root.rstrip('/')}/{name}.table", spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.top}/{name}" if name else self.top)

    def listed(self, name: str = "") -> dict[str, float]:
        """Names in a folder and when each was changed, in seconds; nothing if it isn't there."""
        where = self._path(name)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._files.listStatus(where)} if self._files.exists(where) else {}

    def text(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self._files.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Whether old got the name new, which nothing had before. One step in the file system."""
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self._conf)
        replace_nothing = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(self._path(old), self._path(new), replace_nothing)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)


@dataclass
class _State:
    """What a pointer says: its number (0: no table yet), data folders by part, and the table's schema."""

    number: int = 0
    parts: dict[int, list[str]] = field(default_factory=dict)
    schema: T.StructType | None = None


def _pointers(folder: _Folder) -> dict[int, float]:
    return {int(n): at for n, at in folder.listed("pointers").items() if n.isdigit()}


def _load(folder: _Folder, number: int) -> _State:
    held = json.loads(folder.text(f"pointers/{number:012d}"))
    return _State(number, {int(p): f for p, f in held["parts"].items()}, T.StructType.fromJson(held["schema"]))


def _newest(folder: _Folder) -> _State:
    numbers = _pointers(folder)
    return _load(folder, max(numbers)) if numbers else _State()


def _frame(folder: _Folder, state: _State, parts: Iterable[int] | None = None) -> DataFrame:
    folders = [f"{folder.top}/{f}" for p in (state.parts if parts is None else parts) for f in state.parts[p]]
    reader = folder.spark.read.schema(state.schema)
    return reader.parquet(*folders) if folders else folder.spark.createDataFrame([], state.schema)


def _commit(folder: _Folder, before: _State, parts: dict[int, list[str]], schema: T.StructType, keep: float) -> _State:
    """Makes parts the table if ``before`` still is it, then deletes what has been superseded for longer than ``keep`` seconds."""
    aside, after = f"pointers/aside-{uuid.uuid4().hex}", _State(before.number + 1, parts, schema)
    folder.write_text(aside, json.dumps({"parts": parts, "schema": schema.jsonValue()}))
    if not folder.rename(aside, f"pointers/{after.number:012d}"):
        folder.delete(aside)
        raise ConcurrentWrite(f"{folder.top} has a version {after.number} already")
    now, at = time.time(), _pointers(folder)
    old = [n for n, successor in zip(sorted(at), sorted(at)[1:]) if at[successor] + keep <= now]
    used = {f.split("/")[0] for n in at if n not in old for fs in _load(folder, n).parts.values() for f in fs}
    for n in old:
        folder.delete(f"pointers/{n:012d}")
    for name, changed in folder.listed().items():
        if name not in used and name != "pointers" and changed + keep <= now:
            folder.delete(name)
    return after


def _write(folder: _Folder, rows: DataFrame, part: Column) -> dict[int, str]:
    """Writes rows by part into a new data folder; gives the folder of each part that has rows."""
    name = uuid.uuid4().hex
    dealt = rows.withColumn("_part", F.coalesce(part.cast("long"), F.lit(-1))).hint("rebalance", "_part")
    dealt.write.partitionBy("_part").parquet(f"{folder.top}/{name}")
    return {int(n[6:]): f"{name}/{n}" for n in folder.listed(name) if n.startswith("_part=")}


def _widened(schema: T.StructType | None, rows: DataFrame) -> T.StructType:
    """The table's schema with columns that it lacks of rows."""
    out = T.StructType(list(schema or []))
    for f in rows.schema:
        if f.name not in out.names:
            out.add(T.StructField(f.name, f.dataType, True))
        elif out[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} is {out[f.name].dataType.simpleString()} in the table and {f.dataType.simpleString()} in the rows")
    return out


# ------------------------------------------------------------------ tables


def exists(spark: SparkSession, root: str, name: str) -> bool:
    """Whether ``replace``, ``append`` or ``merge_into`` has made the table."""
    return bool(_pointers(_Folder(spark, root, name)))


def current(spark: SparkSession, root: str, name: str, parts: Iterable[int] | None = None) -> DataFrame:
    """The table, or those of its parts."""
    folder = _Folder(spark, root, name)
    return _frame(folder, _newest(folder), parts)


def parts(spark: SparkSession, root: str, name: str) -> list[int]:
    """The parts of the table that have rows, in order; none if there is no table."""
    return sorted(_newest(_Folder(spark, root, name)).parts)


def replace(df: DataFrame, root: str, name: str, part: Column | None = None, keep: float = KEEP, accept: Callable[[], None] | None = None) -> DataFrame:
    """Writes df as the whole table. ``accept`` is called once the rows are written and before they count; if it raises, the table stays as it is."""
    folder = _Folder(df.sparkSession, root, name)
    before, schema = _newest(folder), _widened(None, df)
    new = {p: [f] for p, f in _write(folder, df, F.lit(0) if part is None else part).items()}
    if accept:
        accept()
    return _frame(folder, _commit(folder, before, new, schema, keep))


def append(df: DataFrame, root: str, name: str, part: Column | None = None, keep: float = KEEP) -> DataFrame:
    """Adds rows to the table; no file that it has is touched. Run again, it adds them again: merge where a job may be repeated."""
    folder = _Folder(df.sparkSession, root, name)
    before = _newest(folder)
    schema, new = _widened(before.schema, df), _write(folder, df, F.lit(0) if part is None else part)
    return _frame(folder, _commit(folder, before, before.parts | {p: [*before.parts.get(p, []), f] for p, f in new.items()}, schema, keep))


def merge_into(
    source: DataFrame, root: str, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str] | None = None, part: Column | None = None, part_of_keys: bool = False, keep: float = KEEP,
    accept: Callable[[], None] | None = None,
) -> DataFrame:
    """The table after merge(table, source), which ``changes`` has functions for; a table that isn't there yet counts as empty.

    Given the keys that merge matches rows by (nulls match), it sees and writes only the parts that hold keys of source;
    a row goes to the part that ``part`` gives for it (null: -1), and rows for other parts become one more folder there.
    Which parts hold keys is looked up in the key columns alone, or not at all if ``part_of_keys`` says that equal keys have
    equal parts. Without keys the whole table is written anew. Only the numbers of parts reach the driver.
    ``accept``: as for ``replace``.
    """
    folder = _Folder(source.sparkSession, root, name)
    before, part = _newest(folder), F.lit(0) if part is None else part
    if not before.number:
        return replace(merge(source.limit(0), source), root, name, part, keep, accept)
    touched = set(before.parts)
    if keys is not None:
        theirs = {r[0] for r in source.select(F.coalesce(part.cast("long"), F.lit(-1))).distinct().collect()}
        if part_of_keys:
            touched &= theirs
        else:
            held = F.regexp_extract(F.col("_metadata.file_path"), r"/_part=(-?\d+)/", 1).cast("long").alias("_held_in")
            table = _frame(folder, before).select(*keys, held).alias("t")
            matched = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
            condition = matched[0]
            for m in matched[1:]:
                condition &= m
            met = table.join(source.select(*keys).alias("s"), condition, "left_semi").select("_held_in").distinct().collect() if before.parts else []
            touched = {r[0] for r in met}
        touched |= {p for p in theirs if len(before.parts.get(p, ())) >= FOLDERS}
    rows = merge(_frame(folder, before, sorted(touched)), source)
    schema, new = _widened(before.schema, rows), _write(folder, rows, part)
    if accept:
        accept()
    after = {p: fs for p, fs in before.parts.items() if p not in touched}
    return _frame(folder, _commit(folder, before, after | {p: [*after.get(p, []), f] for p, f in new.items()}, schema, keep))


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Saves df as a table of the session's catalog, dealt by keys into buckets and sorted in them.

    Tables of equal numbers of buckets are joined and grouped by those keys without moving a row. Each bucket is one file:
    take about one bucket for every 200 MB of the largest of the tables that are to meet.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def tasks(df: DataFrame, most: int = 16 << 20) -> int:
    """A task for every ``most`` bytes of the files that df reads, or the session's number of partitions if that is more."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    n = -(-sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths) // most)
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: Column | str, most: int = 16 << 20) -> DataFrame:
    """df dealt by keys into a task for every ``most`` bytes of the files it reads, so that what a task holds doesn't grow with them; df itself where the session's number of partitions is enough."""
    n = tasks(df, most)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def columns_of(spark: SparkSession, database: str = "default") -> DataFrame:
    """table_name, column_name and data_type of every table and view in a database of the session's catalog."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}")]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def file_history(df: DataFrame) -> DataFrame:
    """Rows and latest file time of the files that df reads, one row a file."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("row_count"), F.max("_metadata.file_modification_time").alias("committed_at"))
