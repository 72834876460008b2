"""What the text operators share: the word pattern, document keys and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts have it: space and the five ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary one; on a cluster that would be a folder of each machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindle-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spindle-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and the planner knows the size.

    All tables of an application are in one folder, ``spindle-`` and its id. ``discard`` deletes one that no result
    needs any more, ``clear`` all that are left.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindle_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote. Nothing that is still to run may read it."""
    for df in tables:
        if path := getattr(df, "_spindle_path", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote by ``materialize``; results that read them are gone too."""
    _delete(spark, _scratch(spark))


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt out anew if they come from fewer files than there are cores: a file of one row group is one task, however long the work on it takes."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 0 < len(docs.inputFiles()) < cores else docs


def by_share(docs: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of docs, those whose hash of key is in so small a part of all hashes; all rows if there are fewer.

    A filter with a threshold from the number of rows, so that no task sees more than its own share of the sample.
    Rows of one key go together.
    """
    n = docs.count()
    return docs if n <= most else docs.filter(F.xxhash64(key) < int(-(2**63) + 2**64 * (most / n)))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str, folds: int) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by folds; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 2, F.lit(False))


@dataclass(frozen=True)
class Profile:
    """Bytes of all texts, for sizing buckets, and whether no id is null or occurs twice."""

    n_bytes: int
    unique: bool


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Profile:
    """One pass over docs."""
    n, known, size = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col(id_col).cast("long")), F.sum(F.octet_length(text_col))).first()
    return Profile(int(size or 0), n == known)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 places where they begin."""
    parts = [t.encode("utf-8") for t in texts]
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), at


def chunks(texts: list[str], limit: int = 8 << 20):
    """Index ranges of texts of about limit characters each; a longer text has a range of its own."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A random 64-bit value for each byte, and odd multipliers of the rolling hashes.
_OF_BYTE = np.random.default_rng(20240521).integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG_STEP = np.uint64(0xD1B54A32D192ED03)


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hash(values: np.ndarray, lengths: np.ndarray, step: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of values; runs lie end to end and none is empty."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(values * powers(step, int(lengths.max()))[place], starts)
    return mix64(sums + lengths.astype(np.uint64) * _STEP)


class Words:
    """The words of texts: their bytes, where each begins and ends, and each text's first word.

    ``at`` and ``first`` have n + 1 entries: where a text begins in ``data``, and its first word's number.
    """

    def __init__(self, texts: list[str], lower: bool = False):
        parts = [t.encode("utf-8") for t in texts]
        raw = b"\n".join(parts) + b"\n"
        self.raw = raw.lower() if lower else raw  # lower() of bytes changes A-Z only
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        blank = _BLANK[self.data]
        turns = np.flatnonzero(np.diff(blank, prepend=True))
        self.starts, self.ends = turns[::2], turns[1::2]
        self.first = np.searchsorted(self.starts, self.at)
        self.blank = blank

    def hashes(self) -> np.ndarray:
        return run_hash(_OF_BYTE[self.data[~self.blank]], self.ends - self.starts, _STEP)

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


def hash_runs(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of hashes."""
    return run_hash(hashes, lengths, _LONG_STEP)


def hash_ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for step, k in zip(powers(_LONG_STEP, n), range(n)):
        out += hashes[k : k + count] * step
    return mix64(out + np.full(1, n, np.uint64) * _STEP)


def ids_are_unique(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no id is null or occurs twice."""
    n, known = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col(id_col).cast("long"))).first()
    return n == known


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unique: bool | None = None) -> DataFrame:
    """ord, doc_id and text of every row: ord is a number of each distinct id and text, in the order of ids, null last.

    Where ids are unique they are the numbers. Identical rows share a number and so count as one document.
    ``unique`` says so if it is known.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    if ids_are_unique(docs, id_col) if unique is None else unique:
        # never null, so joins on it add no filter and can share one exchange
        return slim.select(F.coalesce("doc_id", F.lit(0)).alias("ord"), "doc_id", "text")
    slim = slim.withColumns({"_null": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_tie": F.xxhash64("text")})
    key = ["_null", "_id", "_tie"]
    numbers = materialize(slim.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key).withColumn("ord", F.monotonically_increasing_id()))
    return slim.join(numbers, key).select(F.coalesce("ord", F.lit(0)).alias("ord"), "doc_id", "text")


def buckets_for(spark: SparkSession, total_bytes: int, each: int = 32 << 20) -> int:
    """A number of buckets that keeps what a bucket holds bounded as the input grows."""
    return max(4 * partitions(spark), -(-total_bytes // each))


def deal(bucket: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The numbers of the rows of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(order)])]


def by_bucket(rows: DataFrame, n_buckets: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work on all rows of each bucket (column ``bucket``, 0 to n_buckets - 1), one bucket at a time.

    Buckets are dealt to partitions in turn, as hashing a few small numbers would leave some partitions with many.
    """
    n = min(n_buckets, max(1, partitions(rows.sparkSession)))
    dealt = rows.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")
    at = rows.columns.index("bucket")

    def run(batches):
        held, now = [], None
        for batch in batches:
            number = batch.column(at).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and number[a] != now:
                        yield from work(pa.Table.from_batches(held)).to_batches()
                        held = []
                    now = number[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(run, schema)
