"""Ingesting a change log as a stream: the checkpoint of the stream is what a table's checkpoint is in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindle.operators import changes


def change_stream(spark: SparkSession, path: str, ddl: str, files_a_batch: int = 1000) -> DataFrame:
    """The Parquet files of a change log as a stream; each is read once."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest_stream(stream: DataFrame, table: str, keys: list[str], kind: str, out: str, checkpoint: str, private: tuple[str, ...] = ()) -> StreamingQuery:
    """Appends each batch's new rows, published and one a record, to the folder out; runs until the source is read up.

    A batch is a folder of its own and is overwritten if it is run again, so a restart repeats no row. Records that
    several batches hold are one for readers who take ``changes.latest_per_key``.
    """
    identity = keys if kind == "event" else ["_source_record_hash", "_source_commit_version"]

    def write(batch: DataFrame, number: int) -> None:
        if not batch.filter("_change_type = 'delete'").isEmpty():
            raise ValueError("the change log has a delete")
        rows = changes.publicize(batch.filter(F.col("_change_type").isin(*changes.ADDED)), table, f"batch-{number}", private)
        changes.one_row_a_key(rows, identity, ["_source_commit_version", "_source_commit_timestamp", "_source_record_hash"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_transitions(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Transitions a window, entity type and state, with a bound on how late they may come. Needs occurred_at, entity_type, to_state."""
    return stream.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", window), "entity_type", "to_state").agg(F.count(F.lit(1)).alias("transition_count"))
