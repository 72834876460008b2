"""A training-text pipeline of five of the text operators; each stage takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import bpe, exact_dedup, minhash, mixing, toxicity
from spindle.llm import common as C


def _beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work on docs, whose own columns of these names are out of its way meanwhile; of the result the columns of docs."""
    aside = {c: f"_own_{k}_of_docs" for k, c in enumerate(docs.columns) if c in names}
    return work(docs.withColumnsRenamed(aside)).drop(*names).withColumnsRenamed({v: c for c, v in aside.items()}).select(*docs.columns)


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept (doc_id, tie) names by doc_id and hash of the text; of identical rows one."""
    if C.ids_are_unique(docs):
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    key = [F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), F.xxhash64(C.text_or_empty("d.text")) == F.col("k.tie")]
    rows = docs.alias("d").join(kept.alias("k"), key[0] & key[1], "left_semi")
    tie = "_tie_of_docs"
    return rows.withColumn(tie, F.xxhash64(C.text_or_empty())).dropDuplicates(["doc_id", tie]).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not predict to be toxic.

    Null and empty texts stay; repeated rows stay or go together; without labels all stay; an empty table stays empty.
    """
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _beside(docs, ("held_out", "score", "predicted"), lambda rows: toxicity.toxicity(rows, model).filter("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one that exact dedup keeps; null and empty texts are equal.

    Of identical rows one stays; a null id comes last. An empty table stays empty.
    """
    return _keep(docs, exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", F.col("key_tie").alias("tie")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document of smallest id; documents without words all stay.

    Of identical rows one stays; a null id comes last. An empty table stays empty.
    """
    return _keep(docs, minhash.near_dedup(docs).filter("kept").select("doc_id", F.col("text_key").alias("tie")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, range-sorted by training position.

    The stage returns the columns of documents, so the position is in the order of the written files and their rows
    alone. Documents of which no copy is taken are left out; a null source is one more source; an empty table stays empty.
    """
    return _beside(docs, ("position",), mixing.curriculum)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them.

    Null and empty texts have no ids; repeated rows stay; an empty table stays empty.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash_dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: Scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a later stage has read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, C.materialize(stage(spark, docs, sf_dir))
        C.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
