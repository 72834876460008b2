"""The registered queries of the text operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, exact_dedup, lm, minhash, mixing, runs, secrets, sentence_dedup, suffix_dedup, toxicity, webpages, whitening

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), VOCAB)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.secret_digest(docs, secrets.fit(secrets.labelled_samples(docs)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed_digest(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("first_position"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_documents(spark, sf_dir))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_digest(_documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).drop("key_tie")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_documents(spark, sf_dir)).drop("text_key")


def op10_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.sentence_dedup(_documents(spark, sf_dir), steady=True)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_suffix_dedup": op2_suffix_dedup, "op3_bpe": op3_bpe, "op4_secrets": op4_secrets, "op5_mixing": op5_mixing, "op6_lm": op6_lm, "op7_audio": op7_audio, "op8_exact_dedup": op8_exact_dedup, "op9_minhash": op9_minhash, "op10_sentence_dedup": op10_sentence_dedup,
           "op11_runs": op11_runs, "op12_whitening": op12_whitening, "op13_html": op13_html}
ORACLE_SQL = {"op5_mixing": mixing.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL}
