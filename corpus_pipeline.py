"""Corpus pipeline: language, near copies, benchmark leaks, secrets, token ids.

Each stage reads all that the one before it kept and returns the columns of
``documents``; the last returns token ids.  Other columns of the input are left
out, so they cannot clash with the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sorrel.llm import decontaminate, language, secrets, simhash, tokens
from sorrel.llm.queries import vocabulary
from sorrel.plans.staging import small_side, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without letters go.

    A missing ``lang`` is filled with the prediction; a given one stays.
    """
    model = language.fitted(docs, ~language.held_out())
    guess = docs.withColumn("_guess", language.language_column(F.col("text"), model)).filter(
        F.col("_guess.lang_pred") != language.UNKNOWN
    )
    return guess.withColumn("lang", F.coalesce("lang", "_guess.lang_pred")).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component: the one with the smallest id, nulls last."""
    return simhash.one_per_group(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked.

    Rows are told apart by id and text, so a null or repeated id takes no other row with it.
    """
    keyed = docs.withColumn("_row", F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    leaked = decontaminate.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row")
    gone = stage(leaked.select("_row").distinct(), "leaked")
    return keyed.join(small_side(gone), "_row", "left_anti").select(*COLUMNS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by a mask."""
    text = secrets.masked_column(F.col("text"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text again."""
    coded = docs.select("doc_id", "lang", "source", tokens.round_trip_column(F.col("text"), vocabulary()).alias("_x"))
    return coded.select("doc_id", "lang", "source", F.size("_x.ids").cast("long").alias("n_tokens"), "_x.ids", "_x.round_trip")


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scan", masked_secrets),
    ("bpe", token_ids),
]

# Fingerprints, alignments, classifiers and token ids cannot be written in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
