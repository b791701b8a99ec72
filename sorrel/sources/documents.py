"""Readers: documents, tokenised documents, feature columns and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from sorrel.plans.staging import assign_position

TOKEN = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lemma", "pos")])
TOKENISED = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("processed", T.ArrayType(T.ArrayType(TOKEN))),
])
# Marks of a missing number.
MISSING = ["NA", "#NULL!"]


def _lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row per line with the line's number as ``doc_id``.

    Spark numbers the lines of a split by their place in it, so the order is
    that of the file names and of the splits within a file.
    """
    rows = spark.read.text(path).select(
        F.col("value").alias(column),
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"),
    )
    placed = assign_position(rows, [F.col("_f").asc(), F.col("_b").asc(), F.col("_i").asc()], "doc_id")
    return placed.select("doc_id", column)


def read_documents(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """``(doc_id, text)`` from lines, one file per document, or Parquet."""
    if form == "parquet":
        return spark.read.parquet(path).select("doc_id", "text")
    if form == "lines":
        return _lines(spark, path, "text")
    if form != "files":
        raise ValueError(f"unknown form: {form}")
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_f"))
    # Numbers inside file names sort as numbers.
    padded = F.regexp_replace(F.regexp_replace("_f", r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    return assign_position(rows, [padded.asc(), F.col("_f").asc()], "doc_id").select("doc_id", "text")


def read_tokenised(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Nested token JSON: a list of documents with sentences of tokens per file,
    or one document per line, which large files need to be split."""
    rows = spark.read.schema(TOKENISED).json(path, multiLine=multiline)
    rows = rows.select("raw", "processed", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    placed = assign_position(rows, [F.col("_f").asc(), F.col("_i").asc()], "doc_id")
    return placed.select("doc_id", "raw", "processed")


def parse_number(text: Column) -> Column:
    """Number with a decimal point or comma; a missing mark or an empty cell is 0.0, anything else an error."""
    clean = F.trim(text)
    value = F.regexp_replace(clean, ",", ".").try_cast("double")
    bad = F.raise_error(F.concat(F.lit("not a number: "), clean)).cast("double")
    return F.when(clean.isNull() | (clean == "") | clean.isin(MISSING), F.lit(0.0)).when(value.isNull(), bad).otherwise(value)


def feature_columns(wide: DataFrame, key: str = "doc_id", ftype: str = "csv") -> DataFrame:
    """Wide text columns to the long feature table, zeros left out."""
    names = [c for c in wide.columns if c != key]
    clean = wide.select(F.col(key).alias("doc_id"), *[parse_number(F.col(f"`{c}`").cast("string")).alias(c) for c in names])
    rows = clean.unpivot("doc_id", names, "feature", "value").filter(F.col("value") != 0)
    return rows.select("doc_id", F.lit(ftype).alias("ftype"), "feature", "value")


def read_feature_csv(spark: SparkSession, path: str, sep: str = ",", names: list[str] | None = None) -> DataFrame:
    """Delimited numbers, one document per line; the columns are named or numbered.

    The widest line sets how many columns there are; shorter lines lack the last
    ones.  A line with more cells than ``names`` is an error.
    """
    lines = _lines(spark, path, "line")
    width = lines.agg(F.max(F.size(F.split("line", re.escape(sep))))).first()[0] or 0
    if names is None:
        names = [f"c{i}" for i in range(width)]
    elif width > len(names):
        raise ValueError(f"a line has {width} cells, {len(names)} are named")
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = lines.select("doc_id", F.from_csv("line", schema, {"sep": sep}).alias("r")).select("doc_id", "r.*")
    return feature_columns(cells)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, label)``, one label per line."""
    return _lines(spark, path, "label").withColumn("label", F.trim("label"))


def labels_from(table: DataFrame, key: str, column: str, numeric: str | None = None) -> DataFrame:
    """Labels out of a table, with a numeric label beside the nominal one on request."""
    cols = [F.col(key).alias("doc_id"), F.col(column).cast("string").alias("label")]
    if numeric:
        cols.append(F.col(numeric).cast("double").alias("label_num"))
    return table.select(*cols).filter(F.col("label").isNotNull())
