"""Labels as codes and documents as sparse vectors for Spark ML."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sorrel.plans.staging import stage


def in_order(labels) -> list:
    """Labels in the order that Spark sorts them."""
    return sorted(labels, key=lambda v: v.encode() if isinstance(v, str) else v)


def label_list(labels: DataFrame, column: str = "label") -> list:
    """Sorted distinct labels: the only label data that the driver holds."""
    rows = labels.select(column).distinct().collect()
    return in_order(r[0] for r in rows if r[0] is not None)


def label_table(labels: DataFrame, order: list | None = None) -> DataFrame:
    """``(label, code)`` with codes 0..k-1 in label order."""
    order = label_list(labels) if order is None else order
    kind = labels.schema["label"].dataType.simpleString()
    return labels.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"label {kind}, code int")


def label_index(labels: DataFrame, order: list | None = None) -> DataFrame:
    """Add the label's code; a label outside ``order`` is dropped."""
    return labels.join(F.broadcast(label_table(labels, order)), "label")


def label_inverse(codes: DataFrame, table: DataFrame) -> DataFrame:
    """Labels back from codes."""
    return codes.join(F.broadcast(table), "code")


def packed(vectors: DataFrame, key: list[str]) -> DataFrame:
    """Each document's column numbers in order, ``ids``, and their values, ``vals``; the table's own rows of that form, if it has them."""
    if getattr(vectors, "_packed", None) is not None and key == ["doc_id"]:
        return vectors._packed
    pair = F.array_sort(F.collect_list(F.struct(F.col("feature_id").cast("int").alias("ids"), F.col("value").alias("vals"))))
    return vectors.groupBy(*key).agg(pair.alias("_p")).select(*key, "_p.ids", "_p.vals")


def sparse_instances(vectors: DataFrame, docs: DataFrame, size: int, name: str = "instances") -> DataFrame:
    """One ML vector per row of ``docs``; a document without features is all zero.

    The rows are written in the storage form of an ML vector and read back as
    vectors, so no Python process touches them.
    """
    key = ["doc_id", "copy"] if "copy" in docs.columns else ["doc_id"]
    joined = docs.join(packed(vectors, key), key, "left")
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).cast("int").alias("size"),
        F.coalesce("ids", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("vals", F.array().cast("array<double>")).alias("values"),
    )
    out = joined.select(*docs.columns, vector.alias("features"))
    fields = [f for f in out.schema.fields if f.name != "features"]
    return stage(out, name, T.StructType(fields + [T.StructField("features", VectorUDT())]))


def array_features(df: DataFrame, key: str, column: str, ftype: str) -> DataFrame:
    """A dense array column as a long feature table; zeros are left out."""
    rows = df.select(F.col(key).alias("doc_id"), F.posexplode(column).alias("_i", "_v"))
    rows = rows.select(
        "doc_id", F.lit(ftype).alias("ftype"), F.format_string("d%03d", "_i").alias("feature"), F.col("_v").cast("double").alias("value")
    )
    return rows.filter(F.col("value") != 0)


def predictions(scores: DataFrame) -> DataFrame:
    """The most probable label per document; ties go to the smallest label."""
    best = F.min(F.struct((-F.col("prob")).alias("p"), "label"))
    key = [c for c in ("fold", "doc_id") if c in scores.columns]
    return scores.groupBy(*key).agg(best.alias("_b")).select(*key, F.col("_b.label").alias("prediction"))
