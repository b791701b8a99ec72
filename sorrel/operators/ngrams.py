"""Tokenised documents to feature counts, and the vocabulary over them.

A feature table is long and sparse: ``(doc_id, ftype, feature, value)``; an
absent row is a zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from sorrel.functions import text as tx
from sorrel.operators.frequent import frequent_counts
from sorrel.plans.staging import assign_position, by_document, keeps_documents, skew_join, small_side, stage, stage_by_document

KEY = ["ftype", "feature"]
# A longer list of excluded words is joined as a table.
EXCLUDE_INLINE = 500


def _counted(docs: DataFrame, grams: Column, ftype: str) -> DataFrame:
    """Count features inside each document.

    The documents are partitioned by id *before* the explode, so the counts
    need no shuffle of the far larger n-gram rows.
    """
    rows = by_document(docs).select("doc_id", F.explode(grams).alias("feature"))
    counts = rows.groupBy("doc_id", "feature").agg(F.count("*").cast("double").alias("value"))
    return counts.select("doc_id", F.lit(ftype).alias("ftype"), "feature", "value")


def word_counts(docs: DataFrame, lowercase: bool = False, ftype: str = "tokens") -> DataFrame:
    """Single words counted per document: ``token_ngrams`` of length 1 straight from the text.

    Sentences end at line breaks and after their terminators, which are tokens by themselves, so none of them
    cuts a token and the words of a text are those of its sentences.  The partitions stay those of the documents.
    """
    docs = by_document(docs)
    return keeps_documents(_counted(docs, _words(lowercase), ftype), docs._parts)


def _words(lowercase: bool) -> Column:
    return tx.tokens(F.lower("text") if lowercase else F.col("text"))


def word_totals(docs: DataFrame, lowercase: bool = False, ftype: str = "tokens") -> DataFrame:
    """``(ftype, feature, total)`` of single words straight from the text; no count per document is made."""
    totals = docs.select(F.explode(_words(lowercase)).alias("feature")).groupBy("feature").agg(F.count("*").cast("double").alias("total"))
    return totals.select(F.lit(ftype).alias("ftype"), "feature", "total")


def chosen_word_counts(docs: DataFrame, selection: DataFrame, lowercase: bool = False) -> DataFrame:
    """``(doc_id, ftype, feature, feature_id, value)`` of the selected words alone: their rows of :func:`word_counts`.

    The words of ``selection(ftype, feature, feature_id)``, numbered from 0, go to the driver.  Each text is counted where it is read;
    one shuffle of these counts, not of the texts, puts them in buckets of ``doc_id``, one row per document, from which
    the table's rows are made and which learners take as they are (``instances.packed``).
    """
    names = selection.select("feature_id", *KEY)
    words = [r["feature"] for r in names.orderBy("feature_id").collect()]
    # A model has to have a word; the empty one is in no text.
    model = CountVectorizerModel.from_vocabulary(words or [""], inputCol="_t", outputCol="_v")

    def counted(rows: DataFrame) -> DataFrame:
        texts = rows.select("doc_id", F.coalesce(_words(lowercase), F.array().cast("array<string>")).alias("_t"))
        plain = model.transform(texts).select("doc_id", F.unwrap_udt("_v").alias("_v"))
        return plain.select("doc_id", F.col("_v.indices").alias("ids"), F.col("_v.values").alias("vals"))

    repeated = stage(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if repeated.isEmpty():
        vectors = counted(docs)
    else:
        # The counts of rows that share an id, or have none, are added up.
        same, side = F.col("doc_id").eqNullSafe(F.col("_id")), small_side(repeated)
        each = counted(docs.join(side, same, "left_semi")).select("doc_id", F.explode(F.arrays_zip("ids", "vals")).alias("_z"))
        added = each.groupBy("doc_id", "_z.ids").agg(F.sum("_z.vals").alias("vals"))
        pairs = added.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ids", "vals"))).alias("_p"))
        vectors = counted(docs.join(side, same, "left_anti")).unionByName(pairs.select("doc_id", "_p.ids", "_p.vals"))
    vectors = stage_by_document(vectors, "word_vectors")
    rows = vectors.select("doc_id", F.explode(F.arrays_zip("ids", "vals")).alias("_z"))
    rows = rows.select("doc_id", F.col("_z.ids").alias("feature_id"), F.col("_z.vals").alias("value"))
    out = rows.join(F.broadcast(names), "feature_id").select("doc_id", *KEY, "feature_id", "value")
    out._packed = vectors
    return out


def _field(tokenised: DataFrame, field: str) -> Column:
    """Sentences as plain strings, whichever token form the table holds."""
    element = tokenised.schema["processed"].dataType.elementType.elementType
    if isinstance(element, T.StructType):
        return F.transform("processed", lambda s: F.transform(s, lambda t: t[field]))
    return F.col("processed")


def token_ngrams(
    tokenised: DataFrame,
    n_list=(1, 2, 3),
    min_count: int = 1,
    exclude=None,
    field: str = "text",
    ftype: str = "tokens",
) -> DataFrame:
    """Word n-grams inside a sentence, counted per document; with a ``min_count`` only those that reach it are written at all."""
    words = _field(tokenised, field)
    if min_count > 1 and n_list and min(n_list) >= 1:
        counts = frequent_counts(by_document(tokenised).select("doc_id", words.alias("processed")), sorted(set(n_list)), min_count)
        features = counts.select("doc_id", F.lit(ftype).alias("ftype"), "feature", "value")
        return features if exclude is None else exclude_features(features, exclude)
    # One list of sentences per length, so that all runs are flattened once.
    runs = lambda n: words if n == 1 else F.transform(words, lambda s: tx.ngrams(s, n))
    lists = [runs(n) for n in sorted(set(n_list))]
    grams = F.flatten(F.concat(*lists) if len(lists) > 1 else lists[0])
    features = _counted(tokenised, grams, ftype)
    if exclude is not None:
        features = exclude_features(features, exclude)
    return min_frequency(features, min_count)


def lemma_ngrams(tokenised: DataFrame, n_list=(1, 2, 3), min_count: int = 1, exclude=None) -> DataFrame:
    return token_ngrams(tokenised, n_list, min_count, exclude, "lemma", "lemmas")


def pos_ngrams(tokenised: DataFrame, n_list=(1, 2, 3), min_count: int = 1, exclude=None) -> DataFrame:
    return token_ngrams(tokenised, n_list, min_count, exclude, "pos", "pos")


def char_ngrams(docs: DataFrame, n_list=(1, 2, 3), min_count: int = 1, exclude=None, text: str = "text") -> DataFrame:
    """Character n-grams over the raw text, spaces included, no padding."""
    grams = tx.char_ngrams(F.col(text), sorted(set(n_list)))
    features = _counted(docs, grams, "chars")
    if exclude is not None and len(exclude):
        features = features.filter(~F.col("feature").isin(list(exclude)))
    return min_frequency(features, min_count)


def exclude_features(features: DataFrame, words) -> DataFrame:
    """Drop every n-gram that holds an excluded word (a list or ``(word)`` table).

    The vocabulary is cut first; the rows then follow by a join that leaves frequent
    features unshuffled.
    """
    if isinstance(words, DataFrame):
        features = stage(features, "counts")
        known = stage(features.groupBy("feature").agg(F.count("*").alias("df")), "known")
        parts = known.select("feature", F.explode(F.split("feature", " ")).alias("word"))
        bad = parts.join(small_side(words.select("word").distinct()), "word", "left_semi").select("feature").distinct()
        kept = stage(known.join(bad, "feature", "left_anti"), "kept")
        return skew_join(features, kept, ["feature"], how="left_semi").select(*features.columns)
    words = list(words)
    if not words:
        return features
    if len(words) > EXCLUDE_INLINE:
        table = features.sparkSession.createDataFrame([(w,) for w in words], "word string")
        return exclude_features(features, table)
    return features.filter(~tx.has_word(F.col("feature"), words))


def feature_totals(features: DataFrame) -> DataFrame:
    """``(ftype, feature, total, df)``: corpus count and number of documents."""
    return features.groupBy(*KEY).agg(F.sum("value").alias("total"), F.count("*").alias("df"))


def min_frequency(features: DataFrame, min_count: int) -> DataFrame:
    """Keep features with a corpus count of at least ``min_count``."""
    if min_count <= 1:
        return features
    features = stage(features, "counts")
    kept = stage(feature_totals(features).filter(F.col("total") >= min_count), "kept")
    return skew_join(features, kept, KEY, how="left_semi").select(*features.columns)


def build_vocabulary(features: DataFrame) -> DataFrame:
    """``(ftype, feature, feature_id, total, df)``, ids by descending count."""
    order = [F.col("total").desc(), F.col("ftype").asc(), F.col("feature").asc()]
    vocab = assign_position(feature_totals(features), order, "feature_id")
    return vocab.select(*KEY, "feature_id", "total", "df")


def combine_feature_types(*tables: DataFrame) -> DataFrame:
    """Features of several types side by side; the type is part of the key."""
    return reduce(DataFrame.unionByName, tables)
