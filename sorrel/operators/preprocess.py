"""Documents to tokenised documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sorrel.functions import text as tx
from sorrel.plans.staging import by_document, fits, keeps_documents, skew_join, small_batches, stage


def tokenize(docs: DataFrame, strip_punctuation: bool = False, lowercase: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, raw, processed)``.

    ``processed`` holds sentences of ``struct(text, lemma, pos)``; lemma and
    part of speech are null until :func:`annotate` fills them.
    """
    raw = F.lower("text") if lowercase else F.col("text")
    out = by_document(docs).select("doc_id", raw.alias("raw"), tx.sentences(raw).alias("_s"))
    token = lambda t: F.struct(
        t.alias("text"), F.lit(None).cast("string").alias("lemma"), F.lit(None).cast("string").alias("pos")
    )
    kept = (lambda s: tx.strip_punctuation(s)) if strip_punctuation else (lambda s: s)
    processed = F.filter(F.transform("_s", lambda s: F.transform(kept(s), token)), lambda s: F.size(s) > 0)
    return keeps_documents(out.select("doc_id", "raw", processed.alias("processed")))


def sentence_tokens(docs: DataFrame, strip_punctuation: bool = False, lowercase: bool = False) -> DataFrame:
    """``(doc_id, processed array<array<string>>)``: the lean form for counting."""
    raw = F.lower("text") if lowercase else F.col("text")
    words = tx.sentences(raw)
    if strip_punctuation:
        words = F.filter(F.transform(words, tx.strip_punctuation), lambda s: F.size(s) > 0)
    return keeps_documents(by_document(docs).select("doc_id", words.alias("processed")))


def lowercase(tokenised: DataFrame, lower_lemma: bool = False) -> DataFrame:
    """Lower-case raw text and token text; lemmas only on request, tags never."""
    lemma = (lambda t: F.lower(t["lemma"])) if lower_lemma else (lambda t: t["lemma"])
    token = lambda t: F.struct(F.lower(t["text"]).alias("text"), lemma(t).alias("lemma"), t["pos"].alias("pos"))
    out = tokenised.withColumn("raw", F.lower("raw")).withColumn(
        "processed", F.transform("processed", lambda s: F.transform(s, token))
    )
    return keeps_documents(out) if getattr(tokenised, "_by_document", False) else out


def token_rows(tokenised: DataFrame) -> DataFrame:
    """One row per token: ``(doc_id, sent, tok, text, lemma, pos)``."""
    sents = tokenised.select("doc_id", F.posexplode("processed").alias("sent", "_s"))
    return sents.select("doc_id", "sent", F.posexplode("_s").alias("tok", "_t")).select("doc_id", "sent", "tok", "_t.*")


def annotate(tokenised: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Fill lemma and coarse part of speech from ``lexicon(text, lemma, pos)``.

    A token that the lexicon lacks keeps its own text as lemma and gets the tag
    ``UNK``.  A lexicon within the broadcast limit meets the tokens where their documents are; of a
    larger one, frequent words are joined by broadcast, the rest by shuffle.
    """
    entries = lexicon.groupBy("text").agg(F.min(F.struct("lemma", "pos")).alias("_e"))
    entries = stage(entries.select("text", F.col("_e.lemma").alias("lemma"), tx.coarse_pos(F.col("_e.pos")).alias("pos")), "lexicon")
    if not fits(entries):
        return _joined(tokenised, entries).select("doc_id", "raw", "processed")
    docs = tokenised if getattr(tokenised, "_by_document", False) else by_document(tokenised)
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return keeps_documents(docs.select("doc_id", "raw", _told(F.col("processed"), entries).alias("processed")))
    return keeps_documents(_looked_up(tokenised, entries).select("doc_id", "raw", "processed"))


def _told(processed: Column, entries: DataFrame) -> Column:
    """``processed`` annotated by a lexicon on the driver, each row by itself; sentences without a token go, unless the row has no other."""
    spark = entries.sparkSession
    small_batches(spark)
    table = entries.filter("text IS NOT NULL").select("text", "lemma", "pos").toArrow().combine_chunks()
    known = spark.sparkContext.broadcast([table[c].combine_chunks().cast(pa.string()) for c in ("text", "lemma", "pos")])

    def look_up(rows: pa.Array) -> pa.Array:
        words, lemmas, tags = known.value
        ends = rows.offsets.to_numpy() if len(rows.values) else np.zeros(len(rows) + 1, np.int32)
        # An array without a value need not have an offset.
        borders = rows.values.offsets.to_numpy() if len(rows.values) else np.zeros(1, np.int32)
        tokens = rows.values.values.slice(borders[ends[0]], borders[ends[-1]] - borders[ends[0]])
        coded = tokens.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=words)
        lemma = pc.coalesce(lemmas.take(place), coded.dictionary).take(coded.indices)
        tag = pc.fill_null(tags.take(place).take(coded.indices), "UNK")
        borders = borders[ends[0] : ends[-1] + 1] - borders[ends[0]]
        full = np.flatnonzero(np.diff(borders))
        sentences = pa.ListArray.from_arrays(pa.array(borders[np.append(full, len(borders) - 1)], pa.int32()), pa.StructArray.from_arrays([tokens, lemma, tag], ["text", "lemma", "pos"]))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(full, ends - ends[0]), pa.int32()), sentences)

    kind = "array<array<struct<text:string,lemma:string,pos:string>>>"
    texts = F.transform(processed, lambda s: F.transform(s, lambda t: t["text"]))
    told = F.arrow_udf(look_up, kind)(texts)
    return F.when(F.exists(processed, lambda s: F.size(s) > 0), told).otherwise(processed)


def _looked_up(tokenised: DataFrame, entries: DataFrame) -> DataFrame:
    """Tokens annotated by a broadcast lexicon inside the partitions of the documents, so that no token is shuffled or written.

    Rows that share an id share the tokens of all of them, sentence by sentence; rows without an id stay as they are.
    """
    docs = tokenised if getattr(tokenised, "_by_document", False) else by_document(tokenised)
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    bare = F.when(F.size(F.flatten("processed")) <= 0, F.col("processed"))
    docs = docs.select("doc_id", alone.alias("_alone"), "processed", F.struct("raw", bare.alias("bare")).alias("_row"))
    sents = docs.select("doc_id", "_alone", "_row", F.posexplode_outer("processed").alias("sent", "_s"))
    # What is kept of a row itself goes with its first token only.
    sents = sents.withColumn("_row", F.when(F.coalesce("sent", F.lit(0)) == 0, F.col("_row")))
    rows = sents.select("doc_id", "_alone", "sent", "_row", F.posexplode_outer("_s").alias("tok", "_t"))
    rows = rows.select("doc_id", "_alone", "sent", "tok", F.when(F.coalesce("tok", F.lit(0)) == 0, F.col("_row")).alias("_row"), "_t.*")
    known = F.broadcast(entries.select(F.col("text").alias("_text"), F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos")))
    has_id = F.col("doc_id").isNotNull()
    lemma = F.when(has_id, F.coalesce("_lemma", "text")).otherwise(F.col("lemma"))
    pos = F.when(has_id, F.coalesce("_pos", F.lit("UNK"))).otherwise(F.col("pos"))
    told = F.struct("text", lemma.alias("lemma"), pos.alias("pos"))
    token = F.when(F.col("tok").isNotNull(), F.struct("tok", told.alias("t")))
    joined = rows.join(known, F.col("text") == F.col("_text"), "left")
    done = joined.groupBy("doc_id", "_alone", "sent").agg(F.array_sort(F.collect_list(token)).alias("_s"), F.collect_list("_row").alias("_rows"))
    sent = F.when(F.size("_s") > 0, F.struct("sent", F.transform("_s", lambda x: x["t"]).alias("s")))
    whole = done.groupBy("doc_id", "_alone").agg(F.array_sort(F.collect_list(sent)).alias("_s"), F.flatten(F.collect_list("_rows")).alias("_rows"))
    each = whole.select("doc_id", F.transform("_s", lambda x: x["s"]).alias("_p"), F.explode("_rows").alias("_row"))
    return each.select("doc_id", "_row.raw", F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.col("_row.bare")).alias("processed"))


def _joined(tokenised: DataFrame, entries: DataFrame) -> DataFrame:
    """Tokens annotated by a join with a lexicon of any size."""
    rows = stage(token_rows(tokenised).select("doc_id", "sent", "tok", "text"), "tokens")
    words = rows.groupBy("text").agg(F.count("*").alias("df"))
    table = stage(
        words.join(entries, "text", "left").select(
            "text", "df", F.coalesce("lemma", "text").alias("lemma"), F.coalesce("pos", F.lit("UNK")).alias("pos")
        ),
        "words",
    )
    joined = skew_join(rows, table, ["text"]).drop("df")
    token = F.struct("tok", F.struct("text", "lemma", "pos").alias("t"))
    sents = joined.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(token)).alias("_s"))
    sents = sents.select("doc_id", F.struct("sent", F.transform("_s", lambda x: x["t"]).alias("s")).alias("_s"))
    whole = sents.groupBy("doc_id").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    done = whole.select("doc_id", F.transform("_s", lambda x: x["s"]).alias("_p"))
    return tokenised.join(done, "doc_id", "left").withColumn("processed", F.coalesce("_p", F.col("processed")))
