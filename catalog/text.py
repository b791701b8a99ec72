"""Queries: sources, preprocessing and features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import SENT, TOK, coo, docs, grams, quality, query, shared, table, words
from sorrel.functions import text as tx
from sorrel.operators import ngrams, preprocess, weights
from sorrel.plans.staging import assign_position, stage, staging_root
from sorrel.sources import documents as src, storage


def _path(spark, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


# ------------------------------------------------------------------------ sources


@query("read_documents", "SELECT doc_id, text FROM documents")
def read_documents(spark, sf):
    return src.read_documents(spark, f"{sf}/documents.parquet", "parquet")


@query(
    "read_documents_lines",
    "SELECT (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS doc_id, text FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)",
)
def read_documents_lines(spark, sf):
    path = _path(spark, "lines")
    rows = table(spark, sf, "benchmark").orderBy("item_id").select(F.regexp_replace("text", "\n", " ").alias("value"))
    rows.write.mode("overwrite").text(path)
    return src.read_documents(spark, path)


@query("read_tokenised", f"SELECT doc_id::BIGINT AS doc_id, md5(text) AS digest FROM (SELECT row_number() OVER (ORDER BY md5(text), item_id) - 1 AS doc_id, text FROM benchmark)")
def read_tokenised(spark, sf):
    path = _path(spark, "tokenised")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    preprocess.tokenize(bench).select("raw", "processed").write.mode("overwrite").json(path)
    back = src.read_tokenised(spark, path, multiline=False)
    ids = back.select(F.md5("raw").alias("digest")).orderBy("digest")
    return assign_position(ids, [F.col("digest").asc()], "doc_id").select("doc_id", "digest")


CSV_SQL = """
WITH wide AS (SELECT p_partkey AS doc_id, CASE WHEN p_size = 1 THEN 'NA' WHEN p_size = 2 THEN '#NULL!' ELSE p_size::VARCHAR END AS size,
  replace(p_retailprice::VARCHAR, '.', ',') AS price FROM part),
long AS (SELECT doc_id, 'size' AS feature, size AS x FROM wide UNION ALL SELECT doc_id, 'price', price FROM wide)
SELECT doc_id, 'csv' AS ftype, feature, coalesce(try_cast(replace(x, ',', '.') AS DOUBLE), 0.0) AS value FROM long
WHERE coalesce(try_cast(replace(x, ',', '.') AS DOUBLE), 0.0) <> 0
"""


@query("read_feature_csv", CSV_SQL)
def read_feature_csv(spark, sf):
    size = F.when(F.col("p_size") == 1, "NA").when(F.col("p_size") == 2, "#NULL!").otherwise(F.col("p_size").cast("string"))
    price = F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    wide = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), size.alias("size"), price.alias("price"))
    return src.feature_columns(wide)


@query("read_labels", "SELECT doc_id, CAST(quality AS VARCHAR) AS label, quality::DOUBLE AS label_num FROM labels WHERE quality IS NOT NULL")
def read_labels(spark, sf):
    return quality(spark, sf)


@query(
    "features_written_and_read",
    f"WITH {coo()} SELECT ftype, feature, sum(value) AS total, count(*) AS df FROM coo GROUP BY ftype, feature",
)
def features_written_and_read(spark, sf):
    path = _path(spark, "features")
    storage.write_features(words(spark, sf), vocabulary(spark, sf), path)
    features, _ = storage.read_features(spark, path)
    return ngrams.feature_totals(features)


@query(
    "selection_written",
    f"WITH {coo()} SELECT feature, sum(value) AS weight FROM coo GROUP BY feature ORDER BY weight DESC, feature LIMIT 500",
)
def selection_written(spark, sf):
    path = _path(spark, "selection")
    top = weights.prune_top_k(words(spark, sf), 500)
    storage.write_selection(top.select("feature", F.col("total").alias("weight"), F.col("feature_id").alias("rank")), path)
    return spark.read.csv(path, sep="\t", schema="feature string, weight double", quote='"', escape="\\")


def _written_lines(spark, rows, order, name: str) -> str:
    """Write the column ``value`` as text in the given order."""
    path = _path(spark, name)
    rows.orderBy(*order).select("value").write.mode("overwrite").text(path)
    return path


@query(
    "read_feature_csv_file",
    CSV_SQL.replace("SELECT p_partkey AS doc_id", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS doc_id"),
)
def read_feature_csv_file(spark, sf):
    """Delimited lines with missing marks and decimal commas, written and read by the reader."""
    size = F.when(F.col("p_size") == 1, "NA").when(F.col("p_size") == 2, "#NULL!").otherwise(F.col("p_size").cast("string"))
    price = F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    lines = table(spark, sf, "part").select("p_partkey", F.concat_ws(";", size, price).alias("value"))
    return src.read_feature_csv(spark, _written_lines(spark, lines, ["p_partkey"], "csv"), ";", ["size", "price"])


@query("read_labels_file", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, lang AS label FROM documents")
def read_labels_file(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" "), "lang", F.lit(" ")).alias("value"))
    return src.read_labels(spark, _written_lines(spark, lines, ["doc_id"], "labels"))


@query("vocabulary_written_and_read", f"WITH {coo()} SELECT ftype, feature, sum(value) AS total, count(*) AS df FROM coo GROUP BY ftype, feature")
def vocabulary_written_and_read(spark, sf):
    path = _path(spark, "features")
    storage.write_features(words(spark, sf), vocabulary(spark, sf), path)
    return storage.read_features(spark, path)[1].select("ftype", "feature", "total", "df")


PARTS = "SELECT p_brand, count(*) AS n, {mean} AS price FROM part GROUP BY p_brand"


def _brands(spark, sf, digits):
    price = F.round(F.avg("p_retailprice"), digits)
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), price.alias("price"))


@query("report_csv_written", PARTS.format(mean="round(round(avg(p_retailprice), 4), 2)"))
def report_csv_written(spark, sf):
    path = _path(spark, "report")
    storage.write_report_csv(_brands(spark, sf, 4), path)
    return spark.read.csv(path, header=True, schema="p_brand string, n long, price double")


@query("report_txt_written", "SELECT p_brand || '|' || n AS value FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def report_txt_written(spark, sf):
    path = _path(spark, "report")
    storage.write_report_txt(_brands(spark, sf, 4).select("p_brand", "n"), path, "|")
    return spark.read.text(path)


@query(
    "read_tokenised_tokens",
    f"WITH t AS (SELECT text, list_filter(list_transform(regexp_extract_all(text, '{SENT}'), lambda s: regexp_extract_all(s, '{TOK}')), lambda s: len(s) > 0) AS p FROM benchmark) "
    "SELECT md5(text) AS digest, len(p)::BIGINT AS n_sentences, md5(array_to_string(list_transform(p, lambda s: array_to_string(s, ' ')), '|')) AS tokens FROM t",
)
def read_tokenised_tokens(spark, sf):
    """The nested tokens of the file, not its raw texts alone."""
    path = _path(spark, "tokenised")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    preprocess.tokenize(bench).select("raw", "processed").write.mode("overwrite").json(path)
    texts = F.transform("processed", lambda s: F.array_join(F.transform(s, lambda t: t["text"]), " "))
    return src.read_tokenised(spark, path, multiline=False).select(
        F.md5("raw").alias("digest"), F.size("processed").cast("long").alias("n_sentences"), F.md5(F.array_join(texts, "|")).alias("tokens")
    )


# ------------------------------------------------------------------- preprocessing

def sentences_sql(text: str) -> str:
    parts = f"list_transform(regexp_extract_all({text}, '{SENT}'), lambda s: regexp_extract_all(s, '{TOK}'))"
    return f"list_filter({parts}, lambda s: len(s) > 0)"


def _digest_sql(sents: str) -> str:
    return (
        "SELECT doc_id, len(p)::BIGINT AS n_sentences, len(flatten(p))::BIGINT AS n_tokens, "
        "md5(array_to_string(list_transform(p, lambda s: array_to_string(s, ' ')), '|')) AS digest "
        f"FROM (SELECT doc_id, {sents} AS p FROM documents)"
    )


def _digest(df):
    texts = F.transform("processed", lambda s: F.array_join(F.transform(s, lambda t: t["text"]), " "))
    return df.select(
        "doc_id", F.size("processed").cast("long").alias("n_sentences"), F.size(F.flatten("processed")).cast("long").alias("n_tokens"),
        F.md5(F.array_join(texts, "|")).alias("digest"),
    )


@query("tokenize", f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{TOK}') AS w FROM documents)")
def tokenize(spark, sf):
    found = docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("split_sentences", _digest_sql(sentences_sql("text")))
def split_sentences(spark, sf):
    return _digest(preprocess.tokenize(docs(spark, sf)))


@query(
    "strip_punctuation",
    _digest_sql(f"list_filter(list_transform({sentences_sql('text')}, lambda s: list_filter(s, lambda t: regexp_matches(t, '{tx.WORD}'))), lambda s: len(s) > 0)"),
)
def strip_punctuation(spark, sf):
    return _digest(preprocess.tokenize(docs(spark, sf), strip_punctuation=True))


@query("lowercase", _digest_sql(sentences_sql("lower(text)")))
def lowercase(spark, sf):
    return _digest(preprocess.lowercase(preprocess.tokenize(docs(spark, sf))))


# A lexicon drawn from the benchmark texts: the first four letters as lemma, a
# tag by the word's length.
LEXICON = (
    f"lex AS (SELECT t AS text, substr(t, 1, 4) AS lemma, CASE WHEN length(t) > 3 THEN 'N(soort,ev)' ELSE 'LID(bep)' END AS pos "
    f"FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOK}')) AS t FROM benchmark))"
)


def lexicon(spark, sf):
    words_ = table(spark, sf, "benchmark").select(F.explode(tx.tokens(F.lower("text"))).alias("text")).distinct()
    tag = F.when(F.char_length("text") > 3, "N(soort,ev)").otherwise("LID(bep)")
    return words_.select("text", F.substring("text", 1, 4).alias("lemma"), tag.alias("pos"))


@shared
def annotated(spark, sf):
    lower = preprocess.lowercase(preprocess.tokenize(docs(spark, sf)))
    return preprocess.annotate(lower, lexicon(spark, sf))


ANNOTATED = (
    f"{LEXICON}, s AS (SELECT doc_id, unnest({sentences_sql('lower(text)')}) AS w, generate_subscripts({sentences_sql('lower(text)')}, 1) AS sent FROM documents), "
    "k AS (SELECT doc_id, sent, unnest(w) AS text, generate_subscripts(w, 1) AS tok FROM s), "
    "ann AS (SELECT doc_id, sent, tok, k.text, coalesce(lex.lemma, k.text) AS lemma, coalesce(split_part(lex.pos, '(', 1), 'UNK') AS pos FROM k LEFT JOIN lex ON lex.text = k.text)"
)


@query("annotate", f"WITH {ANNOTATED} SELECT doc_id, lemma, pos, count(*) AS n FROM ann GROUP BY ALL")
def annotate(spark, sf):
    rows = preprocess.token_rows(annotated(spark, sf))
    return rows.groupBy("doc_id", "lemma", "pos").agg(F.count("*").alias("n"))


@query("coarse_pos", f"WITH {LEXICON} SELECT text, split_part(pos, '(', 1) AS pos FROM lex")
def coarse_pos(spark, sf):
    return lexicon(spark, sf).select("text", tx.coarse_pos(F.col("pos")).alias("pos"))


# ------------------------------------------------------------------------ features

KEPT = "WHERE feature IN (SELECT feature FROM coo GROUP BY feature HAVING sum(value) >= {m})"
OUT = "SELECT doc_id, ftype, feature, value FROM coo "


@query("token_ngrams", f"WITH {grams((1, 2, 3))} {OUT} {KEPT.format(m=10)}")
def token_ngrams(spark, sf):
    return ngrams.token_ngrams(preprocess.sentence_tokens(docs(spark, sf), lowercase=True), (1, 2, 3), min_count=10)


@query("token_ngrams_gap", f"WITH {grams((1, 3), text='text')} {OUT} {KEPT.format(m=20)}")
def token_ngrams_gap(spark, sf):
    return ngrams.token_ngrams(preprocess.sentence_tokens(docs(spark, sf)), (3, 1), min_count=20)


def _field_sql(field: str, ftype: str) -> str:
    lists = ", ".join(
        f"list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i+{n - 1}], ' '))" for n in (1, 2)
    )
    return (
        f"WITH {ANNOTATED}, back AS (SELECT doc_id, sent, list({field} ORDER BY tok) AS w FROM ann GROUP BY doc_id, sent), "
        f"coo AS (SELECT doc_id, '{ftype}' AS ftype, feature, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest(flatten([{lists}])) AS feature FROM back) GROUP BY ALL) "
        f"{OUT} {KEPT.format(m=10)}"
    )


@query("lemma_ngrams", _field_sql("lemma", "lemmas"))
def lemma_ngrams(spark, sf):
    return ngrams.lemma_ngrams(annotated(spark, sf), (1, 2), min_count=10)


@query("pos_ngrams", _field_sql("pos", "pos"))
def pos_ngrams(spark, sf):
    return ngrams.pos_ngrams(annotated(spark, sf), (1, 2), min_count=10)


def _chars_sql(source: str, key: str, text: str, ns, name="coo") -> str:
    lead = lambda n: " || ".join(["c"] + [f"lead(c, {j}) OVER w" for j in range(1, n)])
    runs = " UNION ALL ".join(f"SELECT doc_id, g{n} AS feature FROM {name}_g WHERE g{n} IS NOT NULL" for n in ns)
    return (
        f"{name}_c AS (SELECT {key} AS doc_id, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS i FROM {source}), "
        f"{name}_g AS (SELECT doc_id, {', '.join(f'{lead(n)} AS g{n}' for n in ns)} FROM {name}_c WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
        f"{name} AS (SELECT doc_id, 'chars' AS ftype, feature, count(*)::DOUBLE AS value FROM ({runs}) GROUP BY ALL)"
    )


@query("char_ngrams", f"WITH {_chars_sql('pages', 'page_id', 'html', (2, 3))} {OUT} {KEPT.format(m=100)}")
def char_ngrams(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return ngrams.char_ngrams(pages, (2, 3), min_count=100)


@query(
    "exclude_features",
    f"WITH {grams((1, 2))} {OUT} WHERE NOT list_has_any(string_split(feature, ' '), ['the', 'de', '.', 'no']) "
    "AND feature IN (SELECT feature FROM coo GROUP BY feature HAVING sum(value) >= 20)",
)
def exclude_features(spark, sf):
    tokens = preprocess.sentence_tokens(docs(spark, sf), lowercase=True)
    return ngrams.token_ngrams(tokens, (1, 2), min_count=20, exclude=["the", "de", ".", "no"])


@query("exclude_features_table", f"WITH {coo()}, bad AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOK}')) AS word FROM benchmark) {OUT} WHERE feature NOT IN (SELECT word FROM bad)")
def exclude_features_table(spark, sf):
    bad = table(spark, sf, "benchmark").select(F.explode(tx.tokens(F.lower("text"))).alias("word"))
    return ngrams.exclude_features(words(spark, sf), bad)


@query("min_frequency", f"WITH {coo()} {OUT} {KEPT.format(m=5)}")
def min_frequency(spark, sf):
    return ngrams.min_frequency(words(spark, sf), 5)


@shared
def vocabulary(spark, sf):
    return stage(ngrams.build_vocabulary(words(spark, sf)), "vocabulary")


@query(
    "build_vocabulary",
    f"WITH {coo()}, v AS (SELECT ftype, feature, sum(value) AS total, count(*) AS df FROM coo GROUP BY ALL) "
    "SELECT ftype, feature, (row_number() OVER (ORDER BY total DESC, ftype, feature) - 1)::BIGINT AS feature_id, total, df FROM v",
)
def build_vocabulary(spark, sf):
    return vocabulary(spark, sf)


TURNS = "turns AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_id, role, text FROM conversations)"


def turns(spark, sf):
    """Turns numbered by place, so that no number of turns makes two of them alike."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return assign_position(rows, [F.col("conv_id").asc(), F.col("turn").asc()], "doc_id").select("doc_id", "role", "text")


@query(
    "combine_feature_types",
    f"WITH {TURNS}, {grams((1,), table='turns', text='text')}, {_chars_sql('turns', 'doc_id', 'text', (1,), 'ch')}, "
    "u AS (SELECT * FROM coo UNION ALL SELECT * FROM ch) SELECT ftype, feature, sum(value) AS total, count(*) AS df FROM u GROUP BY ALL",
)
def combine_feature_types(spark, sf):
    t = turns(spark, sf)
    both = ngrams.combine_feature_types(
        ngrams.token_ngrams(preprocess.sentence_tokens(t), (1,)), ngrams.char_ngrams(t, (1,))
    )
    return ngrams.feature_totals(both)
