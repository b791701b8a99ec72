"""Queries: weights, scaling, balance and feature selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.base import LANG, QUALITY, SOURCE, coo, docs, lang, quality, query, r6, shared, six, source, table, whole, words
from sorrel.operators import balance as bal, instances, ngrams, scaling, selection as fs, weights
from sorrel.plans.staging import stage

TOP = "top AS (SELECT feature FROM coo GROUP BY feature ORDER BY sum(value) DESC, feature LIMIT {k})"


@shared
def top_words(spark, sf):
    """The 100 most frequent words of all documents."""
    chosen = stage(weights.prune_top_k(words(spark, sf), 100), "top")
    return stage(weights.select_features(words(spark, sf), chosen).drop("feature_id"), "top_words")


# -------------------------------------------------------------------- frequencies


@query("feature_frequency", f"WITH {coo()} SELECT ftype, feature, sum(value)::BIGINT AS frequency FROM coo GROUP BY ALL")
def feature_frequency(spark, sf):
    return whole(weights.feature_frequency(words(spark, sf)), "frequency")


@query(
    "feature_frequency_in_label",
    f"WITH {coo()}, {LANG} SELECT ftype, feature, sum(value)::BIGINT AS frequency FROM coo JOIN lab USING (doc_id) WHERE label = 'de' GROUP BY ALL",
)
def feature_frequency_in_label(spark, sf):
    return whole(weights.feature_frequency(words(spark, sf), lang(spark, sf), "de"), "frequency")


@query("label_frequency", f"WITH {SOURCE} SELECT label, count(*) AS n FROM lab GROUP BY label")
def label_frequency(spark, sf):
    return weights.label_frequency(source(spark, sf))


@query(
    "label_feature_frequency",
    f"WITH {coo()}, {LANG} SELECT label, ftype, feature, sum(value)::BIGINT AS frequency, count(*) AS df FROM coo JOIN lab USING (doc_id) GROUP BY ALL",
)
def label_feature_frequency(spark, sf):
    return whole(weights.label_feature_frequency(words(spark, sf), lang(spark, sf)), "frequency")


N = "(SELECT count(*) FROM documents)"


@query(
    "idf_log10",
    f"WITH {coo()}, f AS (SELECT ftype, feature, sum(value) AS frequency FROM coo GROUP BY ALL) SELECT *, {r6(f'log10({N}::DOUBLE / frequency)')} AS idf FROM f",
)
def idf_log10(spark, sf):
    return six(weights.idf_log10(words(spark, sf), docs(spark, sf).count()), "idf")


IDF = f"idf AS (SELECT ftype, feature, count(*) AS df, ln((1.0 + {N}) / (1.0 + count(*))) + 1.0 AS idf FROM coo GROUP BY ALL)"


@query("idf_smooth", f"WITH {coo()}, {IDF} SELECT ftype, feature, df, {r6('idf::DOUBLE')} AS idf FROM idf")
def idf_smooth(spark, sf):
    return six(weights.idf_smooth(words(spark, sf), docs(spark, sf).count()), "idf")


@query("information_gain", f"""
WITH {coo()}, {LANG}, n AS (SELECT count(*)::DOUBLE AS n FROM lab), nl AS (SELECT label, count(*)::DOUBLE AS n FROM lab GROUP BY label),
h AS (SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT n, sum(n) OVER () AS t FROM nl)),
f AS (SELECT feature, count(*)::DOUBLE AS df FROM coo GROUP BY feature),
c AS (SELECT feature, label, count(*)::DOUBLE AS c FROM coo JOIN lab USING (doc_id) GROUP BY ALL),
x AS (SELECT f.feature, f.df, nl.n AS nl, coalesce(c.c, 0) AS c FROM f CROSS JOIN nl LEFT JOIN c ON c.feature = f.feature AND c.label = nl.label),
g AS (SELECT feature, df, -sum(CASE WHEN c > 0 THEN c / df * log2(c / df) ELSE 0 END) AS hp,
  -sum(CASE WHEN nl > c THEN (nl - c) / (n - df) * log2((nl - c) / (n - df)) ELSE 0 END) AS ha, max(n) AS n FROM x, n GROUP BY feature, df)
SELECT 'tokens' AS ftype, feature, df::BIGINT AS df, {r6('h - df / n * hp - (n - df) / n * ha')} AS gain FROM g, h
""")
def information_gain(spark, sf):
    return six(weights.information_gain(words(spark, sf), lang(spark, sf)), "gain")


CORR = f"""
WITH {coo()}, y AS (SELECT doc_id, n_chars::DOUBLE AS y FROM documents), s AS (SELECT count(*)::DOUBLE AS n, sum(y) AS sy, sum(y * y) AS syy FROM y),
f AS (SELECT ftype, feature, sum(value) AS sx, sum(value * value) AS sxx, sum(value * y) AS sxy FROM coo JOIN y USING (doc_id) GROUP BY ALL),
r AS (SELECT ftype, feature, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
  THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) END AS r FROM f, s)
"""


def length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("label_num"))


@query("label_correlation", f"{CORR} SELECT ftype, feature, {r6('r')} AS r FROM r")
def label_correlation(spark, sf):
    return six(weights.label_correlation(words(spark, sf), length(spark, sf), with_p=False), "r")


@query("label_correlation_p")
def label_correlation_p(spark, sf):
    return six(weights.label_correlation(words(spark, sf), length(spark, sf)), "r", "p")


# ------------------------------------------------------------------------- weights


@query("weight_binary", f"WITH {coo()} SELECT doc_id, ftype, feature, 1.0::DOUBLE AS value FROM coo")
def weight_binary(spark, sf):
    return weights.weight_binary(words(spark, sf))


@query("weight_frequency", f"WITH {coo()} SELECT doc_id, ftype, feature, value FROM coo")
def weight_frequency(spark, sf):
    return weights.weight_frequency(words(spark, sf))


@query(
    "weight_tfidf",
    f"WITH {coo()}, {IDF}, w AS (SELECT c.doc_id, c.ftype, c.feature, c.value * i.idf AS w FROM coo c JOIN idf i USING (feature)) "
    f"SELECT doc_id, ftype, feature, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS value FROM w",
)
def weight_tfidf(spark, sf):
    idf = stage(weights.idf_smooth(words(spark, sf), docs(spark, sf).count()), "idf")
    return six(weights.weight_tfidf(words(spark, sf), idf), "value")


@query("normalize_l1", f"WITH {coo()} SELECT doc_id, ftype, feature, {r6('value / sum(abs(value)) OVER (PARTITION BY doc_id)')} AS value FROM coo")
def normalize_l1(spark, sf):
    return six(weights.normalize_l1(words(spark, sf)), "value")


@query(
    "prune_top_k",
    f"WITH {coo()} SELECT ftype, feature, (row_number() OVER (ORDER BY sum(value) DESC, feature) - 1)::BIGINT AS feature_id, sum(value) AS total, count(*) AS df "
    "FROM coo GROUP BY ftype, feature ORDER BY total DESC, feature LIMIT 5000",
)
def prune_top_k(spark, sf):
    return whole(weights.prune_top_k(words(spark, sf)), "feature_id")


RANKED = "sel AS (SELECT feature, (row_number() OVER (ORDER BY sum(value) DESC, feature) - 1)::BIGINT AS feature_id FROM {t} GROUP BY feature ORDER BY sum(value) DESC, feature LIMIT {k})"


@query("select_features", f"WITH {coo()}, {RANKED.format(t='coo', k=1000)} SELECT doc_id, ftype, feature, feature_id, value FROM coo JOIN sel USING (feature)")
def select_features(spark, sf):
    chosen = stage(weights.prune_top_k(words(spark, sf), 1000), "chosen")
    return whole(weights.select_features(words(spark, sf), chosen), "feature_id")


@query(
    "align",
    f"WITH {coo()}, {coo('benchmark', 'item_id', name='test')}, {RANKED.format(t='coo', k=5000)} SELECT doc_id, ftype, feature, feature_id, value FROM test JOIN sel USING (feature)",
)
def align(spark, sf):
    from sorrel.operators import preprocess

    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    test = ngrams.token_ngrams(preprocess.sentence_tokens(bench, lowercase=True), (1,))
    chosen = stage(weights.prune_top_k(words(spark, sf)), "chosen")
    return whole(weights.align(test, chosen), "feature_id")


def vectors(spark, sf):
    return instances.array_features(table(spark, sf, "embeddings"), "vec_id", "embedding", "dense")


DENSE = "dense AS (SELECT vec_id AS doc_id, 'd' || lpad((generate_subscripts(embedding, 1) - 1)::VARCHAR, 3, '0') AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def _minmax_sql(lo: float, hi: float) -> str:
    return f"""
WITH {DENSE}, s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM dense GROUP BY feature),
x AS (SELECT doc_id, feature, (value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * {hi - lo} + {lo} AS v FROM dense JOIN s USING (feature))
SELECT doc_id, 'dense' AS ftype, feature, {r6('v')} AS value FROM x WHERE v <> 0"""


def _minmax(spark, sf, lo, hi):
    v = stage(vectors(spark, sf), "dense")
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    scaler = scaling.fit_minmax(v, ids.count())
    return six(scaling.apply_minmax(v, scaler, ids, lo, hi), "value")


@query("scale_minmax", _minmax_sql(0.0, 1.0))
def scale_minmax(spark, sf):
    return _minmax(spark, sf, 0.0, 1.0)


@query("scale_minmax_signed", _minmax_sql(-1.0, 1.0))
def scale_minmax_signed(spark, sf):
    return _minmax(spark, sf, -1.0, 1.0)


@query(
    "scale_minmax_sparse",
    f"WITH {coo()}, {TOP.format(k=100)}, s AS (SELECT feature, CASE WHEN count(*) < {N} THEN 0 ELSE min(value) END AS lo, max(value) AS hi FROM coo JOIN top USING (feature) GROUP BY feature) "
    f"SELECT doc_id, ftype, feature, {r6('(value - lo) / (hi - lo)')} AS value FROM coo JOIN s USING (feature) WHERE value <> lo",
)
def scale_minmax_sparse(spark, sf):
    v = top_words(spark, sf)
    ids = docs(spark, sf).select("doc_id")
    return six(scaling.apply_minmax(v, scaling.fit_minmax(v, ids.count()), ids), "value")


def _balance_sql(lab: str, goal: str, source: str = "lab") -> str:
    return f"""
WITH {lab}, c AS (SELECT label, count(*) AS n FROM {source} GROUP BY label), g AS (SELECT {goal} AS goal FROM c),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42_' || doc_id::VARCHAR), doc_id) AS r FROM {source}),
k AS (SELECT doc_id, label, goal // n + (r <= goal % n)::INT AS k FROM r JOIN c USING (label), g)
SELECT doc_id, unnest(range(k::BIGINT))::BIGINT AS copy, label FROM k WHERE k > 0"""


@query("balance_two_labels", _balance_sql(QUALITY, "floor(avg(n))::BIGINT"))
def balance_two_labels(spark, sf):
    return bal.balance(quality(spark, sf))


@query("balance_many_labels", _balance_sql(LANG, "floor(median(n))::BIGINT"))
def balance_many_labels(spark, sf):
    return bal.balance(lang(spark, sf))


@query("balance_to_rarest", _balance_sql(LANG, "min(n)::BIGINT"))
def balance_to_rarest(spark, sf):
    return bal.balance(lang(spark, sf), target="min")


@query(
    "hstack",
    f"WITH {coo()}, u AS (SELECT * FROM coo UNION ALL SELECT doc_id, 'csv', 'n_chars', n_chars::DOUBLE FROM documents WHERE n_chars <> 0) "
    "SELECT doc_id, ftype, count(*) AS n, sum(value) AS total FROM u GROUP BY ALL",
)
def hstack(spark, sf):
    size = length(spark, sf).select("doc_id", F.lit("csv").alias("ftype"), F.lit("n_chars").alias("feature"), F.col("label_num").alias("value"))
    both = weights.hstack(words(spark, sf), size.filter("value <> 0"))
    return both.groupBy("doc_id", "ftype").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("vectorizer", f"""
WITH {coo()}, lab AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL), tr AS (SELECT * FROM coo JOIN lab USING (doc_id)),
sel AS (SELECT feature, (row_number() OVER (ORDER BY sum(value) DESC, feature) - 1)::BIGINT AS feature_id,
  ln((1.0 + (SELECT count(*) FROM lab)) / (1.0 + count(*))) + 1.0 AS idf FROM tr GROUP BY feature ORDER BY sum(value) DESC, feature LIMIT 1000),
w AS (SELECT doc_id, ftype, feature, feature_id, value * idf AS w FROM coo JOIN sel USING (feature))
SELECT doc_id, ftype, feature, feature_id, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS value FROM w""")
def vectorizer(spark, sf):
    """Fitted on the labelled documents, applied to all of them."""
    fitted = weights.fit_vectorizer(words(spark, sf), quality(spark, sf), "tfidf", 1000)
    return whole(six(weights.apply_vectorizer(fitted, words(spark, sf)), "value"), "feature_id")


# ----------------------------------------------------------------------- selection


def _entropy_sql(column: str, base: int | str, log: str) -> str:
    return f"SELECT '{column}' AS name, '{base}' AS base, {r6(f'-sum(p * {log}(p))')} AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY {column})"


LOGS = [(2, "log2"), (10, "log10"), ("e", "ln")]


@query("entropy", " UNION ALL ".join(_entropy_sql(c, b, f) for c in ("lang", "source") for b, f in LOGS))
def entropy(spark, sf):
    d = table(spark, sf, "documents")
    parts = [
        fs.entropy(d, c, b).select(F.lit(c).alias("name"), F.lit(str(b)).alias("base"), "entropy") for c in ("lang", "source") for b, _ in LOGS
    ]
    return six(reduce(lambda a, b: a.unionByName(b), parts), "entropy")


@query("mutual_information", f"""
WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT x, y, n / sum(n) OVER () AS p FROM c),
hx AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(p) AS p FROM p GROUP BY x)), hy AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(p) AS p FROM p GROUP BY y)),
hxy AS (SELECT -sum(p * log2(p)) AS h FROM p)
SELECT {r6('hx.h')} AS h_x, {r6('hy.h')} AS h_y, {r6('hxy.h - hy.h')} AS h_x_given_y, {r6('hx.h + hy.h - hxy.h')} AS mi, {r6('2 * (hx.h + hy.h - hxy.h) / (hx.h + hy.h)')} AS su
FROM hx, hy, hxy""")
def mutual_information(spark, sf):
    found = fs.mutual_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return six(found, "h_x", "h_y", "h_x_given_y", "mi", "su")


INFO = f"""
{coo()}, {LANG}, n AS (SELECT count(*)::DOUBLE AS n FROM lab), nl AS (SELECT label, count(*)::DOUBLE AS nl FROM lab GROUP BY label),
c AS (SELECT feature, value, label, count(*)::DOUBLE AS c FROM coo JOIN lab USING (doc_id) GROUP BY ALL),
z AS (SELECT f.feature, 0.0::DOUBLE AS value, nl.label, nl.nl - coalesce(sum(c.c), 0) AS c FROM (SELECT DISTINCT feature FROM c) f CROSS JOIN nl
  LEFT JOIN c ON c.feature = f.feature AND c.label = nl.label GROUP BY f.feature, nl.label, nl.nl),
a AS (SELECT * FROM c UNION ALL SELECT * FROM z WHERE c > 0),
hx AS (SELECT feature, -sum(c / n * log2(c / n)) AS hx FROM (SELECT feature, value, sum(c) AS c FROM a GROUP BY ALL), n GROUP BY feature),
hxy AS (SELECT feature, -sum(c / n * log2(c / n)) AS hxy FROM a, n GROUP BY feature),
hy AS (SELECT -sum(nl / n * log2(nl / n)) AS hy FROM nl, n),
df AS (SELECT feature, count(*) AS df FROM coo GROUP BY feature),
info AS (SELECT feature, df, hx, hy, hxy - hy AS hxgy, hx + hy - hxy AS mi, CASE WHEN hx + hy = 0 THEN 0 ELSE 2 * (hx + hy - hxy) / (hx + hy) END AS su
  FROM hx JOIN hxy USING (feature) JOIN df USING (feature), hy)
"""


@query(
    "label_information",
    f"WITH {INFO} SELECT 'tokens' AS ftype, feature, df, {r6('hx')} AS h_x, {r6('hy')} AS h_y, {r6('hxgy')} AS h_x_given_y, {r6('mi')} AS mi, {r6('su')} AS su FROM info",
)
def label_information(spark, sf):
    return six(fs.label_information(words(spark, sf), lang(spark, sf)), "h_x", "h_y", "h_x_given_y", "mi", "su")


@query("rank_by_su", f"WITH {INFO} SELECT 'tokens' AS ftype, feature, df, {r6('su')} AS su FROM info WHERE round(su, 12) > 0.01")
def rank_by_su(spark, sf):
    return six(fs.rank_by_su(words(spark, sf), lang(spark, sf), 0.01), "su")


@query("fcbf")
def fcbf(spark, sf):
    return fs.fcbf(top_words(spark, sf), lang(spark, sf), 0.01)


@query("pearson_relevance", f"{CORR} SELECT ftype, feature, {r6('coalesce(abs(r), 0)')} AS strength FROM r")
def pearson_relevance(spark, sf):
    return six(fs.pearson_relevance(words(spark, sf), length(spark, sf)), "strength")


PAIRS = f"""
WITH {coo()}, {TOP.format(k=100)}, f AS (SELECT c.* FROM coo c JOIN top USING (feature)), n AS (SELECT {N}::DOUBLE AS n),
s AS (SELECT feature, sum(value) AS sx, sum(value * value) AS sxx FROM f GROUP BY feature),
xy AS (SELECT a.feature AS i, b.feature AS j, sum(a.value * b.value) AS sxy FROM f a JOIN f b USING (doc_id) WHERE a.feature < b.feature GROUP BY ALL),
r AS (SELECT a.feature AS feature_i, b.feature AS feature_j, CASE WHEN n * a.sxx - a.sx * a.sx > 0 AND n * b.sxx - b.sx * b.sx > 0
  THEN (n * coalesce(sxy, 0) - a.sx * b.sx) / (sqrt(n * a.sxx - a.sx * a.sx) * sqrt(n * b.sxx - b.sx * b.sx)) END AS r
  FROM s a JOIN s b ON a.feature < b.feature LEFT JOIN xy ON xy.i = a.feature AND xy.j = b.feature, n)
"""


@query("feature_correlation", f"{PAIRS} SELECT 'tokens' AS ftype_i, feature_i, 'tokens' AS ftype_j, feature_j, {r6('r')} AS r FROM r")
def feature_correlation(spark, sf):
    return six(fs.feature_correlation(top_words(spark, sf), docs(spark, sf).count()), "r")


@query("selection_weights", f"""
{PAIRS}, y AS (SELECT doc_id, n_chars::DOUBLE AS y FROM documents), sy AS (SELECT sum(y) AS sy, sum(y * y) AS syy FROM y),
q AS (SELECT feature, abs((n * sum(value * y) - any_value(sx) * any_value(sy)) / (sqrt(any_value(n * sxx - sx * sx)) * sqrt(any_value(n * syy - sy * sy)))) AS strength
  FROM f JOIN y USING (doc_id) JOIN s USING (feature), n, sy GROUP BY feature, n),
u AS (SELECT feature_i, feature_j, r FROM r UNION ALL SELECT feature_j, feature_i, r FROM r)
SELECT 'tokens' AS ftype_i, feature_i, 'tokens' AS ftype_j, feature_j, {r6('coalesce(abs(u.r), 0)')} AS r, {r6('strength')} AS strength FROM u JOIN q ON q.feature = u.feature_i
""")
def selection_weights(spark, sf):
    return six(fs.selection_weights(top_words(spark, sf), length(spark, sf)), "r", "strength")


@query("mrmr_linear")
def mrmr_linear(spark, sf):
    return fs.mrmr_linear(top_words(spark, sf), length(spark, sf), "0.2_0.8")


@query("mrmr_linear_count")
def mrmr_linear_count(spark, sf):
    return fs.mrmr_linear(top_words(spark, sf), length(spark, sf), "15_0.9")
