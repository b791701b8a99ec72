"""Registry of queries and the tables that several of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sorrel.functions.stats import rounded
from sorrel.operators import ngrams
from sorrel.operators.folds import make_folds
from sorrel.plans.staging import stage, stage_by_document
from sorrel.sources.documents import labels_from

QUERIES: dict = {}
ORACLES: dict = {}
_SHARED: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def shared(fn):
    """Keep a table that several queries read, once per session and input."""

    def get(spark: SparkSession, sf: str):
        key = (fn.__name__, spark.sparkContext.applicationId, sf)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, sf)
        return _SHARED[key]

    get.__name__ = fn.__name__
    return get


def forget() -> None:
    _SHARED.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def lang(spark, sf) -> DataFrame:
    return labels_from(table(spark, sf, "documents"), "doc_id", "lang")


def source(spark, sf) -> DataFrame:
    return labels_from(table(spark, sf, "documents"), "doc_id", "source")


def quality(spark, sf) -> DataFrame:
    return labels_from(table(spark, sf, "labels"), "doc_id", "quality", "quality")


@shared
def words(spark, sf) -> DataFrame:
    """Lower-cased word counts of all documents."""
    return stage_by_document(ngrams.word_counts(docs(spark, sf), lowercase=True), "words")


@shared
def folds(spark, sf) -> DataFrame:
    return stage(make_folds(docs(spark, sf), 10), "folds")


def six(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, rounded(F.col(c)))
    return df


def whole(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


# ------------------------------------------------------------------ SQL fragments

TOK = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENT = r"[^.!?\n]*[.!?]+|[^.!?\n]+"


def coo(table="documents", key="doc_id", text="lower(text)", name="coo") -> str:
    return (
        f"{name} AS (SELECT doc_id, 'tokens' AS ftype, feature, count(*)::DOUBLE AS value FROM ("
        f"SELECT {key} AS doc_id, unnest(regexp_extract_all({text}, '{TOK}')) AS feature FROM {table}) GROUP BY ALL)"
    )


def grams(ns, table="documents", key="doc_id", text="lower(text)", name="coo", keep="w") -> str:
    """N-grams inside a sentence; ``keep`` is the token list after filtering."""
    lists = ", ".join(
        f"list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i+{n - 1}], ' '))" for n in ns
    )
    return (
        f"{name}_s AS (SELECT {key} AS doc_id, unnest(regexp_extract_all({text}, '{SENT}')) AS s FROM {table}), "
        f"{name}_w AS (SELECT doc_id, {keep} AS w FROM (SELECT doc_id, regexp_extract_all(s, '{TOK}') AS w FROM {name}_s)), "
        f"{name} AS (SELECT doc_id, 'tokens' AS ftype, feature, count(*)::DOUBLE AS value FROM ("
        f"SELECT doc_id, unnest(flatten([{lists}])) AS feature FROM {name}_w) GROUP BY ALL)"
    )


LANG = "lab AS (SELECT doc_id, lang AS label FROM documents)"
SOURCE = "lab AS (SELECT doc_id, source AS label FROM documents)"
QUALITY = "lab AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label, quality::DOUBLE AS y FROM labels WHERE quality IS NOT NULL)"


def unit(seed, *ids) -> str:
    """The seeded uniform number of the library."""
    key = " || '_' || ".join(f"({i})::VARCHAR" for i in ids)
    return f"(('0x' || substr(md5('{seed}_' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE)"


FOLDS = "folds AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 10)::INT AS fold FROM documents)"


def bayes(alpha="1.0", fit_prior=False, vocab="SELECT feature FROM tr GROUP BY feature ORDER BY sum(value) DESC, feature LIMIT 5000") -> str:
    """Scores ``p(doc_id, label, prob)`` of all documents; needs ``coo`` and ``lab``."""
    prior = "ln(n / sum(n) OVER ())" if fit_prior else "-ln(count(*) OVER ())"
    return (
        "tr AS (SELECT c.*, l.label FROM coo c JOIN lab l USING (doc_id)), "
        f"voc AS ({vocab}), "
        "cnt AS (SELECT label, feature, sum(value) AS n FROM tr WHERE feature IN (SELECT feature FROM voc) GROUP BY ALL), "
        "labs AS (SELECT label, count(*)::DOUBLE AS n FROM lab GROUP BY label), "
        f"pri AS (SELECT label, n, {prior} AS prior FROM labs), "
        "tot AS (SELECT l.label, coalesce(sum(c.n), 0) AS t FROM labs l LEFT JOIN cnt c USING (label) GROUP BY l.label), "
        f"w AS (SELECT f.feature, t.label, coalesce(c.n, 0) AS n, ln(coalesce(c.n, 0) + {alpha}) - ln(t.t + {alpha} * (SELECT count(*) FROM voc)) AS w "
        "FROM voc f CROSS JOIN tot t LEFT JOIN cnt c ON c.feature = f.feature AND c.label = t.label), "
        "s AS (SELECT c.doc_id, w.label, sum(c.value * w.w) AS s FROM coo c JOIN w USING (feature) GROUP BY ALL), "
        "t AS (SELECT d.doc_id, l.label, coalesce(s.s, 0) + l.prior AS s FROM documents d CROSS JOIN pri l "
        "LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = l.label), "
        "e AS (SELECT doc_id, label, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM t), "
        "p AS (SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) + 0.0::DOUBLE AS prob FROM e)"
    )


def folded_bayes(k: int | None = 5000, fit_prior: bool = False) -> str:
    """``p(fold, doc_id, label, prob)``; needs ``coo``, ``lab`` and ``folds``."""
    prior = "ln(n / sum(n) OVER (PARTITION BY f))" if fit_prior else "-ln(count(*) OVER (PARTITION BY f))"
    cut = f"WHERE r <= {k}" if k else ""
    return (
        "fs AS (SELECT DISTINCT fold AS f FROM folds WHERE fold >= 0), "
        "tr AS (SELECT fs.f, l.label, c.feature, sum(c.value) AS n FROM coo c JOIN lab l USING (doc_id) JOIN folds o USING (doc_id) "
        "JOIN fs ON fs.f <> o.fold GROUP BY ALL), "
        "voc AS (SELECT f, feature FROM (SELECT f, feature, row_number() OVER (PARTITION BY f ORDER BY sum(n) DESC, feature) AS r FROM tr GROUP BY f, feature) "
        f"{cut}), "
        "vs AS (SELECT f, count(*) AS v FROM voc GROUP BY f), "
        "cnt AS (SELECT tr.* FROM tr JOIN voc USING (f, feature)), "
        "labs AS (SELECT fs.f, l.label, count(*)::DOUBLE AS n FROM lab l JOIN folds o USING (doc_id) JOIN fs ON fs.f <> o.fold GROUP BY ALL), "
        f"pri AS (SELECT f, label, {prior} AS prior FROM labs), "
        "tot AS (SELECT l.f, l.label, coalesce(sum(c.n), 0) AS t FROM labs l LEFT JOIN cnt c USING (f, label) GROUP BY ALL), "
        "test AS (SELECT o.fold AS f, c.doc_id, c.feature, c.value FROM coo c JOIN folds o USING (doc_id) JOIN lab USING (doc_id) JOIN voc ON voc.f = o.fold AND voc.feature = c.feature), "
        "s AS (SELECT x.f, x.doc_id, t.label, sum(x.value * (ln(coalesce(c.n, 0) + 1.0) - ln(t.t + vs.v))) AS s FROM test x JOIN tot t USING (f) JOIN vs USING (f) "
        "LEFT JOIN cnt c ON c.f = x.f AND c.label = t.label AND c.feature = x.feature GROUP BY ALL), "
        "t AS (SELECT o.fold, o.doc_id, l.label, coalesce(s.s, 0) + l.prior AS s FROM folds o JOIN lab USING (doc_id) JOIN pri l ON l.f = o.fold "
        "LEFT JOIN s ON s.f = l.f AND s.doc_id = o.doc_id AND s.label = l.label), "
        "e AS (SELECT fold, doc_id, label, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM t), "
        "p AS (SELECT fold, doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) + 0.0::DOUBLE AS prob FROM e)"
    )


PREDICTED = (
    "pred AS (SELECT doc_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label) AS r FROM p) WHERE r = 1)"
)


def cells(pairs="pairs", by="") -> str:
    """``cells(label, n, tot, clf, tp, fp, fn, tn)`` from ``pairs(target, prediction)``."""
    g = f"{by}, " if by else ""
    on = f"PARTITION BY {by}" if by else ""
    return (
        f"half AS (SELECT {g}target AS label, 1 AS tot, 0 AS clf, (target = prediction)::INT AS tp FROM {pairs} "
        f"UNION ALL SELECT {g}prediction, 0, 1, 0 FROM {pairs}), "
        f"sums AS (SELECT {g}label, sum(tot)::BIGINT AS tot, sum(clf)::BIGINT AS clf, sum(tp)::BIGINT AS tp FROM half GROUP BY {g}label), "
        f"cells AS (SELECT *, clf - tp AS fp, tot - tp AS fn, n - tot - clf + tp AS tn FROM (SELECT *, (sum(tot) OVER ({on}))::BIGINT AS n FROM sums))"
    )


def rates(shown=r6) -> str:
    """Rates of the cells, each passed through ``shown``."""

    def over(top, bottom):
        return f"CASE WHEN {bottom} = 0 THEN 0.0::DOUBLE ELSE ({top})::DOUBLE / ({bottom}) END"

    pr, re, f1, fpr = over("tp", "(tp + fp)"), over("tp", "(tp + fn)"), over("2 * tp", "(2 * tp + fp + fn)"), over("fp", "(fp + tn)")
    return (
        f"{shown(pr)} AS pr, {shown(re)} AS re, {shown(f1)} AS f1, {shown(re)} AS tpr, {shown(fpr)} AS fpr, {shown(f'(1 + ({re}) - ({fpr})) / 2')} AS auc"
    )
