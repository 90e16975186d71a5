"""Distributions, samples, metrics, ranks and significance tests.

The compared "models" are deterministic scores made from the documents: each configuration uses
one text feature scaled to [0, 1] as its probability of class 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import lexical as L
from penmark.functions import tokens as K
from penmark.functions.lexicon import FUNCTION_WORDS
from penmark.operators import aggregate as A
from penmark.operators import features as FT
from penmark.operators import joins as J
from penmark.operators import metrics as M
from penmark.operators import ranking as W
from penmark.operators import sampling as P
from penmark.operators import significance as Z
from penmark.operators.ablation import VARIANTS, ablation_summary, f1_by_variant, order_results
from penmark.operators.classify import CLASSIFIERS
from penmark.operators.quantiles import quantiles
from penmark.physical import inline_computed
from penmark.plans import sql as Q
from penmark.plans.registry import Registry
from penmark.plans.tables import documents, labelled, rounded, table
from penmark.session import materialize
from penmark.sources.io import config_slug

query = Registry()
QUERIES, SQL = query.queries, query.sql
c = F.col

_STOP = Q.ratio(f"len(list_filter(marks, lambda t: t IN {Q.words_in(FUNCTION_WORDS)}))", "len(alpha)")
_CONFIGS = [
    ("Full model", "RandomForest", Q.ratio("len(list_distinct(alpha))", "len(alpha)")),
    ("LOO - no Style", "SVM(LinearSVC)", f"least(1.0::double, {_STOP})"),
    (
        "Single - Style",
        "RandomForest",
        "least(1.0::double, coalesce(list_avg(list_transform(alpha, lambda w: length(w))), 0) / 10.0::double)",
    ),
    ("Single - Feat", "LogisticReg", Q.ratio("greatest(len(marks) - 2, 0)", "len(marks)")),
    ("Single - Pplx", "LogisticReg", Q.ratio("len(sentences)", "len(sentences) + 20")),
    ("Single - TFIDF", "RandomForest", Q.ratio("len(marks)", "len(marks) + 300")),
]


def _score_columns() -> list[tuple[str, str, Column]]:
    word_length = L.mean_word_length(c("alpha"))
    n_sent, n_marks = F.size("sentences"), F.size("marks")
    columns = [
        L.lexical_richness(c("alpha")),
        F.least(F.lit(1.0), L.stopword_ratio(c("marks"), c("alpha"), FUNCTION_WORDS)),
        F.least(F.lit(1.0), word_length / 10.0),
        K.ngram_density(n_marks, 3),
        L.ratio(n_sent, n_sent + 20),
        L.ratio(n_marks, n_marks + 300),
    ]
    return [(v, k, col) for (v, k, _), col in zip(_CONFIGS, columns, strict=True)]


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, variant, classifier, model, prediction_probability)`` for six configurations."""
    t = FT.with_tokens(labelled(spark, sf_dir), keep=["label"])
    rows = [
        F.struct(
            F.lit(v).alias("variant"), F.lit(k).alias("classifier"), F.round(col, 6).alias("prediction_probability")
        )
        for v, k, col in _score_columns()
    ]
    scored = inline_computed(t, F.array(*rows), "variant", ["doc_id", "label"])
    return scored.withColumn("model", config_slug(c("variant"), c("classifier")))


MODELS = sorted(f"{v.replace(' ', '_')}_{k.replace('(', '').replace(')', '')}" for v, k, _ in _CONFIGS)

SCORED_SQL = (
    Q.tokens("SELECT d.doc_id, d.text FROM documents d JOIN labels USING (doc_id)")
    + ", scored AS (\n"
    + "\n UNION ALL ".join(
        f"SELECT doc_id, quality AS label, {Q.q(v)} AS variant, {Q.q(k)} AS classifier,"
        f" round(({s})::double, 6) AS prediction_probability FROM tok JOIN labels USING (doc_id)"
        for v, k, s in _CONFIGS
    )
    + ")"
)
_MODEL_SQL = (
    SCORED_SQL
    + ", m AS (SELECT *, replace(variant, ' ', '_') || '_' || translate(classifier, ' ()', '') AS model,"
    " (prediction_probability > 0.5)::int AS predicted_label,"
    " CASE WHEN label = 1 THEN prediction_probability ELSE 1 - prediction_probability END AS score FROM scored)"
)
_BY_CLASS_SQL = (
    _MODEL_SQL
    + """,
k AS (SELECT * FROM (VALUES (0), (1)) v(cls)),
pc AS (
  SELECT model, cls, count(*) FILTER (WHERE label = cls AND predicted_label = cls)::double AS tp,
    count(*) FILTER (WHERE predicted_label = cls)::double AS claimed, count(*) FILTER (WHERE label = cls)::double AS support
  FROM m CROSS JOIN k GROUP BY model, cls),
pr AS (
  SELECT *, coalesce(tp / nullif(claimed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r,
    coalesce(2 * tp / nullif(claimed + support, 0), 0) AS f FROM pc WHERE claimed > 0 OR support > 0)"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.threshold_labels(model_scores(spark, sf_dir))


# Distributions and means


@query("SELECT lang, count(*)::bigint AS \"count\" FROM documents GROUP BY lang")
def value_counts(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "documents"), "lang")


@query("SELECT quality::bigint AS quality, count(*)::bigint AS \"count\" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def value_counts_with_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(A.value_counts(joined, "quality", dropna=False))


@query(f"WITH {SCORED_SQL} SELECT classifier, round(avg(prediction_probability), 6) AS mean_prediction_probability FROM scored GROUP BY classifier")
def mean_score(spark, sf_dir):
    return rounded(A.mean_score(model_scores(spark, sf_dir), "prediction_probability", by="classifier"))


@query(
    f"WITH {SCORED_SQL}, coefs AS (SELECT variant, abs(corr(prediction_probability, label)) AS coef FROM scored GROUP BY variant)"
    " SELECT round(quantile_cont(coef, 0.25), 6) AS coef_percentile FROM coefs"
)
def percentile_of_coefficients(spark, sf_dir):
    """The 25th percentile over one |coefficient| per feature."""
    preds = model_scores(spark, sf_dir)
    coefs = preds.groupBy("variant").agg(F.abs(F.corr("prediction_probability", "label")).alias("coef"))
    return rounded(A.percentile(coefs, "coef", 0.25))


_SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@query(
    f"WITH {Q.tokens()}, x AS (SELECT 'n_chars' AS feature, n_chars::double AS v FROM documents UNION ALL SELECT 'n_tokens', len(marks)::double FROM tok),"
    f" q AS (SELECT feature, unnest({_SHARES}::double[]) AS share, unnest(quantile_cont(v, {_SHARES})) AS value FROM x GROUP BY feature)"
    " SELECT feature, share, round(value, 6) AS value FROM q"
)
def quantiles_of_lengths(spark, sf_dir):
    """Exact quantiles over all documents, found by counting alone."""
    counted = materialize(documents(spark, sf_dir).select(F.size(K.marks(F.col("text"))).alias("n_tokens")))
    chars = quantiles(table(spark, sf_dir, "documents"), "n_chars", _SHARES)
    tokens = quantiles(counted, "n_tokens", _SHARES)
    return rounded(chars.withColumn("feature", F.lit("n_chars")).unionByName(tokens.withColumn("feature", F.lit("n_tokens"))))


# Samples and splits

_U = "('0x' || left(md5(doc_id::varchar || ':42'), 8))::bigint"


def cut_sql(frac: float) -> str:
    return f"""
WITH r AS (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_U}, doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n
  FROM labels JOIN documents USING (doc_id))"""


@query(cut_sql(0.1) + " SELECT doc_id, quality::bigint AS label FROM r WHERE rn <= round_even(0.1::double * n, 0)")
def stratified_sample(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", c("quality").cast("int").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return rounded(P.stratified_sample(docs.join(labels, "doc_id"), "label", 0.1))


@query(
    cut_sql(0.2)
    + " SELECT doc_id, quality::bigint AS label, CASE WHEN rn <= round_even(0.2::double * n, 0) THEN 'test' ELSE 'train' END AS split FROM r"
)
def stratified_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", c("quality").cast("int").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    train, test = P.stratified_split(docs.join(labels, "doc_id"))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return rounded(both)


@query(
    "SELECT doc_id, lang, shuffle_key, row_number() OVER (ORDER BY shuffle_key) - 1 AS position"
    " FROM (SELECT *, md5(doc_id::varchar || ':42') AS shuffle_key FROM documents)"
)
def seeded_shuffle(spark, sf_dir):
    """The shuffled rows with the places they got."""
    return W.with_position(P.shuffled(table(spark, sf_dir, "documents").select("doc_id", "lang")))


# Metrics


@query(
    f"WITH {_MODEL_SQL}, g AS (SELECT model, a AS label, b AS predicted_label FROM (SELECT DISTINCT model FROM m),"
    " (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b))"
    " SELECT g.model, g.label::bigint AS label, g.predicted_label::bigint AS predicted_label, count(m.doc_id)::bigint AS n"
    " FROM g LEFT JOIN m ON m.model = g.model AND m.label = g.label AND m.predicted_label = g.predicted_label GROUP BY ALL"
)
def confusion_matrix(spark, sf_dir):
    return rounded(M.confusion_matrix(predictions(spark, sf_dir), by=["model"]))


@query(
    f"""WITH {_BY_CLASS_SQL}
SELECT model, cls::varchar AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::bigint AS support FROM pr
UNION ALL SELECT model, 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::bigint FROM pr GROUP BY model
UNION ALL SELECT model, 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::bigint FROM pr GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), sum(support)::bigint FROM pr GROUP BY model"""
)
def classification_report(spark, sf_dir):
    matrix = M.confusion_matrix(predictions(spark, sf_dir), by=["model"])
    return rounded(M.classification_report(matrix, by=["model"]))


# Three classes: the role of a turn, guessed from its place and length.
_ROLE_SQL = """
ro AS (
  SELECT role AS label,
    CASE WHEN turn = 0 AND length(text) % 3 = 0 THEN 'system' WHEN length(text) > 400 THEN 'assistant' ELSE 'user' END AS predicted_label
  FROM conversations)"""


def role_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.length("text")
    guess = F.when((c("turn") == 0) & (chars % 3 == 0), "system").when(chars > 400, "assistant").otherwise("user")
    return table(spark, sf_dir, "conversations").select(c("role").alias("label"), guess.alias("predicted_label"))


@query(
    f"WITH {_ROLE_SQL}, k AS (SELECT label AS x FROM ro UNION SELECT predicted_label FROM ro)"
    " SELECT a.x AS label, b.x AS predicted_label, count(ro.label)::bigint AS n FROM k a CROSS JOIN k b"
    " LEFT JOIN ro ON ro.label = a.x AND ro.predicted_label = b.x GROUP BY ALL"
)
def confusion_matrix_of_roles(spark, sf_dir):
    """Classes from the data."""
    return rounded(M.confusion_matrix(role_guesses(spark, sf_dir), classes=()))


@query(
    f"""WITH {_ROLE_SQL}, k AS (SELECT label AS x FROM ro UNION SELECT predicted_label FROM ro),
pc AS (SELECT x, count(*) FILTER (WHERE label = x AND predicted_label = x)::double AS tp, count(*) FILTER (WHERE predicted_label = x)::double AS cl,
  count(*) FILTER (WHERE label = x)::double AS su FROM k CROSS JOIN ro GROUP BY x),
pr AS (SELECT *, coalesce(tp / nullif(cl, 0), 0) AS p, coalesce(tp / nullif(su, 0), 0) AS r, coalesce(2 * tp / nullif(cl + su, 0), 0) AS f FROM pc)
SELECT round(sum(tp) / sum(su), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM pr"""
)
def macro_scores_of_roles(spark, sf_dir):
    return rounded(M.macro_scores(M.confusion_matrix(role_guesses(spark, sf_dir), classes=())))


_MACRO_SQL = f"""{_BY_CLASS_SQL},
macro AS (
  SELECT model, sum(tp) / sum(support) AS accuracy, avg(p) AS precision, avg(r) AS recall, avg(f) AS f1 FROM pr GROUP BY model)"""


@query(f"WITH {_MACRO_SQL} SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM macro")
def macro_scores(spark, sf_dir):
    matrix = M.confusion_matrix(predictions(spark, sf_dir), by=["model"])
    return rounded(M.macro_scores(matrix, by=["model"]))


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro scores per configuration in the result table's column names."""
    matrix = M.confusion_matrix(predictions(spark, sf_dir), by=["variant", "classifier"])
    scores = M.macro_scores(matrix, by=["variant", "classifier"])
    names = ["variant", "classifier", "accuracy", "precision", "recall", "f1"]
    shown = ["Variant", "Classifier", "Accuracy", "Precision", "Recall", "F1"]
    return scores.select(*[c(a).alias(b) for a, b in zip(names, shown, strict=True)])


_RESULT_SQL = (
    _MACRO_SQL
    + """,
res AS (
  SELECT DISTINCT m.variant AS "Variant", m.classifier AS "Classifier", round(accuracy, 6) AS "Accuracy", round(precision, 6) AS "Precision",
    round(recall, 6) AS "Recall", round(f1, 6) AS "F1" FROM macro JOIN m USING (model))"""
)


@query(f"WITH {_RESULT_SQL} SELECT * FROM res ORDER BY \"F1\" DESC, \"Variant\", \"Classifier\" LIMIT 4")
def top_models(spark, sf_dir):
    return W.top_k(rounded(results_table(spark, sf_dir)), "F1", 4)


_ORDER = ", ".join(f"({Q.q(v)}, {i})" for i, v in enumerate(VARIANTS))


@query(
    f"WITH {_RESULT_SQL}, o AS (SELECT * FROM (VALUES {_ORDER}) v(\"Variant\", pos)),"
    " s AS (SELECT res.*, row_number() OVER (ORDER BY pos, \"Classifier\") - 1 AS position FROM res JOIN o USING (\"Variant\")) SELECT * FROM s"
)
def summary_in_report_order(spark, sf_dir):
    """The comparison table with the line of each row."""
    return rounded(W.with_position(ablation_summary(results_table(spark, sf_dir))))


@query(
    f"WITH {_RESULT_SQL}, o AS (SELECT * FROM (VALUES {_ORDER}) v(\"Variant\", pos))"
    " SELECT res.*, row_number() OVER (ORDER BY coalesce(pos, 1000), \"Classifier\") - 1 AS position FROM res LEFT JOIN o USING (\"Variant\")"
)
def ordered_results(spark, sf_dir):
    return rounded(W.with_position(order_results(results_table(spark, sf_dir))))


@query(
    f"""WITH {_RESULT_SQL} SELECT "Variant", max("F1") FILTER (WHERE "Classifier" = 'SVM(LinearSVC)') AS "SVM(LinearSVC)",
  max("F1") FILTER (WHERE "Classifier" = 'RandomForest') AS "RandomForest", max("F1") FILTER (WHERE "Classifier" = 'LogisticReg') AS "LogisticReg"
FROM res GROUP BY "Variant\""""
)
def f1_pivot(spark, sf_dir):
    return rounded(f1_by_variant(results_table(spark, sf_dir), CLASSIFIERS))


@query(
    f"WITH {_RESULT_SQL}, best AS (SELECT * FROM res ORDER BY \"F1\" DESC, \"Variant\", \"Classifier\" LIMIT 4)"
    " SELECT doc_id, variant, classifier, prediction_probability FROM m"
    " WHERE (variant, classifier) IN (SELECT (\"Variant\", \"Classifier\") FROM best)"
)
def top_model_predictions(spark, sf_dir):
    preds = model_scores(spark, sf_dir).select("doc_id", "variant", "classifier", "prediction_probability")
    return J.top_model_predictions(preds, rounded(results_table(spark, sf_dir)), 4).select(
        "doc_id", "variant", "classifier", "prediction_probability"
    )


@query(
    f"WITH {SCORED_SQL}, imp AS (SELECT variant AS feature, round(abs(corr(prediction_probability, label)), 6) AS importance FROM scored GROUP BY variant)"
    " SELECT feature, importance FROM imp WHERE importance >= (SELECT avg(importance) FROM imp)"
)
def selected_importances(spark, sf_dir):
    """One importance per feature, those at or above the mean, most important first."""
    from penmark.operators.selection import select_by_mean

    preds = model_scores(spark, sf_dir)
    imp = preds.groupBy(c("variant").alias("feature")).agg(
        F.round(F.abs(F.corr("prediction_probability", "label")), 6).alias("importance")
    )
    return W.rank_features(J.selected_importances(imp, select_by_mean(imp)))


# Significance


@query(f"WITH {_MODEL_SQL} SELECT doc_id, model, round(score, 6) AS score FROM m")
def true_class_score(spark, sf_dir):
    return rounded(Z.true_class_score(model_scores(spark, sf_dir)).select("doc_id", "model", "score"))


@query(f"WITH {_MODEL_SQL} SELECT doc_id, model, predicted_label::bigint AS predicted_label FROM m")
def threshold_labels(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("doc_id", "model", "predicted_label"))


_PAIR_SQL = (
    _MODEL_SQL
    + """,
pairs AS (
  SELECT a.doc_id, a.model AS model_a, b.model AS model_b, a.score AS score_a, b.score AS score_b, round(a.score - b.score, 12) AS d
  FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.model < b.model)"""
)


@query(f"WITH {_PAIR_SQL} SELECT doc_id, model_a, model_b, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b FROM pairs")
def pair_predictions(spark, sf_dir):
    scored = Z.true_class_score(model_scores(spark, sf_dir))
    return rounded(J.pair_predictions(scored, MODELS))


@query(
    f"WITH {_MODEL_SQL} SELECT model, value, count(*)::bigint AS ties, avg(rk + (tn - 1) / 2.0::double) AS rank FROM ("
    "SELECT model, round(score, 12) AS value, rank() OVER (PARTITION BY model ORDER BY round(score, 12)) AS rk,"
    " count(*) OVER (PARTITION BY model, round(score, 12)) AS tn FROM m) GROUP BY model, value"
)
def average_rank(spark, sf_dir):
    scored = Z.true_class_score(model_scores(spark, sf_dir))
    return W.average_rank(scored, "model", "score")


_WILCOXON_SQL = (
    _PAIR_SQL
    + """,
rk AS (
  SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0::double AS r
  FROM pairs WINDOW w AS (PARTITION BY model_a, model_b ORDER BY abs(d))),
ti AS (
  SELECT model_a, model_b, sum(t * t * t - t) AS ties
  FROM (SELECT model_a, model_b, count(*)::double AS t FROM pairs WHERE d <> 0 GROUP BY model_a, model_b, abs(d)) GROUP BY ALL),
st AS (
  SELECT model_a, model_b, count(*)::double AS n, count(*) FILTER (WHERE d = 0)::double AS n0,
    coalesce(sum(r) FILTER (WHERE d > 0), 0) AS rp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS rm FROM rk GROUP BY ALL),
va AS (
  SELECT *, n * (n + 1) / 4 - n0 * (n0 + 1) / 4 AS mean,
    (n * (n + 1) * (2 * n + 1) - n0 * (n0 + 1) * (2 * n0 + 1) - coalesce(ties, 0) / 2) / 24 AS var FROM st LEFT JOIN ti USING (model_a, model_b)),
wz AS (SELECT model_a, model_b, least(rp, rm) AS wilcoxon_stat, CASE WHEN var > 0 THEN (rp - mean) / sqrt(var) END AS z FROM va)"""
)
# erfc by its power series, for |z| below 5.6; beyond that p is 0 to the digits compared.
_P_SQL = (
    _WILCOXON_SQL
    + """,
se AS (SELECT *, abs(z) / sqrt(2.0::double) AS x FROM wz),
pv AS (
  SELECT model_a, model_b, wilcoxon_stat, z,
    CASE WHEN z IS NULL THEN NULL WHEN x > 4 THEN 0.0::double WHEN x = 0 THEN 1.0::double
      ELSE greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120),
        lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(x) - lgamma(k + 1.0::double)) / (2 * k + 1)))) END AS p
  FROM se)"""
)
_HOLM_SQL = (
    _P_SQL
    + """,
ho AS (
  SELECT *, least(1.0::double, (count(*) OVER () - row_number() OVER (ORDER BY p, model_a, model_b) + 1) * p) AS stepped,
    row_number() OVER (ORDER BY p, model_a, model_b) AS i FROM pv WHERE p IS NOT NULL),
hc AS (SELECT *, max(stepped) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc FROM ho)"""
)


def _tests(spark, sf_dir):
    return Z.pairwise_tests(Z.true_class_score(model_scores(spark, sf_dir)), MODELS)


@query(f"WITH {_P_SQL} SELECT model_a, model_b, wilcoxon_stat, round(z, 6) AS z, round(p, 6) AS p_value FROM pv")
def wilcoxon(spark, sf_dir):
    return rounded(_tests(spark, sf_dir))


@query(
    f"WITH {_HOLM_SQL} SELECT model_a, model_b, round(p, 6) AS p_value, round(pc, 6) AS p_value_corrected, pc <= 0.05 AS significant FROM hc"
)
def holm(spark, sf_dir):
    tests = W.holm(_tests(spark, sf_dir))
    return rounded(tests.select("model_a", "model_b", "p_value", "p_value_corrected", "significant"))


@query(
    f"WITH {_P_SQL} SELECT model_a, model_b, round(least(1.0::double, p * 15), 6) AS p_value_corrected, least(1.0::double, p * 15) <= 0.05 AS significant FROM pv"
)
def bonferroni(spark, sf_dir):
    tests = W.bonferroni(_tests(spark, sf_dir))
    return rounded(tests.select("model_a", "model_b", "p_value_corrected", "significant"))


@query(
    f'WITH {_HOLM_SQL} SELECT model_a AS "Model_A", model_b AS "Model_B", wilcoxon_stat AS "Wilcoxon_stat", round(p, 6) AS p_value,'
    ' round(pc, 6) AS p_value_corrected, pc <= 0.05 AS "Significant" FROM hc'
)
def wilcoxon_results(spark, sf_dir):
    return rounded(Z.wilcoxon_results(model_scores(spark, sf_dir), MODELS))


@query(f'WITH {_P_SQL} SELECT model_a AS "Model_A", model_b AS "Model_B" FROM pv WHERE p < 0.05')
def raw_significant(spark, sf_dir):
    results = Z.wilcoxon_results(model_scores(spark, sf_dir), MODELS)
    return Z.raw_significant(results).select("Model_A", "Model_B")


_MATRIX_COLUMNS = ", ".join(
    f"coalesce(bool_or(sig) FILTER (WHERE other = {Q.q(m)}), false) AS \"{m}\"" for m in MODELS
)


@query(
    f"WITH {_HOLM_SQL}, both_ways AS (SELECT model_a AS model, model_b AS other, pc <= 0.05 AS sig FROM hc"
    f" UNION ALL SELECT model_b, model_a, pc <= 0.05 FROM hc) SELECT model, {_MATRIX_COLUMNS} FROM both_ways GROUP BY model"
)
def significance_matrix(spark, sf_dir):
    results = Z.wilcoxon_results(model_scores(spark, sf_dir), MODELS)
    return Z.significance_matrix(results, MODELS)
