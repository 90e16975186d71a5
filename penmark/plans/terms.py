"""TF-IDF, language model, zero-shot score, style vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.functions import tokens as K
from penmark.functions.lexicon import FUNCTION_WORDS
from penmark.operators import style as Y
from penmark.operators import zeroshot as ZS
from penmark.operators.ngram_lm import fit_ngram_lm, perplexity
from penmark.operators.sampling import with_split
from penmark.operators.tfidf import fit_tfidf
from penmark.physical import posexplode_computed
from penmark.plans import sql as Q
from penmark.plans.registry import Registry
from penmark.plans.tables import documents, rounded, table
from penmark.session import materialize

query = Registry()
QUERIES, SQL = query.queries, query.sql
c = F.col

MAX_FEATURES = 3000


def _grams(source: str, prefix: str) -> str:
    longer = "".join(
        ", list_transform(range(1, len(t) - {0}), lambda i: {1})".format(
            n - 2, " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
        )
        for n in (2, 3, 4)
    )
    strip = f"translate(lower(text), {Q.q(K.ACCENTED)}, {Q.q(K.UNACCENTED)})"
    for ligature, letters in K.LIGATURES.items():
        strip = f"replace({strip}, {Q.q(ligature)}, {Q.q(letters)})"
    strip = f"regexp_replace({strip}, {Q.q(K.MARKS_ONLY_RE)}, '', 'g')"
    return f"""
{prefix}t AS (SELECT doc_id, regexp_extract_all({strip}, {Q.q(K.TERMS_RE)}) AS t FROM ({source})),
{prefix}g AS (SELECT doc_id, unnest(flatten([t{longer}])) AS term FROM {prefix}t),
{prefix}c AS (SELECT doc_id, term, count(*)::bigint AS n FROM {prefix}g GROUP BY doc_id, term)"""


_VOCABULARY_SQL = (
    _grams("SELECT doc_id, text FROM documents", "d")
    + f""",
v AS (
  SELECT term, sum(n)::bigint AS tf, count(*)::bigint AS df FROM dc GROUP BY term HAVING count(*) >= 2
  ORDER BY tf DESC, term LIMIT {MAX_FEATURES}),
idf AS (SELECT term, tf, df, ln((1 + (SELECT count(*) FROM documents))::double / (1 + df)) + 1 AS idf FROM v)"""
)


@query(f"WITH {_VOCABULARY_SQL} SELECT term, tf, df, round(idf, 6) AS idf FROM idf")
def tfidf_vocabulary(spark, sf_dir):
    model = fit_tfidf(documents(spark, sf_dir), max_features=MAX_FEATURES)
    return rounded(model.table(spark).drop("idx"))


def _weights_sql(prefix: str) -> str:
    return f""",
w AS (SELECT doc_id, term, n * idf AS x FROM {prefix}c JOIN idf USING (term)),
l AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM w GROUP BY doc_id)
SELECT doc_id, term, round(x / len, 6) AS tfidf FROM w JOIN l USING (doc_id)"""


@query(f"WITH {_VOCABULARY_SQL}{_weights_sql('d')}")
def tfidf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(fit_tfidf(docs, max_features=MAX_FEATURES).transform_long(docs))


def _turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select((c("conv_id") * 1000 + c("turn")).alias("doc_id"), "text")


_TURNS_SQL = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"


@query(f"WITH {_VOCABULARY_SQL}, {_grams(_TURNS_SQL, 'c')}{_weights_sql('c')}")
def tfidf_transform(spark, sf_dir):
    """A vocabulary fitted on the documents, applied to the conversation turns."""
    model = fit_tfidf(documents(spark, sf_dir), max_features=MAX_FEATURES)
    return rounded(model.transform_long(_turns(spark, sf_dir)))


# Language model over all words of the documents.

K_UNI, LAM = 0.5, 0.7


def _lm_sql(scored: str = "SELECT doc_id, text FROM documents", counted: str = "SELECT doc_id, text FROM documents") -> str:
    return f"""
lt AS (SELECT doc_id, regexp_extract_all(lower(text), {Q.q(K.MARKS_RE)}) AS t FROM ({counted})),
lp AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM lt),
uni AS (SELECT w, count(*) AS c FROM lp GROUP BY w),
voc AS (SELECT w, c FROM uni),
tot AS (SELECT (SELECT sum(c) FROM uni)::double AS n, count(*)::double AS v, sum(c)::double AS k FROM voc),
pw AS (SELECT w, (c + {K_UNI}::double) / (n + {K_UNI}::double * (v + 1)) AS p FROM voc, tot),
unk AS (SELECT (n - k + {K_UNI}::double) / (n + {K_UNI}::double * (v + 1)) AS pu FROM tot),
lpair AS (
  SELECT u, voc.w AS v FROM (SELECT w AS u, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM lp) x LEFT JOIN voc ON voc.w = x.v
  WHERE x.v IS NOT NULL AND u IN (SELECT w FROM voc)),
big AS (SELECT u, v, count(*)::double AS c FROM lpair GROUP BY u, v),
cx AS (SELECT u, sum(c) AS cu FROM big GROUP BY u),
st AS (SELECT doc_id, regexp_extract_all(lower(text), {Q.q(K.MARKS_RE)}) AS t FROM ({scored})),
sp AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM st),
spair AS (
  SELECT doc_id, u, x.v AS v FROM (SELECT doc_id, w AS u, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM sp) x WHERE x.v IS NOT NULL),
sc AS (
  SELECT doc_id, spair.u, CASE WHEN cu IS NULL THEN coalesce(pw.p, pu)
      ELSE {LAM}::double * coalesce(big.c, 0) / cu + (1 - {LAM}::double) * coalesce(pw.p, pu) END AS q
  FROM spair CROSS JOIN unk LEFT JOIN pw ON pw.w = spair.v LEFT JOIN cx ON cx.u = spair.u
    LEFT JOIN big ON big.u = spair.u AND big.v IS NOT DISTINCT FROM pw.w),
ll AS (SELECT doc_id, -avg(ln(q)) AS log_ppl, count(*) AS n FROM sc GROUP BY doc_id)"""


@query(f"WITH {_lm_sql()} SELECT doc_id, round(exp(log_ppl), 6) AS perplexity FROM documents LEFT JOIN ll USING (doc_id)")
def perplexity_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(perplexity(docs, fit_ngram_lm(docs, k=K_UNI, lam=LAM)))


@query(f"WITH {_lm_sql(_TURNS_SQL)}, al AS ({_TURNS_SQL}) SELECT doc_id, round(exp(log_ppl), 6) AS perplexity FROM al LEFT JOIN ll USING (doc_id)")
def perplexity_of_turns(spark, sf_dir):
    """A model of the documents scores other text, with unknown words."""
    lm = fit_ngram_lm(documents(spark, sf_dir), k=K_UNI, lam=LAM)
    return rounded(perplexity(_turns(spark, sf_dir), lm))


_H_SQL = f""",
ku AS (
  SELECT sum(p * ln((1 - {LAM}::double) * p)) + any_value(pu) * ln((1 - {LAM}::double) * any_value(pu)) AS a,
    -(sum(p * ln(p)) + any_value(pu) * ln(any_value(pu))) AS h0 FROM pw CROSS JOIN unk),
hs AS (
  SELECT big.u, sum(coalesce(p, pu) * (ln({LAM}::double * c / cu + (1 - {LAM}::double) * coalesce(p, pu)) - ln((1 - {LAM}::double) * coalesce(p, pu)))) AS s
  FROM big JOIN cx USING (u) CROSS JOIN unk LEFT JOIN pw ON pw.w = big.v GROUP BY big.u),
xe AS (SELECT doc_id, avg(CASE WHEN s IS NULL THEN h0 ELSE -(a + s) END) AS x FROM sc CROSS JOIN ku LEFT JOIN hs USING (u) GROUP BY doc_id),
zs AS (SELECT doc_id, log_ppl / x AS score FROM ll JOIN xe USING (doc_id))"""


def _scores(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return ZS.zero_shot_score(docs, fit_ngram_lm(docs, k=K_UNI, lam=LAM))


@query(f"WITH {_lm_sql()}{_H_SQL} SELECT doc_id, round(score, 6) AS score FROM documents LEFT JOIN zs USING (doc_id)")
def zero_shot_score(spark, sf_dir):
    return rounded(_scores(spark, sf_dir))


_VERDICT_SQL = (
    """
sr AS (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || left(md5(doc_id::varchar || ':42'), 8))::bigint, doc_id) AS rn,
    count(*) OVER (PARTITION BY quality) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
la AS (SELECT doc_id, quality AS label, rn <= round_even(0.2::double * n, 0) AS held FROM sr),"""
    + _lm_sql("SELECT doc_id, text FROM documents JOIN la USING (doc_id)", "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM la WHERE held)")
    + _H_SQL
    + """,
lz AS (SELECT doc_id, round(score, 9) AS score, label, held FROM la LEFT JOIN zs USING (doc_id)),
tr AS (SELECT * FROM lz WHERE NOT held AND score IS NOT NULL),
rg AS (SELECT min(score) AS lo, (max(score) - min(score)) / 1000 AS w FROM tr),
bn AS (SELECT least(floor((score - lo) / w), 999)::int AS b, label FROM tr CROSS JOIN rg),
ed AS (SELECT DISTINCT lo + (b + 1) * w AS t, b FROM bn CROSS JOIN rg),
ac AS (SELECT t, count(*) FILTER (WHERE (label = 1) = (bn.b <= ed.b))::double / count(*) AS a FROM ed CROSS JOIN bn GROUP BY t),
th AS (SELECT t, a FROM ac ORDER BY a DESC, t LIMIT 1),
ve AS (
  SELECT doc_id, label, score,
    CASE WHEN score < t THEN 'Most likely AI-generated' WHEN score >= t THEN 'Most likely human-generated' END AS prediction
  FROM lz CROSS JOIN th WHERE held)"""
)


def _verdicts(spark, sf_dir):
    """Verdicts of the test documents: the model is counted on all other documents, and the threshold
    chosen on the labelled ones among them."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", c("quality").cast("int").alias("label"))
    docs = documents(spark, sf_dir)
    split = materialize(with_split(labels.join(docs.select("doc_id"), "doc_id")))
    held = split.where(c("split") == "test").select("doc_id")
    lm = fit_ngram_lm(docs.join(held, "doc_id", "left_anti"), k=K_UNI, lam=LAM)
    scores = ZS.zero_shot_score(docs.join(split.select("doc_id"), "doc_id"), lm)
    # Scores meet the threshold rounded, so that both engines put a score on the same side.
    scored = materialize(scores.select("doc_id", F.round("score", 9).alias("score")).join(split, "doc_id"))
    threshold = ZS.choose_threshold(scored.where(c("split") == "train")).first()["threshold"]
    return ZS.zero_shot_predict(scored.where(c("split") == "test"), threshold)


@query(f"WITH {_VERDICT_SQL} SELECT doc_id, label::bigint AS label, prediction FROM ve")
def zero_shot_verdicts(spark, sf_dir):
    return rounded(_verdicts(spark, sf_dir).select("doc_id", "label", "prediction"))


@query(
    f"WITH {_VERDICT_SQL} SELECT a AS label, b AS predicted_label, (SELECT count(*) FROM ve WHERE label = a AND (prediction LIKE '%AI%')::int = b)::bigint AS n"
    " FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)"
)
def zero_shot_confusion(spark, sf_dir):
    _, matrix = ZS.evaluate_zero_shot(_verdicts(spark, sf_dir))
    return rounded(matrix)


@query(
    f"""WITH {_VERDICT_SQL},
co AS (SELECT label, (prediction LIKE '%AI%')::int AS pred FROM ve WHERE prediction IS NOT NULL),
pc AS (
  SELECT cls, count(*) FILTER (WHERE label = cls AND pred = cls)::double AS tp, count(*) FILTER (WHERE pred = cls)::double AS claimed,
    count(*) FILTER (WHERE label = cls)::double AS support FROM co CROSS JOIN (VALUES (0), (1)) k(cls) GROUP BY cls),
pr AS (
  SELECT cls, tp, support, coalesce(tp / nullif(claimed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r,
    coalesce(2 * tp / nullif(claimed + support, 0), 0) AS f FROM pc WHERE claimed > 0 OR support > 0)
SELECT cls::varchar AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::bigint AS support FROM pr
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::bigint FROM pr
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::bigint FROM pr
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), sum(support)::bigint FROM pr"""
)
def zero_shot_report(spark, sf_dir):
    report, _ = ZS.evaluate_zero_shot(_verdicts(spark, sf_dir))
    return rounded(report)


# Style vectors

_FW = ", ".join(f"({Q.q(w)}, {i})" for i, w in enumerate(FUNCTION_WORDS))
_STYLE_SQL = f"""
WITH {Q.tokens()}, fw AS (SELECT * FROM (VALUES {_FW}) v(w, pos)),
a AS (SELECT doc_id, pos, count(*)::double AS n FROM (SELECT doc_id, unnest(marks) AS w FROM tok) JOIN fw USING (w) GROUP BY ALL),
ch AS (SELECT doc_id, low, list_transform(range(1, length(low) - 1), lambda i: low[i:i + 2]) AS g FROM tok),
b AS (
  SELECT doc_id, {len(FUNCTION_WORDS)} + (unicode(g) * 961 + unicode(g[2:2]) * 31 + unicode(g[3:3])) % {Y.TRIGRAM_BUCKETS} AS pos, count(*)::double AS n
  FROM (SELECT doc_id, unnest(g) AS g FROM ch) GROUP BY ALL),
u AS (SELECT doc_id, pos, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM a
  UNION ALL SELECT doc_id, pos, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) FROM b)
SELECT doc_id, pos::bigint AS pos, round(x, 6) AS value FROM u"""


@query(_STYLE_SQL)
def style_vectors(spark, sf_dir):
    """Non-zero entries of the computed style vectors."""
    v = Y.style_vectors(documents(spark, sf_dir))
    return rounded(posexplode_computed(v, c("style"), ["pos", "value"], ["doc_id"]).where("value > 0"))


@query(
    "SELECT d.doc_id, round(list_sum(list_transform(e.embedding, lambda x: x::double * x::double)), 5) AS squared_norm"
    " FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
)
def join_embeddings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = Y.join_embeddings(docs, table(spark, sf_dir, "embeddings"))
    norm = F.aggregate("style", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rounded(joined.select("doc_id", norm.alias("squared_norm")), 5)
