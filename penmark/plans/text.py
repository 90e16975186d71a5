"""Text features: token streams, one query per feature, annotation, n-grams, the whole record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import connectors as C
from penmark.functions import lexical as L
from penmark.functions import sentiment as S
from penmark.functions import tagging as G
from penmark.functions import tokens as K
from penmark.functions.arrays import array_mean, ngrams
from penmark.functions.lexicon import CONNECTORS, FUNCTION_WORDS
from penmark.functions.tagging import TAGS
from penmark.operators import features as FT
from penmark.operators import joins as J
from penmark.operators import reshape as R
from penmark.operators.hmm_tagger import fit_hmm_tagger
from penmark.physical import explode_computed, posexplode_computed
from penmark.plans import sql as Q
from penmark.plans.registry import Registry
from penmark.plans.tables import documents, labelled, rounded, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

c = F.col


def _tags() -> Column:
    return G.annotation_counts(c("sentences"))


# name -> (column expression over the token table, SQL expression over ``tok``)
_PER_DOCUMENT: dict[str, tuple[Callable[[], Column], str]] = {
    "lexical_richness": (
        lambda: L.lexical_richness(c("alpha")),
        Q.ratio("len(list_distinct(alpha))", "len(alpha)"),
    ),
    "mean_word_length": (
        lambda: L.mean_word_length(c("alpha")),
        "coalesce(list_avg(list_transform(alpha, lambda w: length(w))), 0)",
    ),
    "stopword_ratio": (
        lambda: L.stopword_ratio(c("marks"), c("alpha"), FUNCTION_WORDS),
        Q.ratio(f"len(list_filter(marks, lambda t: t IN {Q.words_in(FUNCTION_WORDS)}))", "len(alpha)"),
    ),
    "mean_sentence_words": (
        lambda: L.mean_sentence_words(c("sentences")),
        f"coalesce(list_avg(list_transform(sentences, lambda s: len(regexp_extract_all(s, {Q.q(K.WORDS_RE)})))), 0)",
    ),
    "ngram_diversity": (
        lambda: L.ngram_diversity(c("terms"), c("alpha")),
        Q.ratio(
            "len(list_distinct(list_transform(range(1, len(terms)), lambda i: terms[i] || ' ' || terms[i + 1])))"
            " + len(list_distinct(list_transform(range(1, len(terms) - 1),"
            " lambda i: terms[i] || ' ' || terms[i + 1] || ' ' || terms[i + 2])))",
            "len(alpha)",
        ),
    ),
    "avg_sentence_length": (
        lambda: array_mean(L.sentence_lengths(c("sentences"))),
        f"coalesce(list_avg(list_transform(sentences, lambda s: len(regexp_extract_all(s, {Q.q(K.MARKS_RE)})))), 0)",
    ),
    "num_tokens": (lambda: F.size("marks"), "len(marks)"),
    "num_sentences": (lambda: F.size("sentences"), "len(sentences)"),
    "avg_word_length": (
        lambda: L.avg_word_length(c("marks")),
        "coalesce(list_avg(list_transform(list_filter(marks,"
        f" lambda t: NOT contains({Q.PUNCTUATION}, t)), lambda t: length(t))), 0)",
    ),
    "two_gram_density": (
        lambda: K.ngram_density(F.size("marks"), 2),
        Q.ratio("greatest(len(marks) - 1, 0)", "len(marks)"),
    ),
    "three_gram_density": (
        lambda: K.ngram_density(F.size("marks"), 3),
        Q.ratio("greatest(len(marks) - 2, 0)", "len(marks)"),
    ),
    "unusual_word_ratio_short_list": (
        lambda: L.unusual_word_ratio(c("words"), FUNCTION_WORDS),
        Q.round2(
            Q.ratio(
                f"len(list_filter(list_distinct(words), lambda w: w NOT IN {Q.words_in(FUNCTION_WORDS)}))",
                "len(list_distinct(words))",
            )
        ),
    ),
}


def _per_document(name: str, make: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(FT.with_tokens(documents(spark, sf_dir)).select("doc_id", make().alias(name)))

    return run


for _name, (_make, _sql) in _PER_DOCUMENT.items():
    QUERIES[_name] = _per_document(_name, _make)
    _type = "bigint" if _name.startswith("num_") else "double"
    SQL[_name] = f"WITH {Q.tokens()} SELECT doc_id, round(({_sql})::double, 6)::{_type} AS {_name} FROM tok"


@query(
    f"WITH {Q.tokens()} SELECT doc_id, len(words)::bigint AS n_words, len(alpha)::bigint AS n_alpha,"
    " len(marks)::bigint AS n_marks, len(terms)::bigint AS n_terms, len(sentences)::bigint AS n_sentences FROM tok"
)
def token_streams(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    names = ["words", "alpha", "marks", "terms", "sentences"]
    return rounded(t.select("doc_id", *[F.size(n).alias(f"n_{n}") for n in names]))


@query(
    f"WITH {Q.tokens()}, g AS (SELECT doc_id, list_transform(range(1, len(marks)), lambda i: marks[i] || ' ' || marks[i + 1]) AS g2 FROM tok)"
    " SELECT doc_id, unnest(g2) AS ngram, generate_subscripts(g2, 1)::bigint - 1 AS pos FROM g"
)
def token_bigrams(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    return rounded(posexplode_computed(t, ngrams(c("marks"), 2), ["pos", "ngram"], ["doc_id"]))


@query(
    f"WITH {Q.tokens()}, l AS (SELECT doc_id, list_transform(sentences, lambda s: len(regexp_extract_all(s, {Q.q(K.MARKS_RE)}))) AS n FROM tok)"
    " SELECT doc_id, generate_subscripts(n, 1)::bigint - 1 AS sent_id, unnest(n)::bigint AS n_tokens FROM l"
)
def sentence_lengths(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    return rounded(posexplode_computed(t, L.sentence_lengths(c("sentences")), ["sent_id", "n_tokens"], ["doc_id"]))


@query(f"WITH {Q.tokens()}, {Q.ENTROPY} SELECT doc_id, coalesce({Q.round2('h')}, 0) AS lexical_entropy FROM tok LEFT JOIN ent USING (doc_id)")
def lexical_entropy(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    return t.select("doc_id", L.lexical_entropy(c("words")).alias("lexical_entropy"))


_FLESCH_SQL = f"""
WITH {Q.tokens()},
syl AS (
  SELECT doc_id, sum(greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - regexp_matches(w, '[^aeiouyl]e$')::int)) AS n
  FROM (SELECT doc_id, unnest(words) AS w FROM tok) GROUP BY doc_id),
sen AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, {Q.q(K.NOT_BLANK_RE)})) AS ss FROM tok),
num AS (
  SELECT doc_id, len(ss)::double AS n_s, list_sum(list_transform(ss, lambda s: len(regexp_extract_all(s, {Q.q(K.WORDS_RE)}))))::double AS n_w FROM sen)
SELECT doc_id, {Q.round2("206.835::double - 1.015::double * (n_w / n_s) - 84.6::double * (n::double / n_w)")} AS flesch
FROM tok LEFT JOIN syl USING (doc_id) LEFT JOIN num USING (doc_id)"""


@query(_FLESCH_SQL)
def flesch(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", L.flesch(c("text")).alias("flesch"))


# Connectors


@query(
    f"WITH {Q.tokens()}, {Q.phrases(CONNECTORS)} SELECT doc_id, phrase,"
    f" ((length({Q.STRIPPED}) - length(replace({Q.STRIPPED}, phrase, ''))) / length(phrase))::bigint AS n FROM tok CROSS JOIN phrase"
)
def connector_counts(spark, sf_dir):
    return rounded(J.connector_table(documents(spark, sf_dir), CONNECTORS))


# A longer list: connectors, function words, and pairs of a function word and a connector.
PHRASES = list(dict.fromkeys([*CONNECTORS, *FUNCTION_WORDS, *(f"{a} {b}" for a in FUNCTION_WORDS for b in CONNECTORS[:6])]))


@query(
    f"WITH {Q.tokens()}, {Q.phrases(PHRASES)}, s AS (SELECT doc_id, {Q.STRIPPED} AS stripped FROM tok),"
    " n AS (SELECT doc_id, phrase, ((length(stripped) - length(replace(stripped, phrase, ''))) / length(phrase))::bigint AS n FROM s CROSS JOIN phrase)"
    " SELECT * FROM n WHERE n > 0"
)
def connector_hits(spark, sf_dir):
    return rounded(J.connector_hits(documents(spark, sf_dir), PHRASES))


_CONNECTOR_SUMS = f"""
WITH {Q.tokens()}, {Q.phrases(CONNECTORS)},
hits AS (
  SELECT doc_id, phrase, ((length({Q.STRIPPED}) - length(replace({Q.STRIPPED}, phrase, ''))) / length(phrase))::bigint AS n
  FROM tok CROSS JOIN phrase),
sums AS (SELECT doc_id, sum(n)::bigint AS total, count(*) FILTER (WHERE n > 0) AS uniq FROM hits GROUP BY doc_id)
SELECT doc_id, total AS total_connectors, uniq::bigint AS unique_connectors,
  round({Q.ratio("total", "len(list_filter(marks, lambda t: NOT regexp_matches(t, '^\\p{P}+$')))")}, 6) AS connector_density
FROM sums JOIN tok USING (doc_id)"""


@query(_CONNECTOR_SUMS)
def connector_summary(spark, sf_dir):
    """Total, number of different, and density of connectors."""
    t = FT.with_tokens(documents(spark, sf_dir)).withColumn("counts", C.connector_counts(c("stripped"), CONNECTORS))
    total = C.total_connectors(c("counts"))
    return rounded(
        t.select(
            "doc_id",
            total.alias("total_connectors"),
            C.unique_connectors(c("counts")).alias("unique_connectors"),
            C.connector_density(total, c("marks")).alias("connector_density"),
        )
    )


# Annotation and sentiment


@query(
    f"WITH {Q.annotations()} SELECT doc_id, sent_id::bigint AS sent_id, tok_id::bigint AS tok_id, token, pos, dep, is_alpha, is_stop, is_punct FROM ann"
)
def annotate(spark, sf_dir):
    return rounded(FT.annotate(documents(spark, sf_dir)))


_HMM_SQL = f"""
WITH {Q.annotations()}
SELECT doc_id, count(*)::bigint AS n_tokens, count(DISTINCT sent_id)::bigint AS n_sentences,
  count(*) FILTER (WHERE pos = 'PUNCT')::bigint AS n_punct, count(*) FILTER (WHERE pos = 'SYM')::bigint AS n_sym,
  count(*) FILTER (WHERE pos = 'CCONJ')::bigint AS n_cconj, count(*) FILTER (WHERE is_stop)::bigint AS n_stop,
  0::bigint AS n_untagged, true AS likelihood_grew
FROM ann GROUP BY doc_id"""


@query(_HMM_SQL)
def hmm_tag_counts(spark, sf_dir):
    """Tokens by the tags of the model that is fitted on all documents.  The SQL knows the tags that do
    not depend on the neighbours; the others are tested by enumeration and hand-tagged sentences."""
    docs = documents(spark, sf_dir)
    model = fit_hmm_tagger(docs)
    grown = model.log_likelihood
    return rounded(
        model.annotate(docs)
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_tokens"),
            (F.max("sent_id") + 1).alias("n_sentences"),
            *[F.count_if(c("pos") == t).alias(f"n_{t.lower()}") for t in ("PUNCT", "SYM", "CCONJ")],
            F.count_if("is_stop").alias("n_stop"),
            F.count_if(c("pos").isNull()).alias("n_untagged"),
        )
        .withColumn("likelihood_grew", F.lit(all(a < b for a, b in zip(grown, grown[1:], strict=False))))
    )


_SHARE_SQL = """
WITH {ann},
cnt AS (SELECT doc_id, {label} AS l, count(*) AS n FROM ann WHERE {keep} GROUP BY ALL),
den AS (SELECT doc_id, len(alpha) AS d FROM tok)
SELECT doc_id, '{prefix}' || l AS feature, round(n::double / d, 6) AS value FROM cnt JOIN den USING (doc_id) WHERE d > 0"""


@query(_SHARE_SQL.format(ann=Q.annotations(), label="pos", keep="true", prefix="prop_"))
def pos_shares(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    shares = G.pos_shares(_tags(), F.size("alpha"))
    return rounded(explode_computed(t, shares, ["feature", "value"], ["doc_id"]))


@query(_SHARE_SQL.format(ann=Q.annotations(), label="token", keep="is_punct", prefix="punct_"))
def punct_shares(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    shares = G.punct_shares(_tags(), F.size("alpha"))
    return rounded(explode_computed(t, shares, ["feature", "value"], ["doc_id"]))


@query(
    f"""WITH {Q.annotations()},
n AS (SELECT doc_id, count(*) FILTER (WHERE dep IN ('acl', 'advcl', 'ccomp')) AS k FROM ann GROUP BY doc_id)
SELECT doc_id, round({Q.ratio("coalesce(k, 0)", "len(sentences)")}, 6) AS syntactic_complexity FROM tok LEFT JOIN n USING (doc_id)"""
)
def syntactic_complexity(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    return rounded(t.select("doc_id", G.syntactic_complexity(_tags(), F.size("sentences")).alias("syntactic_complexity")))


@query(
    f"""WITH {Q.annotations()}, n AS (SELECT doc_id, dep, count(*) AS k FROM ann GROUP BY doc_id, dep),
m AS (SELECT doc_id, max(k)::double / sum(k) AS r FROM n GROUP BY doc_id)
SELECT doc_id, coalesce({Q.round2("r")}, 0) AS dep_repetition FROM tok LEFT JOIN m USING (doc_id)"""
)
def dep_repetition(spark, sf_dir):
    return FT.with_tokens(documents(spark, sf_dir)).select("doc_id", G.dep_repetition(_tags()).alias("dep_repetition"))


@query(
    f"""WITH {Q.annotations()},
a AS (SELECT doc_id, count(*) FILTER (WHERE is_alpha) AS al, count(DISTINCT sent_id) AS ns, count(*) AS nt,
        count(*) FILTER (WHERE is_stop) AS st, count(*) FILTER (WHERE dep IN ('acl', 'advcl', 'ccomp')) AS cl FROM ann GROUP BY doc_id),
d AS (SELECT doc_id, max(k) AS mx FROM (SELECT doc_id, dep, count(*) AS k FROM ann GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, 'stopword_ratio' AS feature, round(coalesce({Q.ratio("st", "al")}, 0), 6) AS value FROM tok LEFT JOIN a USING (doc_id)
UNION ALL SELECT doc_id, 'syntactic_complexity', round(coalesce({Q.ratio("cl", "ns")}, 0), 6) FROM tok LEFT JOIN a USING (doc_id)
UNION ALL SELECT doc_id, 'dep_repetition', coalesce({Q.round2("mx::double / nt")}, 0) FROM tok LEFT JOIN (SELECT * FROM a JOIN d USING (doc_id)) x USING (doc_id)
UNION ALL SELECT doc_id, 'prop_' || pos, round(n::double / al, 6) FROM (SELECT doc_id, pos, count(*) AS n FROM ann GROUP BY ALL) p JOIN a USING (doc_id) WHERE al > 0
UNION ALL SELECT doc_id, 'punct_' || token, round(n::double / al, 6)
  FROM (SELECT doc_id, token, count(*) AS n FROM ann WHERE is_punct GROUP BY ALL) p JOIN a USING (doc_id) WHERE al > 0"""
)
def annotation_table_features(spark, sf_dir):
    """The same features computed from a token table, as an external tagger would deliver it: the three
    scalars and both families, all documents."""
    docs = documents(spark, sf_dir)
    wide = FT.annotation_features(FT.annotate(docs), docs)
    scalars = F.create_map(
        *[x for n in ("stopword_ratio", "syntactic_complexity", "dep_repetition") for x in (F.lit(n), c(n).cast("double"))]
    )
    pairs = F.map_concat(scalars, "pos_shares", "punct_shares")
    return rounded(explode_computed(wide, pairs, ["feature", "value"], ["doc_id"]))


@query(
    f"WITH {Q.tokens()}, {Q.sentiment()} SELECT doc_id, round(coalesce(polarity, 0), 6) AS polarity,"
    " round(coalesce(subjectivity, 0), 6) AS subjectivity FROM tok LEFT JOIN sent_doc USING (doc_id)"
)
def sentiment(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    return rounded(R.unpack(t.select("doc_id", S.sentiment(c("marks")).alias("s")), "s"))


# Words against a word list.  The list is derived from the data: words found in at least 20
# conversation turns, which grows with the tables.

_LEXICON_SQL = f"""
lexicon AS (
  SELECT w FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), {Q.q(K.WORDS_RE)}))) AS w FROM conversations)
  GROUP BY w HAVING count(*) >= 20)"""


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    w = explode_computed(turns, F.array_distinct(K.words(F.lower("text"))), ["word"])
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("word")


@query(
    f"""WITH {Q.tokens()}, {_LEXICON_SQL},
d AS (SELECT doc_id, unnest(list_distinct(words)) AS w FROM tok),
n AS (SELECT doc_id, count(*) AS dw, count(*) FILTER (WHERE lexicon.w IS NULL) AS uw FROM d LEFT JOIN lexicon ON d.w = lexicon.w GROUP BY doc_id)
SELECT doc_id, coalesce(dw, 0)::bigint AS distinct_words, coalesce(uw, 0)::bigint AS unusual_words,
  {Q.round2(Q.ratio("uw", "dw"))} AS unusual_word_ratio FROM tok LEFT JOIN n USING (doc_id)"""
)
def unusual_words(spark, sf_dir):
    return rounded(J.unusual_words(documents(spark, sf_dir), _lexicon(spark, sf_dir)))


@query(
    f"WITH {Q.tokens()}, {_LEXICON_SQL}, d AS (SELECT doc_id, unnest(list_distinct(words)) AS word FROM tok)"
    " SELECT doc_id, word FROM d WHERE word NOT IN (SELECT w FROM lexicon)"
)
def words_outside_list(spark, sf_dir):
    return J.words_outside(documents(spark, sf_dir), _lexicon(spark, sf_dir))


@query(f"WITH {Q.tokens()} SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(words) AS word FROM tok)")
def distinct_words(spark, sf_dir):
    return explode_computed(J.distinct_words(documents(spark, sf_dir)), c("words"), ["word"], ["doc_id"])


# The whole record, long form, checked feature by feature.

_RECORD_SQL = f"""
WITH {Q.annotations()}, {Q.ENTROPY}, {Q.sentiment()}, {Q.phrases(CONNECTORS)}, {_LEXICON_SQL},
flesch_doc AS ({_FLESCH_SQL}),
hit AS (
  SELECT doc_id, phrase, ((length({Q.STRIPPED}) - length(replace({Q.STRIPPED}, phrase, ''))) / length(phrase))::bigint AS n
  FROM tok CROSS JOIN phrase),
con AS (SELECT doc_id, sum(n) AS total, count(*) FILTER (WHERE n > 0) AS uniq FROM hit GROUP BY doc_id),
cl AS (SELECT doc_id, count(*) FILTER (WHERE dep IN ('acl', 'advcl', 'ccomp')) AS k FROM ann GROUP BY doc_id),
dr AS (SELECT doc_id, max(k)::double / sum(k) AS r FROM (SELECT doc_id, dep, count(*) AS k FROM ann GROUP BY ALL) GROUP BY doc_id),
dw AS (SELECT doc_id, unnest(list_distinct(words)) AS w FROM tok),
un AS (SELECT doc_id, count(*) FILTER (WHERE lexicon.w IS NULL)::double / count(*) AS r FROM dw LEFT JOIN lexicon ON dw.w = lexicon.w GROUP BY doc_id),
wide AS (
  SELECT tok.*, ent.h, sent_doc.polarity, sent_doc.subjectivity, flesch_doc.flesch, con.total, con.uniq, cl.k, dr.r AS dep_r, un.r AS un_r
  FROM tok LEFT JOIN ent USING (doc_id) LEFT JOIN sent_doc USING (doc_id) LEFT JOIN flesch_doc USING (doc_id) LEFT JOIN con USING (doc_id)
    LEFT JOIN cl USING (doc_id) LEFT JOIN dr USING (doc_id) LEFT JOIN un USING (doc_id)),
al AS (SELECT doc_id, len(alpha) AS d FROM tok),
pieces AS (
{{scalars}}
  UNION ALL SELECT doc_id, phrase, n::double FROM hit
  UNION ALL SELECT doc_id, 'prop_' || pos, n::double / d FROM (SELECT doc_id, pos, count(*) AS n FROM ann GROUP BY ALL) JOIN al USING (doc_id) WHERE d > 0
  UNION ALL SELECT doc_id, 'punct_' || token, n::double / d FROM (SELECT doc_id, token, count(*) AS n FROM ann WHERE is_punct GROUP BY ALL) JOIN al USING (doc_id) WHERE d > 0)
SELECT doc_id, feature, round(value, 6) AS value FROM pieces"""

_RECORD_SCALARS = {
    **{n: s for n, (_, s) in _PER_DOCUMENT.items() if n in FT.SCALARS},
    "syntactic_complexity": Q.ratio("coalesce(k, 0)", "len(sentences)"),
    "polarity": "coalesce(polarity, 0)",
    "subjectivity": "coalesce(subjectivity, 0)",
    "total_connectors": "total",
    "connector_density": Q.ratio("total", "len(list_filter(marks, lambda t: NOT regexp_matches(t, '^\\p{P}+$')))"),
    "unique_connectors": "uniq",
    "flesch": "flesch",
    "lexical_entropy": f"coalesce({Q.round2('h')}, 0)",
    "dep_repetition": f"coalesce({Q.round2('dep_r')}, 0)",
    "unusual_word_ratio": f"coalesce({Q.round2('un_r')}, 0)",
    "2-grams": _PER_DOCUMENT["two_gram_density"][1],
    "3-grams": _PER_DOCUMENT["three_gram_density"][1],
}
_SCALAR_ROWS = "\n  UNION ALL ".join(
    f"SELECT doc_id, {Q.q(n)} AS feature, ({s})::double AS value FROM wide" for n, s in _RECORD_SCALARS.items()
)


@query(_RECORD_SQL.replace("{scalars}", _SCALAR_ROWS))
def linguistic_features(spark, sf_dir):
    record = FT.linguistic_features(documents(spark, sf_dir), common_words=_lexicon(spark, sf_dir))
    return rounded(FT.long_features(record))


@query(
    _SHARE_SQL.format(ann=Q.annotations(), label="pos", keep="true", prefix="prop_").replace(
        "SELECT doc_id, 'prop_'", ", long AS (SELECT doc_id, 'prop_'"
    )
    + f""")
SELECT doc_id, {", ".join(f"max(value) FILTER (WHERE feature = 'prop_{t}') AS prop_{t}" for t in TAGS)} FROM long GROUP BY doc_id"""
)
def widen_pos_shares(spark, sf_dir):
    """Long to wide over all tags; a tag that a document lacks stays null."""
    return R.widen(pos_shares(spark, sf_dir), [f"prop_{t}" for t in TAGS])


# Flagship: vocabulary richness, readability and entropy by label.

@query(
    f"""WITH {Q.tokens("SELECT d.doc_id, d.text FROM documents d JOIN labels l USING (doc_id)")}, {Q.ENTROPY}, f AS ({_FLESCH_SQL}),
x AS (SELECT doc_id, {_PER_DOCUMENT["lexical_richness"][1]} AS richness, {_PER_DOCUMENT["mean_word_length"][1]} AS word_length,
        len(marks) AS n_tokens FROM tok)
SELECT l.quality::bigint AS label, count(*)::bigint AS n_docs, round(avg(richness), 6) AS mean_richness,
  round(avg(word_length), 6) AS mean_word_length, round(avg(n_tokens), 6) AS mean_tokens,
  round(avg(flesch), 6) AS mean_flesch, round(avg(coalesce({Q.round2("h")}, 0)), 6) AS mean_entropy
FROM labels l JOIN x USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN ent USING (doc_id) GROUP BY l.quality"""
)
def style_by_label(spark, sf_dir):
    t = FT.with_tokens(labelled(spark, sf_dir), keep=["label"])
    per_doc = t.select(
        "label",
        L.lexical_richness(c("alpha")).alias("richness"),
        L.mean_word_length(c("alpha")).alias("word_length"),
        F.size("marks").alias("n_tokens"),
        L.flesch(c("text")).alias("flesch"),
        L.lexical_entropy(c("words")).alias("entropy"),
    )
    return rounded(
        per_doc.groupBy("label").agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.avg("richness").alias("mean_richness"),
            F.avg("word_length").alias("mean_word_length"),
            F.avg("n_tokens").alias("mean_tokens"),
            F.avg("flesch").alias("mean_flesch"),
            F.avg("entropy").alias("mean_entropy"),
        )
    )
