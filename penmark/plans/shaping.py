"""Sources, sinks, projections and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.functions import lexical as L
from penmark.functions import tokens as K
from penmark.functions.lexicon import CLOSED_CLASS
from penmark.operators import features as FT
from penmark.operators import joins as J
from penmark.operators import reshape as R
from penmark.physical import explode_computed
from penmark.plans import sql as Q
from penmark.plans.registry import Registry
from penmark.plans.stats import SCORED_SQL, model_scores
from penmark.plans.tables import documents, labelled, rounded, scratch, table
from penmark.plans.text import SQL as TEXT_SQL
from penmark.plans.text import pos_shares
from penmark.sources import io

query = Registry()
QUERIES, SQL = query.queries, query.sql
c = F.col


# Sources and sinks: written from the given tables, read back with a declared schema


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = scratch(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    docs.write.json(path)
    return io.read_jsonl(spark, path, docs.schema)


@query("SELECT doc_id, text, lang FROM documents")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return io.read_csv(spark, path, docs.schema, multi_line=True)


_PREDICTION_SQL = f"""
WITH {SCORED_SQL}
SELECT doc_id, label::bigint AS label, prediction_probability, variant, classifier,
  replace(variant, ' ', '_') || '_' || translate(classifier, ' ()', '') AS model FROM scored"""


@query(_PREDICTION_SQL)
def predictions_round_trip(spark, sf_dir):
    path = scratch(spark, "predictions")
    io.write_predictions(model_scores(spark, sf_dir).drop("model"), path)
    preds, _ = io.read_predictions(spark, path)
    return rounded(preds.select("doc_id", "label", "prediction_probability", "variant", "classifier", "model"))


@query(
    f"WITH {SCORED_SQL} SELECT DISTINCT variant, classifier, replace(variant, ' ', '_') || '_' || translate(classifier, ' ()', '') AS slug FROM scored"
)
def config_slug(spark, sf_dir):
    preds = model_scores(spark, sf_dir)
    return preds.select("variant", "classifier", io.config_slug(c("variant"), c("classifier")).alias("slug")).distinct()


@query(
    f"WITH {SCORED_SQL}, r AS (SELECT variant, classifier, avg(prediction_probability) AS f1, count(*)::bigint AS n FROM scored GROUP BY ALL)"
    " SELECT half, variant AS \"Variant\", classifier AS \"Classifier\", round(f1, 6) AS \"F1\", n, n AS support"
    " FROM r CROSS JOIN (VALUES ('csv'), ('jsonl')) h(half)"
)
def results_round_trip(spark, sf_dir):
    """Both halves of the result sink, read back; the nested report is JSON text in the CSV."""
    path = scratch(spark, "results")
    per_model = model_scores(spark, sf_dir).groupBy("variant", "classifier").agg(
        F.avg("prediction_probability").alias("F1"), F.count(F.lit(1)).alias("n")
    )
    report = F.struct(c("n").alias("support")).alias("report")
    table_ = per_model.select(c("variant").alias("Variant"), c("classifier").alias("Classifier"), "F1", "n", report)
    io.write_results(table_, path)
    lines = io.read_jsonl(spark, f"{path}/jsonl", table_.schema)
    flat = io.read_csv(spark, f"{path}/csv", "Variant string, Classifier string, F1 double, n bigint, report string")
    flat = flat.withColumn("report", F.from_json("report", table_.schema["report"].dataType))
    both = lines.withColumn("half", F.lit("jsonl")).unionByName(flat.withColumn("half", F.lit("csv")))
    return rounded(both.withColumn("support", c("report.support")).drop("report"))


_TAGS = ", ".join(f"({Q.q(w)}, '{t}')" for t, ws in CLOSED_CLASS.items() for w in ws)


@query(
    f"WITH {Q.tokens()}, wl AS (SELECT * FROM (VALUES {_TAGS}) v(word, tag)),"
    " w AS (SELECT unnest(marks) AS word FROM tok) SELECT word, tag, count(*)::bigint AS n FROM w JOIN wl USING (word) GROUP BY ALL"
)
def word_list_hits(spark, sf_dir):
    """Corpus counts of the words of a built-in list (a list of fixed, small size is broadcast)."""
    words = explode_computed(documents(spark, sf_dir), K.marks(c("text")), ["word"])
    listed = F.broadcast(io.word_list(spark, "closed_class"))
    return words.join(listed, "word").groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))


# Projections and recoding


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def split_columns(spark, sf_dir):
    """The metadata half of the split; the text column is never read."""
    meta, _ = R.split_columns(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "n_chars"])
    return meta


@query("SELECT d.doc_id, l.quality::bigint AS prediction FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def drop_unscored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", c("quality").alias("prediction"))
    return rounded(R.drop_unscored(docs.join(labels, "doc_id", "left")))


@query(
    "SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END::bigint AS role FROM conversations"
)
def recode_roles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rounded(R.recode(turns, "role", {"user": 0, "assistant": 1}))


_NAMES = ", ".join(f"({Q.q(a)}, {Q.q(b)})" for a, b in R.DISPLAY_NAMES.items())


@query(
    f"WITH s AS ({TEXT_SQL['pos_shares']}), n AS (SELECT * FROM (VALUES {_NAMES}) v(feature, shown))"
    " SELECT doc_id, coalesce(shown, feature) AS feature, value FROM s LEFT JOIN n USING (feature)"
)
def rename_values(spark, sf_dir):
    return R.rename_values(pos_shares(spark, sf_dir), "feature")


@query(f"WITH {Q.tokens()} SELECT doc_id, len(words)::bigint AS n_words, len(sentences)::bigint AS n_sentences FROM tok")
def unpack_struct(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir))
    packed = t.select("doc_id", F.struct(F.size("words").alias("n_words"), F.size("sentences").alias("n_sentences")).alias("s"))
    return rounded(R.unpack(packed, "s"))


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),"
    " f AS (SELECT vec_id, form, CASE WHEN form IN ('number', 'number text') THEN v[1:1] ELSE v END AS v"
    " FROM e CROSS JOIN (VALUES ('array'), ('tuple'), ('list'), ('number'), ('number text')) x(form))"
    " SELECT vec_id, form, generate_subscripts(v, 1)::bigint - 1 AS pos, round(unnest(v), 5) AS value FROM f"
)
def parse_vectors(spark, sf_dir):
    """Every form of a vector cell: arrays, tuple and list text, numbers, number text."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    listed = F.array_join(c("embedding").cast("array<string>"), ", ")
    first = F.get("embedding", F.lit(0))
    forms = {
        "array": c("embedding"),
        "tuple": F.concat(F.lit("("), listed, F.when(F.size("embedding") == 1, F.lit(",")).otherwise(F.lit("")), F.lit(")")),
        "list": F.concat(F.lit("["), listed, F.lit("]")),
        "number": first,
        "number text": first.cast("string"),
    }
    parsed = [
        R.parse_vector_column(emb.select("vec_id", cell.alias("v")), "v").select("vec_id", F.lit(form).alias("form"), F.posexplode("v").alias("pos", "value"))
        for form, cell in forms.items()
    ]
    return rounded(reduce(DataFrame.unionByName, parsed), 5)


@query(
    f"WITH {Q.tokens()}, n AS (SELECT doc_id, len(sentences) AS k FROM tok), m AS (SELECT max(k) AS width FROM n)"
    " SELECT doc_id, width::bigint AS width, (width - k)::bigint AS n_missing FROM n CROSS JOIN m"
)
def pad_vectors(spark, sf_dir):
    t = FT.with_tokens(documents(spark, sf_dir)).select("doc_id", L.sentence_lengths(c("sentences")).alias("v"))
    padded = R.pad_vectors(t, "v")
    missing = F.size(F.filter("v", lambda x: F.isnan(x)))
    return rounded(padded.select("doc_id", F.size("v").alias("width"), missing.alias("n_missing")))


@query("SELECT doc_id, quality::int::bigint AS label FROM labels")
def cast_label(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", c("quality").cast("string").alias("label"))
    return rounded(R.cast_label(labels))


@query("SELECT doc_id, unnest([n_chars::double, length(text)::double]) AS value, unnest([0, 1])::bigint AS pos FROM documents")
def pack_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.length("text").alias("length"))
    packed = R.pack_features(docs, ["n_chars", "length"])
    return rounded(packed.select("doc_id", F.posexplode("feature_select").alias("pos", "value")))


@query("SELECT count(*)::bigint AS n_rows, 5::bigint AS n_columns FROM documents")
def table_shape(spark, sf_dir):
    return R.shape(table(spark, sf_dir, "documents"))


@query(
    "SELECT count(*)::bigint AS n_rows, 3::bigint AS n_columns FROM documents JOIN labels USING (doc_id)"
    " UNION ALL SELECT count(*), 3 FROM documents JOIN labels USING (doc_id)"
)
def same_columns(spark, sf_dir):
    """Shape of two tables after their columns were found equal (the check itself runs no job)."""
    a = labelled(spark, sf_dir, "quality")
    b = labelled(spark, sf_dir, "toxic")
    R.assert_same_columns(a, b)
    return R.shape(a).unionAll(R.shape(b))


_COMBINE_SQL = f"""
WITH {Q.tokens()}
SELECT d.doc_id, d.lang, len(t.words)::bigint AS n_words, len(t.sentences)::bigint AS n_sentences, l.quality::bigint AS label
FROM documents d LEFT JOIN tok t USING (doc_id) LEFT JOIN labels l USING (doc_id)"""


@query(_COMBINE_SQL)
def combine_features(spark, sf_dir):
    docs = documents(spark, sf_dir)
    base = table(spark, sf_dir, "documents").select("doc_id", "lang")
    f1 = docs.select("doc_id", F.size(K.words(c("text"))).alias("n_words"))
    f2 = docs.select("doc_id", F.size(K.sentences(c("text"))).alias("n_sentences"))
    labels = table(spark, sf_dir, "labels").select("doc_id", c("quality").alias("label"))
    return rounded(J.combine_features(base, f1, f2, labels))
