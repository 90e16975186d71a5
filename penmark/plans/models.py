"""Blocks, reduction, selection, classifiers, the ablation grid."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import tagging as G
from penmark.functions.hashing import hash_key
from penmark.functions.lexicon import FUNCTION_WORDS
from penmark.operators import ablation as AB
from penmark.operators import blocks as B
from penmark.operators import classify as CL
from penmark.operators import selection as SE
from penmark.operators import style as Y
from penmark.operators.features import SCALARS, linguistic_features
from penmark.operators.linear import SQUARED_HINGE, LinearModel
from penmark.operators.metrics import confusion_matrix, macro_scores
from penmark.operators.ngram_lm import fit_ngram_lm, perplexity
from penmark.operators.reshape import pack_features, widen_map
from penmark.operators.sampling import with_split
from penmark.operators.svd import svd_reduce
from penmark.operators.tfidf import fit_tfidf
from penmark.physical import spread_small
from penmark.plans.registry import Registry
from penmark.plans.stats import cut_sql
from penmark.plans.tables import documents, rounded, scratch, table
from penmark.session import materialize
from penmark.sources import io

query = Registry()
QUERIES, SQL = query.queries, query.sql
c = F.col

# Columns of the two map families: every tag of the tagger, and the common punctuation marks.
POS_KEYS = [f"prop_{t}" for t in G.TAGS]
PUNCT_KEYS = [f"punct_{m}" for m in ".,;:!?'\"()-"]
FEATURE_COLUMNS = [*SCALARS, *POS_KEYS, *PUNCT_KEYS]


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their split.  The split only needs key and label, so it is made on
    the label table before any text is read."""
    labels = table(spark, sf_dir, "labels").select("doc_id", c("quality").cast("int").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread_small(docs.join(with_split(labels), "doc_id"), source=docs)


def feature_table(docs: DataFrame) -> DataFrame:
    """Linguistic features as columns."""
    record = linguistic_features(docs, keep=["label", "split"], common_words=list(FUNCTION_WORDS))
    scalars = [f"`{s}`" for s in SCALARS]
    wide = record.select("doc_id", "label", "split", *scalars, "pos_shares", "punct_shares")
    return widen_map(widen_map(wide, "pos_shares", POS_KEYS), "punct_shares", PUNCT_KEYS)


def splits(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test), written once: every later fit reads files."""
    stored = materialize(df)
    return tuple(stored.where(c("split") == s).drop("split") for s in ("train", "test"))


def feature_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return splits(feature_table(split_documents(spark, sf_dir)))


def block_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) with text and the three numeric blocks, not yet scaled."""
    # Stored: six steps read these texts, and each would join the documents with their labels again.
    docs = materialize(split_documents(spark, sf_dir))
    feats = pack_features(feature_table(docs), FEATURE_COLUMNS, "feat").select("doc_id", "feat")
    # No row is scored by a model that was counted on it: the halves of the training rows score each
    # other, the first half's model scores the test rows.
    half = F.pmod(hash_key(c("doc_id"), 7), F.lit(2))
    first = (c("split") == "train") & (half == 0)
    second = (c("split") == "train") & (half == 1)
    ppl = perplexity(docs.where(~first), fit_ngram_lm(docs.where(first))).unionByName(
        perplexity(docs.where(first), fit_ngram_lm(docs.where(second)))
    )
    styled = Y.style_vectors(docs, keep=["label", "split", "text"])
    joined = styled.join(feats, "doc_id").join(ppl.withColumnRenamed("perplexity", "pplx"), "doc_id")
    return splits(joined.withColumn("pplx", F.coalesce("pplx", F.lit(float("nan")))))


def built_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, B.BlockModel]:
    train, test = block_inputs(spark, sf_dir)
    return B.build_blocks(train, test)


_LONG = "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::double AS x FROM embeddings"


@query(
    f"WITH l AS ({_LONG}), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY pos)"
    " SELECT vec_id, pos::bigint AS pos, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS value FROM l JOIN s USING (pos)"
)
def standardize_block(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = B.StandardizeBlock.fit(emb, "embedding").transform(emb, "embedding")
    return rounded(scaled.select("vec_id", F.posexplode("embedding").alias("pos", "value")))


@query(
    "WITH d AS (SELECT doc_id, quality::double AS q, toxic::double AS t, n_chars::double AS n FROM documents LEFT JOIN labels USING (doc_id)),"
    " l AS (SELECT doc_id, unnest([q, t, n]) AS x, unnest([0, 1, 2]) AS pos FROM d),"
    " m AS (SELECT pos, avg(x) AS m FROM l GROUP BY pos) SELECT doc_id, pos::bigint AS pos, round(coalesce(x, m), 6) AS value FROM l JOIN m USING (pos)"
)
def impute_mean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    packed = pack_features(joined, ["quality", "toxic", "n_chars"], "x")
    filled = B.ImputeMean.fit(packed, "x").transform(packed, "x")
    return rounded(filled.select("doc_id", F.posexplode("x").alias("pos", "value")))


@query(
    f"WITH l AS ({_LONG}) SELECT vec_id AS doc_id, pos::bigint AS pos, round(x, 5) AS value FROM l"
    " UNION ALL SELECT vec_id, 64 + p, round(v, 5) FROM (SELECT vec_id, unnest([0, 1])::bigint AS p, unnest([label::double, vec_id::double]) AS v FROM embeddings)"
)
def concat_blocks(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    blocks = emb.select(
        c("vec_id").alias("doc_id"),
        F.array(c("label").cast("double"), c("vec_id").cast("double")).alias("feat"),
        c("embedding").alias("style"),
    )
    out = B.concat_blocks(blocks, {"feat": True, "style": True})
    return rounded(out.select("doc_id", F.posexplode(vector_to_array("features")).alias("pos", "value")), 5)


# Rows of the test split, by the same cut as `stratified_split`.
TEST_SQL = cut_sql(0.2) + ", t AS (SELECT doc_id, quality::bigint AS label FROM r WHERE rn <= round_even(0.2::double * n, 0))"
COMPONENTS = 300


@query(f"SELECT unnest(range({COMPONENTS}))::bigint AS component, true AS is_column_length, true AS falling")
def svd_singular_values(spark, sf_dir):
    """Singular values of the documents' TF-IDF matrix: none above the one before, and each the length
    of its projected column, which the stored rows give independently."""
    docs = documents(spark, sf_dir)
    vectors = materialize(fit_tfidf(docs).transform(docs))
    model = svd_reduce(vectors, k=COMPONENTS)
    s = [float(x) for x in model.singular_values]
    falling = [i == 0 or s[i - 1] >= s[i] for i in range(len(s))]
    values = spark.createDataFrame(list(zip(range(len(s)), s, falling, strict=True)), "component int, s double, falling boolean")
    projected = model.transform(vectors).select(F.posexplode("tfidf").alias("component", "x"))
    lengths = projected.groupBy("component").agg(F.sqrt(F.sum(c("x") * c("x"))).alias("length"))
    same = F.abs(c("s") - c("length")) <= 1e-6 * max(s)
    return rounded(values.join(lengths, "component").select("component", same.alias("is_column_length"), "falling"))


def _block_widths() -> str:
    widths = {"style": len(FUNCTION_WORDS) + Y.TRIGRAM_BUCKETS, "feat": len(FEATURE_COLUMNS), "pplx": 1, "tfidf": COMPONENTS}
    return ", ".join(f"('{b}', {w})" for b, w in widths.items())


@query(
    TEST_SQL + f" SELECT block, (SELECT count(*) FROM r) - (SELECT count(*) FROM t) AS n_docs, width::bigint AS width, true AS centred, true AS scaled"
    f" FROM (VALUES {_block_widths()}) w(block, width)"
)
def build_blocks(spark, sf_dir):
    """Per block of the scaled training rows: rows, width, and whether columns have mean 0 and mean
    square 1 (less where gaps were filled with the mean, 0 if constant)."""
    train, _, _ = built_blocks(spark, sf_dir)
    rows = [
        train.select(F.lit(b).alias("block"), "doc_id", F.posexplode(b).alias("pos", "x")) for b in B.BLOCK_ORDER
    ]
    long_df = rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
    columns = long_df.groupBy("block", "pos").agg(
        F.countDistinct("doc_id").alias("n"), F.avg("x").alias("mean"), F.avg(c("x") * c("x")).alias("square")
    )
    return rounded(
        columns.groupBy("block").agg(
            F.max("n").alias("n_docs"),
            (F.max("pos") + 1).alias("width"),
            F.bool_and(F.abs("mean") < 1e-6).alias("centred"),
            (F.max("square").between(0.9, 1 + 1e-6)).alias("scaled"),
        )
    )


_FEATURE_LIST = ", ".join("'" + f.replace("'", "''") + "'" for f in FEATURE_COLUMNS)


@query(f"SELECT unnest([{_FEATURE_LIST}]) AS feature, true AS is_share, 1::double AS total")
def rf_importances(spark, sf_dir):
    """Every feature with whether its importance is a share, and their sum."""
    train, _ = feature_splits(spark, sf_dir)
    found = SE.rf_importances(train, FEATURE_COLUMNS)
    total = found.agg(F.sum("importance").alias("total"))
    return rounded(found.join(F.broadcast(total)).select("feature", c("importance").between(0, 1).alias("is_share"), "total"))


def _selection(spark, sf_dir):
    train, test = feature_splits(spark, sf_dir)
    return train, test, SE.select_features(train, FEATURE_COLUMNS)


@query("SELECT 20::bigint AS n_penalties, true AS best_penalty, true AS optimal, true AS upper_three_quarters")
def ridge_select(spark, sf_dir):
    """The ridge choice: the penalty has the best score, the coefficients satisfy the normal equations on
    the stored rows (sums by SQL functions), and the kept ones are those above the lower quartile."""
    train, _, selection = _selection(spark, sf_dir)
    fit, kept = selection.ridge, selection.forest_kept
    rows = selection.scaled(train).select("x", c("label").cast("double").alias("y"))
    means = {r["pos"]: r["m"] for r in rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).collect()}
    centred = F.zip_with("x", B.constants([means[i] for i in range(len(kept))]), lambda x, m: x - m)
    guess = F.aggregate(F.zip_with(centred, B.constants(fit.coefficients), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    y_mean = rows.agg(F.avg("y")).first()[0]
    rest = rows.select(centred.alias("x"), (c("y") - y_mean - guess).alias("e"))
    pulls = rest.select(F.posexplode("x").alias("pos", "v"), "e").groupBy("pos").agg(F.sum(c("v") * c("e")).alias("pull"))
    table = spark.createDataFrame([(i, w) for i, w in enumerate(fit.coefficients)], "pos int, w double")
    optimal = pulls.join(table, "pos").agg(F.bool_and(F.abs(c("pull") - fit.alpha * c("w")) < 1e-6).alias("optimal"))
    sizes = sorted(abs(w) for w in fit.coefficients)
    cut = sizes[max(0, -(-(len(sizes) - 1) // 4) - 1) : -(-(len(sizes) - 1) // 4) + 1]
    upper = all((f in fit.kept) or abs(w) <= cut[-1] for f, w in zip(kept, fit.coefficients, strict=True))
    upper = upper and all(abs(w) >= cut[0] for f, w in zip(kept, fit.coefficients, strict=True) if f in fit.kept)
    best = fit.scores[fit.alpha] == max(fit.scores.values())
    return rounded(optimal.select(F.lit(len(fit.scores)).alias("n_penalties"), F.lit(best).alias("best_penalty"), "optimal", F.lit(upper).alias("upper_three_quarters")))


@query("SELECT true AS falling, true AS at_least_the_mean, true AS has_names")
def selection_report(spark, sf_dir):
    """The report of the kept features: order, the cut at the mean importance, display names."""
    _, _, selection = _selection(spark, sf_dir)
    kept = spark.createDataFrame([(f,) for f in selection.forest_kept], "feature string")
    rows = SE.selection_report(selection.importances, kept).collect()
    mean = selection.importances.agg(F.avg("importance")).first()[0]
    values = [r["importance"] for r in rows]
    row = (
        values == sorted(values, reverse=True),
        min(values) >= mean and len(rows) == selection.importances.where(c("importance") >= mean).count(),
        all(r["feature"] for r in rows),
    )
    return spark.createDataFrame([row], "falling boolean, at_least_the_mean boolean, has_names boolean")


@query("SELECT true AS are_shares, true AS better_than_nothing")
def selection_accuracy(spark, sf_dir):
    """Scores of the final features on the test rows: shares, and an accuracy above that of a guess."""
    train, test, selection = _selection(spark, sf_dir)
    r = SE.selection_accuracy(selection, train, test)
    shares = [c(m).between(0, 1) for m in ("accuracy", "precision", "recall", "f1")]
    return r.select((shares[0] & shares[1] & shares[2] & shares[3]).alias("are_shares"), (c("accuracy") > 0.5).alias("better_than_nothing"))


def _features(spark, sf_dir):
    packed = pack_features(feature_table(split_documents(spark, sf_dir)), FEATURE_COLUMNS, "feat")
    train, test = splits(packed.select("doc_id", "label", "split", "feat"))
    train, test, _ = B.build_blocks(train, test, text=None)
    flags = {"feat": True}
    return B.concat_blocks(train, flags).select("doc_id", "label", "features"), B.concat_blocks(test, flags)


def optimal(model: LinearModel, train: DataFrame, c_value: float = 1.0, limit: float = 1e-6) -> bool:
    """True if the gradient of the penalised mean loss is below ``limit`` in every entry; it is summed
    by DataFrame functions, apart from the code that fits."""
    rows = train.select(vector_to_array("features").alias("x"), (2 * c("label") - 1).cast("double").alias("y"))
    rows = rows.withColumn("f", model.margin(c("x")))
    if model.loss == SQUARED_HINGE:
        slope = -2 * c("y") * F.greatest(F.lit(0.0), 1 - c("y") * c("f"))
    else:
        slope = -c("y") / (1 + F.exp(c("y") * c("f")))
    rows = rows.select(F.concat("x", F.array(F.lit(1.0))).alias("x"), slope.alias("slope"))
    n = rows.count()
    pulls = rows.select(F.posexplode("x").alias("pos", "v"), "slope").groupBy("pos").agg((F.sum(c("v") * c("slope")) / n).alias("pull"))
    weights = [*(float(w) for w in model.coefficients), model.intercept if model.loss == SQUARED_HINGE else 0.0]
    table = train.sparkSession.createDataFrame(list(enumerate(weights)), "pos int, w double")
    worst = pulls.join(table, "pos").agg(F.max(F.abs(c("pull") + c("w") / (c_value * n))), F.count("*")).first()
    return worst[0] < limit and worst[1] == len(weights)


def _predicted(spark, sf_dir, fit):
    """Test rows: whether the probability is one and agrees with the label given, and, for a linear model,
    whether the fit is at its minimum."""
    train, test = _features(spark, sf_dir)
    model = fit(train)
    preds = CL.predict(model, test)
    p = c("prediction_probability")
    agrees = (c("predicted_label") == (p > 0.5).cast("int")).alias("agrees")
    out = [c("doc_id"), c("label"), p.between(0, 1).alias("is_probability"), agrees]
    if isinstance(model, LinearModel):
        out.append(F.lit(optimal(model, train)).alias("optimal"))
    return rounded(preds.select(*out))


_TEST_ROWS = TEST_SQL + " SELECT doc_id, label, true AS is_probability, true AS agrees"


@query(_TEST_ROWS + ", true AS optimal FROM t")
def linear_svm(spark, sf_dir):
    return _predicted(spark, sf_dir, CL.fit_svm)


@query(_TEST_ROWS + " FROM t")
def random_forest(spark, sf_dir):
    return _predicted(spark, sf_dir, CL.fit_rf)


@query(_TEST_ROWS + ", true AS optimal FROM t")
def logistic_regression(spark, sf_dir):
    return _predicted(spark, sf_dir, CL.fit_lr)


@query(
    "SELECT doc_id, round(1 / (1 + exp(-(n_chars::double / 1000 - 1))), 6) AS probability_class_1 FROM documents"
)
def margin_probabilities(spark, sf_dir):
    """Sigmoid of a margin, for a model without class probabilities."""
    from pyspark.ml.functions import array_to_vector

    margin = c("n_chars").cast("double") / 1000 - 1
    docs = table(spark, sf_dir, "documents").select("doc_id", array_to_vector(F.array(-margin, margin)).alias("rawPrediction"))
    return rounded(CL.with_probabilities(docs).select("doc_id", "probability_class_1"))


SCORES = ("accuracy", "precision", "recall", "f1")


@query(TEST_SQL + " SELECT count(*) AS n_test, count(*) FILTER (WHERE label = 1) AS n_ones, true AS same_scores, true AS timed, true AS has_speed FROM t")
def evaluate_classifier(spark, sf_dir):
    """Fit, predict, time and score one configuration; the scores against those of the stored
    predictions."""
    train, test = _features(spark, sf_dir)
    r = CL.evaluate(CL.fit_lr, train, test)
    again = macro_scores(confusion_matrix(r["predictions"])).first()
    same = all(abs(again[m] - r[m]) < 1e-12 for m in SCORES)
    matrix = r["matrix"]
    row = [(sum(map(sum, matrix)), sum(matrix[1]), same, r["train_time"] > 0, r["inference_speed"] > 0)]
    return rounded(spark.createDataFrame(row, "n_test bigint, n_ones bigint, same_scores boolean, timed boolean, has_speed boolean"))


@query(
    cut_sql(0.2)
    + " SELECT doc_id, quality::bigint AS label, true AS same_label, true AS same_probability FROM r"
    " WHERE rn <= round_even(0.2::double * n, 0)"
)
def saved_model_round_trip(spark, sf_dir):
    """A stored and reloaded model against the fitted one, per test document."""
    train, test = _features(spark, sf_dir)
    path = scratch(spark, "models")
    fitted = CL.fit_lr(train)
    io.save_models({("Single - Feat", "LogisticReg"): fitted}, path)
    fresh = CL.predict(fitted, test).select("doc_id", "label", "predicted_label", "prediction_probability")
    loaded = CL.predict(io.load_model(path, "Single - Feat", "LogisticReg"), test)
    loaded = loaded.select("doc_id", c("predicted_label").alias("again"), c("prediction_probability").alias("p_again"))
    same = (c("predicted_label") == c("again")).alias("same_label")
    same_p = (c("prediction_probability") == c("p_again")).alias("same_probability")
    return rounded(fresh.join(loaded, "doc_id", "full").select("doc_id", "label", same, same_p))


_GRIDS: dict[tuple[str, str], tuple[DataFrame, str]] = {}


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Results of the full grid and the folder of its predictions; run once per session and data folder,
    as two queries read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRIDS:
        train, test, _ = built_blocks(spark, sf_dir)
        results, preds, _ = AB.run_ablation(train, test)
        path = scratch(spark, "ablation")
        io.write_predictions(preds, path)
        _GRIDS[key] = results, path
    return _GRIDS[key]


_CONFIGURATIONS = ", ".join(f"('{v}', '{k}')" for v in AB.VARIANTS for k in CL.CLASSIFIERS)


@query(
    TEST_SQL + ' SELECT variant AS "Variant", classifier AS "Classifier", (SELECT count(*) FROM t) AS n_test, true AS same_scores'
    f" FROM (VALUES {_CONFIGURATIONS}) v(variant, classifier)"
)
def run_ablation(spark, sf_dir):
    """All 27 configurations at the library's settings, their scores against those of the stored
    prediction files."""
    results, path = grid(spark, sf_dir)
    stored, _ = io.read_predictions(spark, path)
    again = macro_scores(confusion_matrix(stored, by=["variant", "classifier"]), by=["variant", "classifier"])
    names = [c("variant").alias("Variant"), c("classifier").alias("Classifier")]
    again = again.select(*names, *[c(m).alias(f"{m}_again") for m in SCORES])
    counts = stored.groupBy(*names).agg(F.count("*").alias("n_test"))
    same = F.lit(True)
    for m in SCORES:
        column = "F1" if m == "f1" else m.capitalize()
        same &= F.abs(c(column) - c(f"{m}_again")) < 1e-12
    joined = results.join(again, ["Variant", "Classifier"]).join(counts, ["Variant", "Classifier"])
    return rounded(joined.select("Variant", "Classifier", "n_test", same.alias("same_scores")))


@query("SELECT 15::bigint AS n_pairs, 6::bigint AS n_models, true AS are_probabilities, true AS not_below_raw")
def ablation_to_significance(spark, sf_dir):
    """The tests between the best six models of the grid's stored predictions."""
    from penmark.operators import significance as Z
    from penmark.operators.joins import top_model_predictions

    results, path = grid(spark, sf_dir)
    stored, _ = io.read_predictions(spark, path)
    best = top_model_predictions(stored, results, 6)
    models = [r["model"] for r in best.select("model").distinct().collect()]
    tests = Z.wilcoxon_results(best, models)
    return rounded(
        tests.agg(
            F.count("*").alias("n_pairs"),
            F.lit(len(models)).alias("n_models"),
            F.bool_and(c("p_value").isNull() | c("p_value").between(0, 1)).alias("are_probabilities"),
            F.bool_and(c("p_value").isNull() | (c("p_value_corrected") >= c("p_value"))).alias("not_below_raw"),
        )
    )
