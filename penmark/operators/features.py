"""The linguistic feature record: one row per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.functions import connectors as C
from penmark.functions import lexical as L
from penmark.functions import sentiment as S
from penmark.functions import tagging as G
from penmark.functions import tokens as K
from penmark.functions.lexicon import CONNECTORS, FUNCTION_WORDS
from penmark.operators.joins import unusual_words
from penmark.physical import inline_computed

ANNOTATION_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("sent_id", T.IntegerType()),
        T.StructField("tok_id", T.IntegerType()),
        T.StructField("token", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("dep", T.StringType()),
        T.StructField("is_alpha", T.BooleanType()),
        T.StructField("is_stop", T.BooleanType()),
        T.StructField("is_punct", T.BooleanType()),
    ]
)
Tagger = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

SCALARS = [
    "lexical_richness", "mean_word_length", "stopword_ratio", "mean_sentence_words",
    "syntactic_complexity", "polarity", "subjectivity", "ngram_diversity", "avg_sentence_length",
    "num_tokens", "num_sentences", "avg_word_length", "total_connectors", "connector_density",
    "unique_connectors", "flesch", "lexical_entropy", "dep_repetition", "unusual_word_ratio",
    "2-grams", "3-grams",
]
FAMILIES = ["connector_counts", "pos_shares", "punct_shares"]


def annotate(df: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """Token table ``(doc_id, sent_id, tok_id, token, pos, dep, is_alpha, is_stop, is_punct)``.

    The default rules are one pass without a shuffle.  ``tagger`` receives Arrow batches of
    ``(doc_id, text)`` and yields rows of the same schema."""
    source = df.select("doc_id", F.col(text).alias("text"))
    if tagger is not None:
        return source.mapInPandas(tagger, ANNOTATION_SCHEMA)
    schema = T.StructType([source.schema["doc_id"], *ANNOTATION_SCHEMA.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [pa.array(G.TAGS), pa.array(G.DEPS)]
        for batch in batches:
            at = 0
            for part in G.token_slices(batch.column(1)):
                t = G.tag_tokens(part)
                alpha = pc.match_substring_regex(t.words, K.IS_ALPHA_RE).to_numpy(zero_copy_only=False)
                stop = pc.is_in(t.low, pa.array(FUNCTION_WORDS)).to_numpy(zero_copy_only=False)
                columns = [
                    batch.column(0).take(pa.array(at + t.row)),
                    pa.array(t.sent_id.astype(np.int32)),
                    pa.array(t.tok_id.astype(np.int32)),
                    t.words.take(pa.array(t.code)),
                    *[n.take(pa.array(x)) for n, x in zip(names, (t.pos, t.dep), strict=True)],
                    pa.array(alpha[t.code]),
                    pa.array(stop[t.code]),
                    pa.array(t.pos == G.TAGS.index("PUNCT")),
                ]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    marks = G.sentence_marks(K.sentences(F.col("text")))
    return source.select("doc_id", marks.alias("marks")).mapInArrow(run, schema)


def with_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the text, and each token stream once; later expressions only refer to them."""
    t = F.col(text)
    return df.select(
        "doc_id",
        *keep,
        t.alias("text"),
        K.words(F.lower(t)).alias("words"),
        K.alpha(t).alias("alpha"),
        K.marks(t).alias("marks"),
        K.terms(t).alias("terms"),
        K.sentences(t).alias("sentences"),
        C.strip_symbols(t).alias("stripped"),
    )


def linguistic_features(
    df: DataFrame,
    text: str = "text",
    connectors: Sequence[str] = tuple(CONNECTORS),
    common_words: DataFrame | Sequence[str] | None = None,
    stop: Sequence[str] = tuple(FUNCTION_WORDS),
    keep: Sequence[str] = (),
) -> DataFrame:
    """All linguistic features, one row per document.

    Everything is row-local: one scan, one projection chain, no shuffle, and it also runs on a
    streaming DataFrame.  Only a ``common_words`` *table* adds a join (one row per document is
    shuffled); a short list stays row-local; without either the ratio is null."""
    # What Arrow batches give comes first, while a row is only its text: token streams are not queued
    # beside the batches.
    counted = df.select(
        "doc_id",
        *keep,
        F.col(text).alias("text"),
        G.annotation_counts(K.sentences(F.col(text))).alias("tags"),
        L.readability_counts(F.col(text)).alias("readability"),
    )
    base = with_tokens(counted, "text", [*keep, "tags", "readability"])
    annotated = base.withColumns(
        {
            "sentence_lengths": L.sentence_lengths(F.col("sentences")),
            "connector_counts": C.connector_counts(F.col("stripped"), connectors),
            "sentiment": S.sentiment(F.col("marks")),
        }
    )
    c = F.col
    num_tokens, num_alpha, num_sentences = F.size("marks"), F.size("alpha"), F.size("sentences")
    unusual = F.lit(None).cast("double")
    if isinstance(common_words, (list, tuple)):
        unusual = L.unusual_word_ratio(c("words"), common_words)
    out = annotated.select(
        "doc_id",
        *keep,
        L.lexical_richness(c("alpha")).alias("lexical_richness"),
        L.mean_word_length(c("alpha")).alias("mean_word_length"),
        L.stopword_ratio(c("marks"), c("alpha"), stop).alias("stopword_ratio"),
        L.mean_sentence_words(c("sentences")).alias("mean_sentence_words"),
        G.syntactic_complexity(c("tags"), num_sentences).alias("syntactic_complexity"),
        c("sentiment.polarity").alias("polarity"),
        c("sentiment.subjectivity").alias("subjectivity"),
        L.ngram_diversity(c("terms"), c("alpha")).alias("ngram_diversity"),
        L.array_mean(c("sentence_lengths")).alias("avg_sentence_length"),
        "sentence_lengths",
        num_tokens.alias("num_tokens"),
        num_sentences.alias("num_sentences"),
        L.avg_word_length(c("marks")).alias("avg_word_length"),
        C.total_connectors(c("connector_counts")).alias("total_connectors"),
        C.connector_density(C.total_connectors(c("connector_counts")), c("marks")).alias("connector_density"),
        C.unique_connectors(c("connector_counts")).alias("unique_connectors"),
        L.flesch_score(c("readability")).alias("flesch"),
        L.lexical_entropy(c("words")).alias("lexical_entropy"),
        G.dep_repetition(c("tags")).alias("dep_repetition"),
        unusual.alias("unusual_word_ratio"),
        K.ngram_density(num_tokens, 2).alias("2-grams"),
        K.ngram_density(num_tokens, 3).alias("3-grams"),
        "connector_counts",
        G.pos_shares(c("tags"), num_alpha).alias("pos_shares"),
        G.punct_shares(c("tags"), num_alpha).alias("punct_shares"),
    )
    if isinstance(common_words, DataFrame):
        ratios = unusual_words(df.select("doc_id", F.col(text).alias("text")), common_words)
        out = (
            out.drop("unusual_word_ratio")
            .join(ratios.select("doc_id", "unusual_word_ratio"), "doc_id", "left")
            .select(*out.columns)
        )
    return out


def long_features(features: DataFrame) -> DataFrame:
    """Canonical long form ``(doc_id, feature, value)``: scalars and the three families."""
    pairs = [F.struct(F.lit(s).alias("feature"), F.col(f"`{s}`").cast("double").alias("value")) for s in SCALARS]
    families = [
        F.transform(
            F.map_entries(F.col(f)),
            lambda e: F.struct(e["key"].alias("feature"), e["value"].cast("double").alias("value")),
        )
        for f in FAMILIES
    ]
    return inline_computed(features, F.concat(F.array(*pairs), *families), "feature", ["doc_id"])


def annotation_features(ann: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The annotation-based features from a token table, for tables made by an external tagger.

    The table is read once: every token gives a few (family, label) rows, which each task counts
    before the shuffle, so a very long document does not burden one task.  ``docs`` (``doc_id``) keeps
    documents without tokens, with zeros and empty maps."""
    one = F.lit(1).cast("bigint")

    def row(family: str, label: F.Column) -> F.Column:
        return F.struct(F.lit(family).alias("family"), label.cast("string").alias("label"))

    rows = F.array_compact(
        F.array(
            row("pos", F.col("pos")),
            row("dep", F.col("dep")),
            row("sentence", F.col("sent_id")),
            F.when(F.col("is_punct"), row("punct", F.col("token"))),
            F.when(F.col("is_alpha"), row("n", F.lit("alpha"))),
            F.when(F.col("is_stop"), row("n", F.lit("stop"))),
            F.when(F.col("dep").isin(G.CLAUSE_DEPS), row("n", F.lit("clause"))),
        )
    )
    counts = ann.select("doc_id", F.inline(rows)).groupBy("doc_id", "family", "label").agg(F.sum(one).alias("n"))
    entry = F.struct("label", "n")
    maps = [
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when((F.col("family") == f) & F.col("label").isNotNull(), entry)))
        ).alias(f"{f}_counts")
        for f in ("pos", "punct", "dep")
    ]

    def total(condition: F.Column) -> F.Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    joined = counts.groupBy("doc_id").agg(
        total((F.col("family") == "n") & (F.col("label") == "alpha")).alias("num_alpha"),
        total((F.col("family") == "n") & (F.col("label") == "stop")).alias("stops"),
        total((F.col("family") == "n") & (F.col("label") == "clause")).alias("clauses"),
        total(F.col("family") == "pos").alias("tokens"),
        F.count_if((F.col("family") == "sentence") & F.col("label").isNotNull()).alias("num_sentences"),
        *maps,
    )
    if docs is not None:
        joined = docs.select("doc_id").join(joined, "doc_id", "left").fillna(
            0, ["num_alpha", "stops", "clauses", "tokens", "num_sentences"]
        )

    def share(counts: str, prefix: str) -> F.Column:
        scaled = F.transform_values(counts, lambda k, v: v.cast("double") / F.col("num_alpha"))
        named = F.transform_keys(scaled, lambda k, v: F.concat(F.lit(prefix), k))
        empty = F.create_map().cast("map<string,double>")
        return F.when(F.col("num_alpha") > 0, F.coalesce(named, empty)).otherwise(empty)

    return joined.select(
        "doc_id",
        L.ratio(F.col("stops"), F.col("num_alpha")).alias("stopword_ratio"),
        L.ratio(F.col("clauses"), F.col("num_sentences")).alias("syntactic_complexity"),
        F.coalesce(L.round2(L.ratio(F.array_max(F.map_values("dep_counts")), F.col("tokens"))), F.lit(0.0)).alias("dep_repetition"),
        share("pos_counts", "prop_").alias("pos_shares"),
        share("punct_counts", "punct_").alias("punct_shares"),
    )
