"""Joins: feature tables on the document key, words against a word list, model filters and pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.functions import connectors as C
from penmark.functions import tokens as K
from penmark.functions.arrays import let, ratio, round2
from penmark.physical import MAX_BROADCAST_ROWS, broadcast_checked, explode_computed
from penmark.session import materialize


def combine_features(base: DataFrame, *feature_tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Put feature tables next to the base table.  All joins share one key, so after the first
    one the left side is already partitioned and only the next table moves.  Columns that an
    earlier table has are not repeated."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        fresh = [c for c in right.columns if c == key or c not in left.columns]
        return left.join(right.select(*[f"`{c}`" for c in fresh]), key, "left")

    return reduce(add, feature_tables, base)


def distinct_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct lower-cased words per document, as an array (row-local)."""
    return df.select("doc_id", F.array_distinct(K.words(F.lower(F.col(text)))).alias("words"))


def unusual_words(
    df: DataFrame, lexicon: DataFrame, text: str = "text", max_broadcast: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Per document: distinct words, those outside the lexicon, and their share.

    Words are made distinct inside the row before they are exploded.  A lexicon under the size
    limit is broadcast and nothing but one partial count per document is shuffled; a larger one
    joins by word, where adaptive execution splits a frequent word's partition.  The distinct list is
    stored, so measuring it does not compute it twice.  It keeps its case, as given: entries with capitals never match."""
    listed = lexicon.select(F.col(lexicon.columns[0]).alias("word")).where("word IS NOT NULL").distinct()
    listed = broadcast_checked(materialize(listed).withColumn("common", F.lit(1)), max_broadcast)
    exploded = distinct_words(df, text).select("doc_id", F.explode_outer("words").alias("word"))
    counted = (
        exploded.join(listed, "word", "left")
        .groupBy("doc_id")
        .agg(
            F.count("word").alias("distinct_words"),
            F.count_if(F.col("word").isNotNull() & F.col("common").isNull()).alias("unusual_words"),
        )
    )
    return counted.withColumn(
        "unusual_word_ratio", round2(ratio(F.col("unusual_words"), F.col("distinct_words")))
    )


def words_outside(df: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """The set difference itself: ``(doc_id, word)`` for distinct words that the lexicon lacks."""
    listed = broadcast_checked(materialize(lexicon.select(F.col(lexicon.columns[0]).alias("word")).distinct()))
    exploded = explode_computed(distinct_words(df, text), F.col("words"), ["word"], ["doc_id"])
    return exploded.join(listed, "word", "left_anti").select("doc_id", "word")


def connector_table(df: DataFrame, phrases: Sequence[str], text: str = "text") -> DataFrame:
    """``(doc_id, phrase, n)`` for every document and phrase.  Phrases are literals, so the
    product of documents and phrases is an inline array and not a join."""
    counts = let(C.strip_symbols(F.col(text)), lambda stripped: C.connector_counts(stripped, phrases))
    return explode_computed(df, counts, ["phrase", "n"], ["doc_id"])


def connector_hits(df: DataFrame, phrases: Sequence[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, phrase, n)`` for the phrases that a document holds, for lists of any length.

    The counts are those of ``connector_table`` without its zeros.  An Aho-Corasick automaton of all
    phrases reads each text once, whatever their number; of overlapping matches of one phrase the first
    counts.  A null text has no hits; repeated rows each give theirs."""
    import ahocorasick

    listed = C.clean_phrases(phrases)
    if not listed:
        return df.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("phrase"), F.lit(0).alias("n")).limit(0)
    same: dict[str, list[int]] = {}
    for i, p in enumerate(listed):
        same.setdefault(p.lower(), []).append(i)
    patterns = list(same)
    shared = df.sparkSession.sparkContext.broadcast((listed, patterns, [same[p] for p in patterns]))
    rows = df.select(F.col(doc_id).alias("doc_id"), C.strip_symbols(F.col(text)).alias("stripped"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("phrase", T.StringType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, places = shared.value
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(texts):
            automaton.add_word(p, (i, len(p)))
        automaton.make_automaton()
        for batch in batches:
            row, phrase, count = [], [], []
            for at, stripped in enumerate(batch.column(1).to_pylist()):
                n: dict[int, int] = {}
                free: dict[int, int] = {}
                for end, (i, size) in automaton.iter(stripped or ""):
                    if end - size >= free.get(i, -1):
                        n[i] = n.get(i, 0) + 1
                        free[i] = end
                for i, k in n.items():
                    for j in places[i]:
                        row.append(at)
                        phrase.append(names[j])
                        count.append(k)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(phrase, pa.string()), pa.array(count, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def selected_importances(importances: DataFrame, selected: DataFrame) -> DataFrame:
    """Importances of the selected features only (one row per feature: tiny on both sides)."""
    return importances.join(selected.select("feature").distinct(), "feature", "left_semi")


def top_model_predictions(preds: DataFrame, results: DataFrame, k: int = 6) -> DataFrame:
    """Predictions of the k best configurations.  The filter side has k rows by construction,
    so it is broadcast, and it prunes the (variant, classifier) partitions when the table is
    stored by them."""
    from penmark.operators.ranking import top_k

    best = top_k(results, "F1", k).select(
        F.col("Variant").alias("variant"), F.col("Classifier").alias("classifier")
    )
    return preds.join(F.broadcast(best), ["variant", "classifier"], "left_semi")


def pair_predictions(preds: DataFrame, models: Sequence[str], score: str = "score") -> DataFrame:
    """All unordered pairs of the given models, aligned per document:
    ``(doc_id, model_a, model_b, score_a, score_b)``.

    One aggregation puts a document's scores side by side (one column per model) and the pairs
    are read off inside the row, so the predictions are shuffled once and not twice as in a
    self join.  ``models`` is the short list of compared models; a document that lacks one of
    the two scores yields no row for that pair, as in an inner join."""
    names = sorted(models)
    wide = preds.groupBy("doc_id").pivot("model", names).agg(F.first(score))
    pairs = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            F.col(f"`{a}`").alias("score_a"),
            F.col(f"`{b}`").alias("score_b"),
        )
        for a, b in combinations(names, 2)
    ]
    return wide.select("doc_id", F.inline(F.array(*pairs))).where(
        "score_a IS NOT NULL AND score_b IS NOT NULL"
    )
