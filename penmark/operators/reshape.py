"""Projections and reshaping: column splits, recoding, pivots, vector cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Display names of the features in reports.  Keys are this library's names.
DISPLAY_NAMES = {
    "lexical_richness": "Lexical Richness",
    "mean_word_length": "Avg. Word Length",
    "stopword_ratio": "Stopwords Ratio",
    "mean_sentence_words": "Avg. Sentence Length",
    "syntactic_complexity": "Syntactic Complexity",
    "polarity": "Polarity",
    "subjectivity": "Subjectivity",
    "ngram_diversity": "n-gram Diversity",
    "prop_PUNCT": "Punctuation Prop.",
    "prop_VERB": "Verb Prop.",
    "prop_NOUN": "Noun Prop.",
    "prop_ADV": "Adverb Prop.",
    "prop_INTJ": "Interjection Prop.",
    "prop_ADP": "Adposition Prop.",
    "prop_SCONJ": "Subordinating Conjunction Prop.",
    "punct_,": "Comma Prop.",
    "punct_.": "Period Prop.",
    "prop_SPACE": "Space Prop.",
    "prop_X": "Other Prop.",
    "punct_;": "Semicolon Prop.",
    "punct_!": "Exclamation Prop.",
    "prop_PRON": "Pronoun Prop.",
    "punct_?": "Question Mark Prop.",
    "num_tokens": "Number of Tokens",
    "num_sentences": "Number of Sentences",
    "avg_word_length": "Avg Word Length",
    "total_connectors": "Total Connectors",
    "connector_density": "Connector Density",
    "unique_connectors": "Unique Connectors",
    "also": "also",
    "or": "or",
    "so": "so",
    "2-grams": "2-grams",
    "3-grams": "3-grams",
    "avg_depth": "Avg. Depth",
    "flesch": "Flesch Score",
    "lexical_entropy": "Lexical Entropy",
    "unusual_word_ratio": "Unusual Word Frequency",
    "prop_PROPN": "Proper Noun Prop.",
    "prop_NUM": "Number Prop.",
    "prop_ADJ": "Adjective Prop.",
    "prop_AUX": "Auxiliary Prop.",
    "prop_CCONJ": "Coordinating Conjunction Prop.",
    "as": "as",
    "and": "and",
    "If": "if",
}

# Column names in feature files made before this library -> this library's names.
SOURCE_NAMES = {
    "riqueza_lexica": "lexical_richness",
    "longitud_media_palabra": "mean_word_length",
    "proporción_stopwords": "stopword_ratio",
    "longitud_media_oracion": "mean_sentence_words",
    "complejidad_sintactica": "syntactic_complexity",
    "polaridad": "polarity",
    "subjetividad": "subjectivity",
    "diversidad_ngramas": "ngram_diversity",
    "Flesch Score": "flesch",
    "Lexical Entropy": "lexical_entropy",
    "Syntactic Repetition": "dep_repetition",
    "Unusual Word Frequency": "unusual_word_ratio",
}

# Verdict texts of the zero-shot detector and their codes.
VERDICTS = {"Most likely human-generated": 0, "Most likely AI-generated": 1}


def rename_source_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SOURCE_NAMES)


def split_columns(df: DataFrame, meta_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(metadata, features) by name; both are projections that prune the scan."""
    features = [f"`{c}`" for c in df.columns if c not in meta_cols]
    return df.select(*meta_cols), df.select(*features)


def drop_unscored(df: DataFrame, col: str = "prediction") -> DataFrame:
    return df.dropna(subset=[col])


def recode(df: DataFrame, col: str, mapping: Mapping[str, int] = VERDICTS) -> DataFrame:
    """Replace values by their codes; a value outside the mapping becomes null."""
    expr = F.lit(None).cast("int")
    for value, code in mapping.items():
        expr = F.when(F.col(col) == value, F.lit(code)).otherwise(expr)
    return df.withColumn(col, expr)


def rename_values(df: DataFrame, col: str, mapping: Mapping[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Replace values by the mapping; a value outside the mapping is kept."""
    return df.replace(dict(mapping), subset=[col])


def widen(long_df: DataFrame, keys: Sequence[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Long ``(doc_id, feature, value)`` to one column per feature; a missing feature is null.

    Pass ``keys`` (the training set's features) so that train and test get the same columns and
    Spark needs no extra job to list them."""
    pivoted = long_df.groupBy(key).pivot("feature", list(keys) if keys is not None else None)
    return pivoted.agg(F.first("value"))


def widen_map(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Map column to one column per key, row-local; a missing key is null."""
    taken = [F.try_element_at(F.col(col), F.lit(k)).alias(k) for k in keys]
    return df.select(*[f"`{c}`" for c in df.columns if c != col], *taken)


def unpack(df: DataFrame, col: str) -> DataFrame:
    """Struct column to its fields."""
    return df.select(*[f"`{c}`" for c in df.columns if c != col], f"{col}.*")


def parse_vector(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """Vector cell to ``array<float>``: an array, a number, or text holding either
    (``[1, 2]``, ``(1, 2)``, ``4.5``).  Anything else, null included, is an error."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.ArrayType):
        parsed = c.cast("array<float>")
    elif isinstance(dtype, T.NumericType):
        parsed = F.when(c.isNotNull(), F.array(c.cast("float")))
    else:
        text = c.cast("string")
        # Python spells missing values nan; JSON wants them quoted to read them as floats.
        as_json = F.regexp_replace(F.translate(text, "()", "[]"), r"(?i)\bnan\b", '"NaN"')
        as_json = F.regexp_replace(as_json, r",\s*\]", "]")
        listed = F.from_json(as_json, "array<float>")
        number = text.try_cast("float")
        parsed = F.coalesce(listed, F.when(number.isNotNull(), F.array(number)))
    message = F.concat(F.lit("the cell is not a vector: "), F.coalesce(c.cast("string"), F.lit("null")))
    return F.coalesce(parsed, F.raise_error(message).cast("array<float>"))


def parse_vector_column(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, parse_vector(col, df.schema[col].dataType))


def vector_width(df: DataFrame, col: str) -> int:
    """Length of the longest vector: one number from one partial aggregate."""
    return df.agg(F.max(F.size(col))).first()[0] or 0


def pad_vectors(df: DataFrame, col: str, width: int | None = None) -> DataFrame:
    """Right-pad ragged vectors with NaN.  ``width`` defaults to the longest in ``df``; pass the
    training width for test data."""
    width = vector_width(df, col) if width is None else width
    v = F.col(col)
    missing = F.greatest(F.lit(width) - F.size(v), F.lit(0))
    padding = F.array_repeat(F.lit(float("nan")).cast("float"), missing)
    return df.withColumn(col, F.concat(v.cast("array<float>"), padding))


def cast_label(df: DataFrame, col: str = "label") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("int"))


def pack_features(df: DataFrame, cols: Sequence[str], into: str = "feature_select") -> DataFrame:
    """Scalar columns into one vector column, in the given order; null becomes NaN."""
    packed = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in cols])
    return df.withColumn(into, packed)


def assert_same_columns(a: DataFrame, b: DataFrame) -> None:
    """Schema check only; no job."""
    if a.columns != b.columns:
        odd = sorted(set(a.columns) ^ set(b.columns))
        raise ValueError(f"train and test columns differ: {odd or 'same names in another order'}")


def shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_columns)``; the count reads no column data."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
