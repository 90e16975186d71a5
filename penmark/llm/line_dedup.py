"""Line dedup through a log-template tree, in DataFrame functions only.

A line is parsed down a tree of fixed depth: first by its number of words, then by its first
``LEAD`` words; words with a digit count as a variable field, written ``<*>``, everywhere.  In a leaf
that holds several different lines, a word stays in the template only where at least ``support`` lines
of the leaf have it at that place; other places become ``<*>``.  A line whose template keeps less than
``min_constant`` of its places keeps its own form instead, its words with digits as fields.  A line
with nothing to tell it by (no word beside its fields, or a single one that is at most a third of it:
rows of numbers, time stamps) keeps its words as they are.  Templates that occur in at least ``min_docs`` documents are boilerplate: their lines are dropped from
every document.

1. One scan counts the documents of each leaf (leaves of one document counted once, combined before
   the shuffle).  Leaves below ``min_docs`` cannot hold a recurring template and are left out, by
   counting, not by sampling.
2. A second scan keeps the lines of the other leaves as hashes; each different line goes on once.
3. Word support is counted per (leaf, place, word) over different lines, weighted by their number.
4. Documents per template are counted on distinct (template, document) pairs, and line numbers to drop
   return to their documents.

Nulls and limits: null and empty texts have no lines.  Lines without a word are kept.  In lines of up
to ``LEAD`` words only words with digits are fields.
Rows equal in id and text count as one document and lose the same lines.  A null id is kept.  Extra
columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import KEYS, Store, row_keys, words
from penmark.physical import broadcast_checked, explode_computed, posexplode_computed

LEAD = 3
MIN_DOCS = 10
SUPPORT = 10
MIN_CONSTANT = 0.7
FIELD = "<*>"


def masked(tokens: Column) -> Column:
    """Words of a line, those with a digit replaced by the field mark."""
    return F.transform(tokens, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))


def parsed_line(line: Column) -> Column:
    """Masked words of a line; most lines have no digit and are not looked at word by word."""
    return F.when(line.rlike("[0-9]"), masked(words(line))).otherwise(words(line))


def constant(tokens: Column, min_constant: float) -> Column:
    """True where enough places of a form are words, not fields."""
    return F.size(F.filter(tokens, lambda t: t != FIELD)) >= min_constant * F.size(tokens)


def unnamed(tokens: Column) -> Column:
    """True for a masked line that its constant words do not tell from other lines."""
    firm = F.size(F.filter(tokens, lambda t: t != FIELD))
    return (firm < 2) & (3 * firm <= F.size(tokens))


def leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, LEAD))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    return docs.select(*row_keys(F.col(id_col), F.col(text_col)), lines.alias("lines"))


def dropped_lines(
    docs: DataFrame,
    store: Store,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    support: int = SUPPORT,
    min_constant: float = MIN_CONSTANT,
) -> DataFrame:
    """``key_a, key_b, gone``: the line numbers (from 0) that each document loses."""
    parsed = _lines(docs, id_col, text_col).select(*KEYS, F.transform("lines", parsed_line).alias("parsed"))
    wordy = F.filter("parsed", lambda t: F.size(t) > 0)
    leaves = parsed.select(*KEYS, F.transform(wordy, leaf).alias("leaves"))
    leaves = explode_computed(leaves, F.array_distinct("leaves"), ["leaf"])
    common = leaves.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    common = broadcast_checked(store.put(common, "leaves"))

    # Masked words and, where there are fields, hashes of the words as they are.
    both = F.transform(
        "lines",
        lambda x: F.struct(
            parsed_line(x).alias("tokens"),
            *[F.when(x.rlike(r"[0-9]|<\*>"), F.xxhash64(F.lit(f"own {k}"), words(x))).alias(f"own_{k}") for k in "ab"],
        ),
    )
    found = posexplode_computed(_lines(docs, id_col, text_col), both, ["at", "line"], KEYS).select(*KEYS, "at", "line.*")
    found = found.where(F.size("tokens") > 0)
    found = found.withColumn("leaf", leaf(F.col("tokens"))).join(common, "leaf")
    hashes = [F.xxhash64("tokens").alias("line_a"), F.xxhash64(F.lit("line"), "tokens").alias("line_b")]
    line = ["line_a", "line_b"]
    own = [F.when(unnamed(F.col("tokens")), F.col(c)).alias(c) for c in ("own_a", "own_b")]
    found = found.select(*KEYS, "at", "leaf", *hashes, *own, F.array_join("tokens", " ").alias("line"))
    found = store.put(found, "found")
    different = found.groupBy("leaf", *line).agg(F.count("*").alias("n"), F.min("line").alias("line"))
    different = store.put(different.withColumn("tokens", F.split("line", " ")).drop("line"), "different")

    several = different.groupBy("leaf").count().where("count > 1").select("leaf")
    several = broadcast_checked(store.put(several, "several"))
    varied = different.join(several, "leaf", "left_semi")
    places = varied.select("leaf", *line, "n", F.posexplode("tokens").alias("place", "word"))
    places = places.where(F.col("place") >= LEAD).withColumn("word", F.xxhash64("word"))
    firm = places.groupBy("leaf", "place", "word").agg(F.sum("n").alias("lines")).where(F.col("lines") >= support)
    kept = places.join(firm, ["leaf", "place", "word"]).groupBy(*line).agg(F.collect_set("place").alias("firm"))
    shaped = varied.join(kept, line, "left").select(
        *line,
        "tokens",
        F.transform(
            "tokens",
            lambda t, i: F.when((i < LEAD) | F.coalesce(F.array_contains("firm", i), F.lit(False)), t).otherwise(FIELD),
        ).alias("template"),
    )
    shaped = shaped.where(constant(F.col("template"), min_constant) & (F.col("template") != F.col("tokens")))
    shaped = shaped.select(
        *line, F.xxhash64("template").alias("made_a"), F.xxhash64(F.lit("line"), "template").alias("made_b")
    )
    shaped = broadcast_checked(store.put(shaped, "shaped"))
    named = found.join(shaped, line, "left").select(
        *KEYS,
        "at",
        F.coalesce("own_a", "made_a", "line_a").alias("form_a"),
        F.coalesce("own_b", "made_b", "line_b").alias("form_b"),
    )
    named = store.put(named, "named")
    per_form = named.select(*KEYS, "form_a", "form_b").distinct().groupBy("form_a", "form_b").count()
    recurring = per_form.where(F.col("count") >= min_docs).select("form_a", "form_b")
    recurring = broadcast_checked(store.put(recurring, "recurring"))
    gone = named.join(recurring, ["form_a", "form_b"]).groupBy(*KEYS).agg(F.collect_set("at").alias("gone"))
    return store.put(gone, "gone")


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_text``."""
    gone = dropped_lines(docs, Store(docs.sparkSession, "lines"), id_col, text_col, **options)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(F.col(id_col), F.col(text_col))
    )
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    joined = rows.join(gone, KEYS, "left").select("doc_id", lines.alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(left).alias("kept_text"),
    )
