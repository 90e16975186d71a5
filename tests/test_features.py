"""Hand-worked values and edge rows of the text features."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penmark.functions import connectors as C
from penmark.functions import lexical as L
from penmark.functions import tokens as K
from penmark.functions.arrays import count_runs, ngrams
from penmark.operators.features import annotate, annotation_features, linguistic_features
from penmark.operators.joins import connector_table, unusual_words

EDGES = [
    (0, None),
    (1, ""),
    (2, "..."),
    (3, "word"),
    (4, "été çà x1_a"),
    (5, "Hi there. Yes!! No?"),
    (6, "Hi there. Yes!! No?"),
    (7, "The black cat runs fast."),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string")


@pytest.fixture(scope="module")
def record(edges):
    return {r["doc_id"]: r.asDict(True) for r in linguistic_features(edges).collect()}


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_null_text_keeps_its_row(record):
    assert record[0]["flesch"] is None and record[0]["num_tokens"] is None


def test_empty_and_marks_only(record):
    assert record[1]["num_sentences"] == 0 and record[1]["lexical_richness"] == 0.0
    assert record[1]["flesch"] is None and record[2]["flesch"] is None
    assert record[2]["sentence_lengths"] == [3] and record[2]["pos_shares"] == {}


def test_sentences_and_duplicates(record):
    assert record[5]["num_sentences"] == 3 and record[5]["sentence_lengths"] == [3, 3, 2]
    assert {k: v for k, v in record[5].items() if k != "doc_id"} == {k: v for k, v in record[6].items() if k != "doc_id"}


def test_worked_pos_example(record):
    shares = record[7]["pos_shares"]
    assert shares["prop_DET"] == shares["prop_VERB"] == shares["prop_ADV"] == pytest.approx(0.2)
    assert "prop_ADJ" not in shares  # absent tag has no key, not 0


def test_letter_tokens(spark):
    assert value(spark, K.alpha(F.col("text")), "été çà x1_a Don't") == ["été", "çà", "don", "t"]


def test_entropy_and_bounds(spark):
    assert value(spark, L.lexical_entropy(K.words(F.col("text"))), "a a b b") == 1.0
    assert value(spark, L.lexical_entropy(K.words(F.col("text"))), "a b c d e") == round(math.log2(5), 2)


def test_count_runs_matches_counter(spark):
    words = "b a c a b a é é z".split()
    runs = value(spark, count_runs(K.words(F.col("text"))), " ".join(words))
    assert {r["value"]: r["n"] for r in runs} == Counter(words)


def test_ngrams_of_short_texts(spark):
    assert value(spark, ngrams(K.words(F.col("text")), 3), "a b") == []
    assert value(spark, ngrams(K.words(F.col("text")), 2), "a b c") == ["a b", "b c"]


def syllables(word):
    import re

    return max(1, len(re.findall("[aeiouy]+", word)) - bool(re.search("[^aeiouyl]e$", word)))


def test_syllables_match_word_by_word(spark):
    text = "The queue made table rhythm be e hmm, cake. Idea! apple's -e x3e"
    assert value(spark, L.syllables(F.col("text")), text) == sum(syllables(w) for w in text.lower().split())


def test_flesch(spark):
    # 2 sentences, 5 words, 5 syllables
    want = round(206.835 - 1.015 * 2.5 - 84.6 * 1.0, 2)
    assert value(spark, L.flesch(F.col("text")), "The cat sat. Dogs ran.") == pytest.approx(want)


def test_connector_substrings(spark):
    df = spark.createDataFrame([(1, "Some so-so soap; IN addition")], "doc_id long, text string")
    rows = connector_table(df, ["so", "and", "as", "If", "in addition", "", "so"]).collect()
    assert {r["phrase"]: r["n"] for r in rows} == {"so": 4, "and": 0, "as": 0, "If": 0, "in addition": 1}


def test_overlapping_phrase_is_counted_without_overlap(spark):
    assert value(spark, C.phrase_count(F.col("text"), "aa"), "aaaaa") == "aaaaa".count("aa")


def test_word_list_keeps_case(spark):
    df = spark.createDataFrame([(1, "the cat Monday cat,"), (2, "")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("the",), ("cat",), ("Monday",)], "w string")
    got = {r["doc_id"]: r["unusual_word_ratio"] for r in unusual_words(df, lexicon).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_word_list_above_broadcast_limit(spark, edges):
    lexicon = spark.createDataFrame([("hi",), ("word",)], "w string")
    small = unusual_words(edges, lexicon).orderBy("doc_id").collect()
    assert small == unusual_words(edges, lexicon, max_broadcast=1).orderBy("doc_id").collect()


def test_long_document(spark):
    text = "alpha beta gamma delta. " * 5000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = linguistic_features(df).first()
    assert r["num_sentences"] == 5000 and r["lexical_entropy"] == pytest.approx(2.58, abs=0.6)


def test_token_table_gives_the_same_features(spark, edges):
    direct = {r["doc_id"]: r for r in linguistic_features(edges).collect()}
    for r in annotation_features(annotate(edges)).collect():
        want = direct[r["doc_id"]]
        for name in ("stopword_ratio", "syntactic_complexity", "dep_repetition", "pos_shares", "punct_shares"):
            assert r[name] == want[name], name


def test_external_tagger(spark, edges):
    def tagger(batches):
        for b in batches:
            b = b.dropna()
            yield b.assign(
                sent_id=0, tok_id=0, token=b["text"], pos="X", dep="root", is_alpha=True, is_stop=False, is_punct=False
            ).drop(columns="text")

    assert annotate(edges, tagger=tagger).where("pos = 'X'").count() == 7


def test_stream_equals_batch(spark, edges, tmp_path):
    from penmark.streaming.features import write_feature_stream

    edges.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in"))
    q = write_feature_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "lexical_entropy").orderBy("doc_id").collect()
    want = linguistic_features(edges).select("doc_id", "lexical_entropy").orderBy("doc_id").collect()
    assert got == want


def test_readability_counts_match_patterns(spark, monkeypatch):
    """Odd white space, marks, silent and only vowels, against the patterns that define the counts."""
    import random
    import re

    import pyarrow as pa

    space = "\t-\r\x1c-\x20" + "".join(w.decode() for w in L.WIDE_SPACES)
    end = rf"(?![^{space}])"

    def counts(t):
        groups, silent = len(re.findall("[aeiouy]+", t)), len(re.findall(rf"[^aeiouyl{space}]e{end}", t))
        bare = len(re.findall(rf"(?<![^{space}])(?:[^aeiouy{space}]*[^aeiouyl{space}]e|[^aeiouy{space}]+){end}", t))
        pieces, words = len(re.findall(rf"[^.!?{space}][^.!?]*", t)), len(re.findall(rf"[^.!?{space}]+", t))
        return {"sentences": pieces, "words": words, "syllables": groups - silent + bare}

    draw = random.Random(4)
    some = "aeiouyl e e bcd.!? \n\t  　\u0085  \x1cé€\U0001f600-,"
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 30))) for _ in range(3000)] + [None, "", None]
    monkeypatch.setattr(L, "BYTES", 500)
    want = [None if t is None else counts(t) for t in texts]
    assert L._readable(pa.array(texts)).to_pylist() == want
    assert L._readable(pa.array(texts).slice(7, 90)).to_pylist() == want[7:97]
    assert value(spark, L.readability_counts(F.col("text")), "A Cake be. No!").asDict() == {"sentences": 2, "words": 4, "syllables": 4}


def test_token_streams_are_not_queued_beside_arrow_batches(edges):
    """only the text stands beside what Python counts."""
    plan = linguistic_features(edges)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("ArrowEvalPython") :]
    assert "strip" not in below and "translate" not in below
