"""Row-local work on tokens runs in Arrow batches, not token by token in interpreted expressions."""

from collections import Counter

from pyspark.sql import functions as F

from penmark.functions import tagging as G
from penmark.functions import tokens as K
from penmark.functions.lexicon import FUNCTION_WORDS
from penmark.operators.features import annotate, linguistic_features
from penmark.operators.ngram_lm import _summed_answers
from penmark.operators.style import TRIGRAM_BUCKETS, style_vectors
from penmark.operators.tfidf import TfidfModel


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = [
    (1, "That cat said that Dogs ran, who knows? 12 % 3rd ½ _x İstanbul."),
    (2, ""),
    (None, "Hi! Hi!"),
    (None, None),
    (1, "été :-) 😀 although it SLOWLY walked."),
]


def test_annotation_by_hand_over_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    rows = annotate(docs).collect()
    first = [r for r in rows if r["doc_id"] == 1]
    dep = {(r["token"], r["tok_id"]): (r["pos"], r["dep"]) for r in first}
    assert dep["cat", 1] == ("NOUN", "noun") and dep["Dogs", 4] == ("PROPN", "propn")
    assert dep["who", 7][1] == "acl" and dep["12", 0] == ("NUM", "num") and dep["%", 1][0] == "PUNCT"
    assert dep["although", 5][1] == "advcl" and dep["SLOWLY", 7][0] == "PROPN" and dep["😀", 4][0] == "SYM"
    assert [r["token"] for r in rows if r["doc_id"] is None] == ["Hi", "!", "Hi", "!"]
    monkeypatch.setattr(G, "TOKENS", 1)
    assert annotate(docs).collect() == rows


def test_annotation_does_not_evaluate_rules_per_token(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for df in (annotate(docs), linguistic_features(docs)):
        plan = plan_of(df)
        assert "PROPN" not in plan and ("MapInArrow" in plan or "ArrowEvalPython" in plan)


def test_counts_follow_the_annotation(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    counts = [r["n"] for r in docs.select(G.annotation_counts(K.sentences(F.col("text"))).alias("n")).collect()]
    assert counts[3] is None and counts[1]["n"] == 0 and counts[1]["pos"] == [] and counts[2]["n"] == 4
    marks = [(r["value"], r["n"]) for r in counts[0]["punct"]]
    assert marks == sorted(marks) and dict(marks)["?"] == 1
    rows = annotate(docs.limit(1)).collect()
    assert {r["value"]: r["n"] for r in counts[0]["pos"]} == {
        p: sum(r["pos"] == p for r in rows) for p in {r["pos"] for r in rows}
    }
    assert counts[0]["clauses"] == sum(r["dep"] in G.CLAUSE_DEPS for r in rows)


def test_style_vector_counts_trigrams_and_words(spark):
    texts = ["The cat of the hat", "", "ab", None, "a😀bc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    df = style_vectors(rows)
    assert "regexp_extract_all(lower(text), (?s)(?=(...))" not in plan_of(df) and "ArrowEvalPython" in plan_of(df)
    got = [r["style"] for r in df.collect()]
    width = len(set(FUNCTION_WORDS))
    assert got[3] is None and set(got[1]) == set(got[2]) == {0.0} and len(got[1]) == width + TRIGRAM_BUCKETS
    words = Counter({"the": 2, "of": 1})
    low = texts[0].lower()
    grams = Counter((ord(a) * 961 + ord(b) * 31 + ord(c)) % TRIGRAM_BUCKETS for a, b, c in zip(low, low[1:], low[2:], strict=False))
    for counts, begin, names in ((words, 0, sorted(set(FUNCTION_WORDS))), (grams, width, range(TRIGRAM_BUCKETS))):
        length = sum(n * n for n in counts.values()) ** 0.5
        assert got[0][begin : begin + len(names)] == [counts[k] / length for k in names]
    # As before: a character outside the basic plane gives one more trigram.
    assert sum(x > 0 for x in got[4][width:]) == 3


def test_listed_terms_are_counted_without_making_other_ngrams(spark):
    texts = [(1, "New york new YORK city of ny"), (1, "city"), (2, ""), (3, None), (None, "york city hall york")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    terms = ["city", "new york", "new york city of", "york", "york city"]
    model = TfidfModel([(t, i, 9, 9, float(i + 2)) for i, t in enumerate(sorted(terms))], 5, (1, 4))
    df = model.transform_long(docs)
    assert "MapInArrow" in plan_of(df) and "array_compact" not in plan_of(df)
    counts = Counter()
    for key, text in texts:
        words = (text or "").lower().split()
        grams = [" ".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1)]
        counts.update((key, t) for t in grams if t in terms)
    x = {k: n * (sorted(terms).index(k[1]) + 2.0) for k, n in counts.items()}
    got = Counter()
    for r in df.collect():
        got[r["doc_id"], r["term"]] += r["tfidf"]
    # Rows with one key share their length, so "city" of the first key has two entries.
    squares = Counter({1: 2 * 2.0**2 + sum(v * v for (k, t), v in x.items() if k == 1 and t != "city")})
    squares[None] = sum(v * v for (k, _), v in x.items() if k is None)
    assert got.keys() == x.keys()
    assert all(abs(v - x[k] / squares[k[0]] ** 0.5) < 1e-12 for k, v in got.items())


def test_answered_bigrams_are_added_up_before_the_shuffle(spark):
    rows = [(i % 3 if i % 3 else None, n, -1.5 * n, 2.0 * n, i if i % 2 else None, 7) for i, n in enumerate([1, 2, 3, 4, 5, 6])]
    rows.append((9, None, None, None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, n int, np double, nh double, u long, v long").coalesce(1)
    out = _summed_answers(df).collect()
    sums = {r["doc_id"]: (r["n"], r["np"], r["nh"]) for r in out if r["u"] is None}
    assert sums == {None: (5, -7.5, 10.0), 1: (7, -10.5, 14.0), 2: (9, -13.5, 18.0), 9: (None, None, None)}
    asked = sorted((r["u"], r["v"], r["w"]) for r in out if r["u"] is not None)
    assert asked == [(1, 7, 2), (3, 7, 4), (5, 7, 6)] and len(out) == 7
