import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
from llm.helpers import ODD, WORD, docs_frame, sentence, words
from penmark.llm import quality_rules as op
from penmark.llm.common import Store
from penmark.llm.sql import quality_rules_sql
from pyspark.sql import functions as F


def plain_counts(text):
    tokens, text = words(text), text or ""
    windows = Counter(tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7))
    covered = set()
    for i in range(len(tokens) - 7):
        if windows[tuple(tokens[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(tokens)
    failed = n < 20 or 100 * len(covered) > 30 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, tokens)), symbols, len(lines) - len(set(lines)), len(covered), failed


def tail(k, n, p):
    return float(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))


def corpus(n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(w + "!!" if bad else w for w in sentence(rng, 40).split())
        rows.append((i, text, "en" if i % 3 else None))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def labels_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_counts_equal_plain_version(spark):
    rng = random.Random(1)
    phrase = sentence(rng, 12)
    rows = [*ODD, (20, f"{phrase} # {phrase}\n{phrase}\n|\n\n{phrase}"), (21, "a b " * 40), (22, "Ää é\x0b\x0c x\r\n a*b")]
    got = op.features(docs_frame(spark, rows)).select("doc_id", *op.COUNTS, "base_failed").collect()
    want = [(i, *plain_counts(t)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_binomial_tail(spark):
    cases = [(0, 100), (1, 300), (3, 900), (20, 3000), (29, 3000), (70, 8000), (5, 100), (0, 0)]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    for r in df.withColumn("p", op.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        want = tail(r["k"], r["n"], 0.01) if r["k"] < 0.01 * r["n"] else 1.0
        assert math.isclose(r["p"], want, rel_tol=1e-9)


def choosing(i):
    return hashlib.md5(f"{op.HALF_KEY}{i}".encode()).hexdigest()[0] < "8"


def test_certified_cutoffs_reject_bad_and_bound_good(spark):
    rows, labels = corpus()
    got = op.quality_verdicts(docs_frame(spark, rows), labels_frame(spark, labels)).select("doc_id", "kept").collect()
    assert {r["doc_id"]: int(r["kept"]) for r in got} == dict(labels)
    stored = Store(spark, "rules").put(op.features(docs_frame(spark, rows)), "features")
    found = {(r["stratum"], r["rule"]): r["cutoff"] for r in op.cutoffs(stored, labels_frame(spark, labels)).collect()}
    assert found == {("=en", "bang_share"): 1.5, ("", "bang_share"): 1.5}


def test_few_labels_certify_nothing(spark):
    rows, labels = corpus(150)
    got = op.quality_verdicts(docs_frame(spark, rows), labels_frame(spark, labels)).select("kept").collect()
    assert all(r["kept"] for r in got)


def test_cutoff_needs_the_exact_bound(spark):
    """The held-out good documents allow a cutoff exactly where the binomial tail does."""
    held = [i for i in range(400) if not choosing(i)]
    n, delta = len(held), 0.1
    allowed = max(k for k in range(n) if tail(k, n, op.RISK) <= delta)
    for k in (allowed, allowed + 1):
        loud = {*held[:k], *range(400, 460)}
        rows = [(i, sentence(random.Random(i), 25) + (" ! ! ! ! ! ! ! ! !" if i in loud else "")) for i in range(460)]
        labels = [(i, int(i < 400)) for i in range(460)]
        stored = Store(spark, "rules").put(op.features(docs_frame(spark, rows)), "features")
        found = op.cutoffs(stored, labels_frame(spark, labels), op.RISK, delta).collect()
        assert {r["rule"] for r in found} >= {"bang_share"} if k == allowed else not found


def test_joint_rejection_stops_the_sequence(spark):
    """Each rule alone stays within the risk, both together do not: only the more gainful one is certified."""
    held = [i for i in range(400) if not choosing(i)]
    n = len(held)
    k = max(k for k in range(n) if tail(k, n, op.RISK) <= 0.1)
    loud, marked = {*held[:k], *range(400, 480)}, {*held[k : 2 * k], *range(480, 540)}
    body = lambda i: "".join(f"w{i}x{j} " for j in range(25))
    rows = [(i, body(i) + "!" * 30 * (i in loud) + "#" * 60 * (i in marked)) for i in range(540)]
    labels = [(i, int(i < 400)) for i in range(540)]
    stored = Store(spark, "rules").put(op.features(docs_frame(spark, rows)), "features")
    assert [r["rule"] for r in op.cutoffs(stored, labels_frame(spark, labels)).collect()] == ["bang_share"]


def test_labels_beyond_one_are_bad(spark):
    rows, labels = corpus()
    odd = [(i, q if q else 2) for i, q in labels]
    got = op.quality_verdicts(docs_frame(spark, rows), labels_frame(spark, odd)).select("doc_id", "kept").collect()
    assert {r["doc_id"]: int(r["kept"]) for r in got} == dict(labels)


def test_equals_sql_with_certified_cutoffs(spark):
    """The check SQL on a table whose strata are certified."""
    rows, labels = corpus()
    con = duckdb.connect()
    docs, marks = docs_frame(spark, rows), labels_frame(spark, labels)
    for name, frame in (("documents", docs), ("labels", marks)):
        con.register(name, frame.toPandas().convert_dtypes())
    want = {tuple(r) for r in con.sql(f"SELECT doc_id, kept FROM ({quality_rules_sql()})").fetchall()}
    got = {tuple(r) for r in op.quality_verdicts(docs, marks).select("doc_id", "kept").collect()}
    assert got == want and len({k for _, k in got}) == 2


def test_odd_tables(spark):
    none = labels_frame(spark, [])
    got = op.quality_verdicts(docs_frame(spark, ODD), labels_frame(spark, [(1, None), (4, 1), (4, 0), (None, 1)]))
    assert got.count() == len(ODD)
    assert op.quality_verdicts(docs_frame(spark, []), none).count() == 0
    clash = docs_frame(spark, ODD).selectExpr("*", "1 as kept", "2 as stratum", "3 as n_words", "4 as w", "5 as key_a")
    kept = op.keep_good(clash, none)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == []
    long_rows = [(1, sentence(random.Random(0), 30)), (1, sentence(random.Random(0), 30)), (None, sentence(random.Random(1), 30))]
    assert op.keep_good(docs_frame(spark, long_rows), none).count() == 3
