import itertools
import random
import zlib

import numpy as np
from llm.helpers import ODD, docs_frame, sentence
from penmark.llm import quality_classifier as op


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 2, 4, 6])
    score, tie = rng.normal(size=lines.sum()) * 2, rng.normal(size=(2, 2))
    good, expected, log_sum = op.marginals(score, tie, lines, pairs=True)
    want, moves, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in lines:
        z, p, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(score[at + i] * y for i, y in enumerate(path)) + sum(tie[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += weight
            p += weight * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                pair[a, b] += weight
        want += list(p / z)
        moves += pair / z
        total += np.log(z)
        at += n
    assert np.allclose(good, want) and np.allclose(expected, moves) and np.isclose(log_sum, total)


def test_line_features():
    x, words, lines = op.line_features("Ab 12! ab ab\n\n#x É\nAb 12! ab ab".encode().split(b"#none#") + [b"", b"  \n "])
    assert lines.tolist() == [3, 1, 1] and words.tolist() == [4, 2, 4, 0, 0]
    f = dict(zip(op.LINE_FEATURES, x[0], strict=True))
    assert np.isclose(f["upper_share"], 1 / 9) and np.isclose(f["digit_share"], 2 / 9)
    assert f["bangs_per_word"] == 0.25 and f["sameness"] == 0.25 and f["seen_before"] == 0
    g = dict(zip(op.LINE_FEATURES, x[1], strict=True))
    assert np.isclose(g["symbol_share"], 1 / 3) and np.isclose(g["upper_share"], 1 / 3) and np.isclose(g["wide_share"], 1 / 3)
    assert x[2][op.LINE_FEATURES.index("seen_before")] == 1


def corpus(n=500):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        body = [sentence(rng, rng.randrange(5, 20)) for _ in range(rng.randrange(1, 8))]
        if bad:
            body = [line.upper() + "!!" if rng.random() < 0.8 else line for line in body]
        rows.append((i, "\n".join(body)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in op.score(docs_frame(spark, rows), frame(spark, labels)).collect()}
    held = [(got[i], q) for i, q in labels if got[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i, _ in labels)
    assert len(held) > 60
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_held_out_labels_and_row_order_do_not_matter(spark):
    rows, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a = {r["doc_id"]: r["score"] for r in op.score(docs_frame(spark, rows), frame(spark, labels)).collect()}
    other = docs_frame(spark, rows[::-1]).repartition(3)
    b = {r["doc_id"]: r["score"] for r in op.score(other, frame(spark, flipped)).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_odd_tables(spark):
    rows, labels = corpus(120)
    clash = docs_frame(spark, ODD + rows).selectExpr("*", "1 as raw", "2 as score", "3 as quality")
    got = op.score(clash, frame(spark, [*labels, (None, 1), (5, None), (3, 0)])).collect()
    assert len(got) == len(ODD) + len(rows)
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)
    none = op.score(docs_frame(spark, ODD), frame(spark, [])).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert op.score(docs_frame(spark, []), frame(spark, labels)).count() == 0


def test_sample_is_bounded_in_lines(spark):
    assert op.within([5, 100, 3, 2, 1], 10) == [True, False, True, True, False]
    rows, labels = corpus(200)
    rows, labels = [*rows, (9001, "Z Z! #$ 7\n" * 5000)], [*labels, (9001, 1)]
    assert zlib.crc32(b"9001") % 5 != 0
    docs = docs_frame(spark, rows)
    bounded = {r["doc_id"]: r["score"] for r in op.score(docs, frame(spark, labels), max_lines=4000).collect()}
    without = {r["doc_id"]: r["score"] for r in op.score(docs, frame(spark, labels[:-1]), max_lines=4000).collect()}
    assert bounded == without and bounded.keys() == {r[0] for r in rows}
    none = op.score(docs, frame(spark, labels), max_lines=0).collect()
    assert {r["score"] for r in none} == {0.5}


def test_equal_rows_train_once(spark):
    rows, labels = corpus(120)
    once = {r["doc_id"]: r["score"] for r in op.score(docs_frame(spark, rows), frame(spark, labels)).collect()}
    twice = op.score(docs_frame(spark, rows + rows[:30] * 5), frame(spark, labels)).collect()
    assert len(twice) == len(rows) + 150 and all(abs(r["score"] - once[r["doc_id"]]) < 1e-9 for r in twice)
