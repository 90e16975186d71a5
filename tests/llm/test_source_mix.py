import random

import numpy as np
import pytest
from llm.helpers import ODD, docs_frame, sentence, words
from penmark.llm import source_mix as op


def plain_targets(sizes, weights, cap=3):
    """Water level by bisection: target = min(cap * size, level * weight)."""
    total, low, high = sum(sizes), 0.0, 10.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap * s, level * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 5, 5, 1, 40], [7], [0, 3, 90], [100, 1, 1, 1, 1, 1]])
def test_targets(sizes):
    weights = [1.0, 2.0, 3.0, 1.0, 2.0, 3.0][: len(sizes)]
    got = op.targets(sizes, weights)
    assert np.allclose(got, plain_targets(sizes, weights))
    assert abs(sum(got) - sum(sizes)) < 1e-6


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 64, 65, 1000):
        image = op.permute(np.arange(size), np.full(size, size), np.full(size, 99, np.uint64))
        assert sorted(image.tolist()) == list(range(size))
    a = op.permute(np.arange(500), np.full(500, 500), np.full(500, 1, np.uint64))
    b = op.permute(np.arange(500), np.full(500, 500), np.full(500, 2, np.uint64))
    assert (a != b).mean() > 0.9


def test_shard_counts_add_up_and_stay_within_quota():
    quota = [500, 20, 0, 3]
    counts = op.shard_counts(quota, 50, 1)
    assert counts.sum(axis=0).tolist() == quota
    assert counts.sum(axis=1).tolist() == [50] * 10 + [23]
    assert (counts == op.shard_counts(quota, 50, 1)).all()


def corpus(n=300):
    rng = random.Random(2)
    return [(i, sentence(rng, rng.randrange(1, 200)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def test_taken_words_follow_targets(spark):
    rows = corpus()
    mix = op.Mix(docs_frame(spark, rows), block_words=16, shard_blocks=64)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, op.targets([sizes[s] for s in order], [1.0, 2.0, 3.0, 1.0]), strict=True))
    taken = dict.fromkeys(order, 0)
    by_id = {r[0]: r for r in rows}
    for r in got:
        source = by_id[r["doc_id"]][3]
        taken[source] += r["taken"]
        assert (r["size"], r["source_size"]) == (len(words(by_id[r["doc_id"]][1])), sizes[source])
        assert abs(r["target"] - goal[source]) < 1e-6 and r["taken"] <= 3 * r["size"]
    for source in order:
        assert abs(taken[source] - goal[source]) <= 32
    again = op.Mix(docs_frame(spark, rows).repartition(5), block_words=16, shard_blocks=64).taken().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_slots_draw_each_block_once_per_pass(spark):
    mix = op.Mix(docs_frame(spark, corpus()), block_words=16, shard_blocks=64)
    drawn = [(r["no"], r["pass"], r["block"]) for r in mix.slots.collect()]
    assert len(drawn) == len(set(drawn)) == sum(p["quota"] for p in mix.plan)
    per_shard = [r["count"] for r in mix.slots.groupBy("shard").count().orderBy("shard").collect()]
    assert all(n == 64 for n in per_shard[:-1]) and 0 < per_shard[-1] <= 64
    blocks = {p["no"]: p["blocks"] for p in mix.plan}
    assert all(0 <= b < blocks[no] for no, _, b in drawn)
    covered = {}
    for r in mix.pieces.collect():
        covered[r["no"], r["block"]] = covered.get((r["no"], r["block"]), 0) + r["len"]
    assert all(n == 16 or b == blocks[no] - 1 for (no, b), n in covered.items())


def test_mixed_documents_hold_the_taken_words(spark):
    rows = corpus(120)
    df = docs_frame(spark, rows).selectExpr("*", "7 as `pass`", "8 as spans", "9 as row")
    options = {"block_words": 16, "shard_blocks": 64}
    mixed = op.mixed_documents(df, **options)
    assert mixed.columns == df.columns
    total = {}
    for r in mixed.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["row"] == 9
    taken = {r["doc_id"]: r["taken"] for r in op.Mix(df, **options).taken().collect() if r["taken"]}
    assert total == taken


def test_odd_tables(spark):
    got = op.Mix(docs_frame(spark, ODD)).taken().collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert op.Mix(docs_frame(spark, [])).taken().count() == 0
    assert op.mixed_documents(docs_frame(spark, [])).count() == 0
    assert op.mixed_documents(docs_frame(spark, [(1, None), (2, "")])).count() == 0


def test_equal_rows_are_separate_parts_of_the_stream(spark):
    rows = [(1, "one two three", "en", "a")] * 400 + [(i, f"x{i} y", "en", "a") for i in range(2, 60)]
    mix = op.Mix(docs_frame(spark, rows).repartition(7), block_words=16, shard_blocks=8)
    pieces = sorted((r["block"], r["len"]) for r in mix.pieces.collect())
    total = sum(len(words(r[1])) for r in rows)
    filled = {}
    for block, n in pieces:
        filled[block] = filled.get(block, 0) + n
    assert filled == {b: min(16, total - 16 * b) for b in range(-(-total // 16))}
    again = op.Mix(docs_frame(spark, rows[::-1]).repartition(3), block_words=16, shard_blocks=8)
    assert sorted(map(tuple, mix.taken().collect())) == sorted(map(tuple, again.taken().collect()))


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(op, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="more than 3 sources"):
        op.Mix(docs_frame(spark, [(i, "a b", "en", f"s{i}") for i in range(4)]))
