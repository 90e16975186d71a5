import random
from collections import Counter

from llm.helpers import ODD, docs_frame, sentence, words
from penmark.llm import decontaminate as op


def bag(tokens):
    return Counter(tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4))


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def plain(rows, items, threshold=0.8):
    """Best similarity over all windows of the item's size, at least the threshold."""
    out = {}
    for i, text in rows:
        tokens = words((text or "").lower())
        for item, passage in items:
            want = words((passage or "").lower())
            n = len(want)
            if n < 5 or len(tokens) < 5:
                continue
            best = max(similarity(bag(tokens[s : s + n]), bag(want)) for s in range(max(1, len(tokens) - n + 1)))
            if best >= threshold:
                out[i, item] = round(best, 9)
    return out


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def cases():
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randrange(5, 60))) for k in range(12)] + [(12, None), (13, ""), (14, "too short here")]
    items += [(15, "la la la la la la la la la la la la"), (16, items[0][1])]
    rows = list(ODD)
    for i in range(120):
        passage = words(items[i % 12][1])
        for _ in range(i % 4):
            passage[rng.randrange(len(passage))] = f"x{i}"
        if i % 7 == 0:
            passage = passage[: max(5, int(len(passage) * 0.9))]
        lead, rest = sentence(rng, rng.randrange(30)), sentence(rng, rng.randrange(30))
        rows.append((100 + i, f"{lead} {' '.join(passage).upper() if i % 5 == 0 else ' '.join(passage)} {rest}"))
    rows += [(300, "x la " + "la " * 30 + "y"), (301, items[3][1] + " " + items[4][1]), (302, sentence(rng, 90))]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = cases()
    got = op.matches(docs_frame(spark, rows), items_frame(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == plain(rows, items)
    by_id = dict(rows)
    for r in got:
        want = words(dict(items)[r["item_id"]].lower())
        window = words(by_id[r["doc_id"]].lower())[r["start"] : r["start"] + len(want)]
        assert round(similarity(bag(window), bag(want)), 9) == round(r["similarity"], 9)


def test_blocks_meet_all_pairs_within_the_radius():
    rng = random.Random(1)
    masks = [m & (1 << 64) - 1 for m in op.block_masks(op.RADIUS)]
    assert sum(masks) == (1 << 64) - 1 and len(masks) == op.RADIUS + 1
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), op.RADIUS):
            y ^= 1 << bit
        assert any((x ^ y) & m == 0 for m in masks)


def test_clean_documents_stay(spark):
    rows, items = cases()
    df = docs_frame(spark, rows).selectExpr("*", "1 as sh", "2 as m", "3 as item_id")
    kept = op.keep_clean(df, items_frame(spark, items))
    assert kept.columns == df.columns
    gone = {i for i, _ in plain(rows, items)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in gone), key=str)


def test_empty_tables_and_plan(spark):
    rows, items = cases()
    assert op.matches(docs_frame(spark, []), items_frame(spark, items)).count() == 0
    assert op.matches(docs_frame(spark, rows), items_frame(spark, [])).count() == 0
    twice = [(1, items[0][1]), (1, items[0][1]), (None, items[0][1])]
    found = op.matches(docs_frame(spark, twice), items_frame(spark, items[:1]))
    assert sorted((r["doc_id"] for r in found.collect()), key=str) == [1, None]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
