import itertools
import random

import numpy as np
import pytest
from llm.helpers import sentence
from penmark.llm import chat_format as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def corpus(n=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * rng.randrange(1, 4)
        for t, role in enumerate(roles):
            text = sentence(rng, rng.randrange(40, 150) if role == "assistant" else rng.randrange(3, 30))
            rows.append((c, t, role, text.replace(" ", "\n", 2) if rng.random() < 0.3 else text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_decode_is_the_best_path():
    rng = np.random.default_rng(0)
    tables = op.Tables({"user": 5, "system": 2}, {("user", "assistant"): 9, ("assistant", "user"): 9}, {})
    tables.emit = [np.log(rng.dirichlet(np.ones(size), 3)) for size in op.FEATURES.values()]
    texts = ["a b\nc?", "x " * 60, "User: hi\nthere", "d"]
    rows = [op.observe(t) for t in texts]
    score, opens = tables.scores(rows)

    def value(path):
        v = tables.start[path[0]] + score[0, path[0]]
        for i in range(1, len(path)):
            v += (tables.move if opens[i] else tables.inside)[path[i - 1], path[i]] + score[i, path[i]]
        return v

    best = max(itertools.product(range(3), repeat=len(score)), key=value)
    assert np.isclose(value(tables.decode(rows, None, None)), value(best))


def test_segments_do_not_change_the_path(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", sentence(rng, rng.choice([5, 9, 60]))) for t in range(90)]
    rows += [(2, 7, "user", "\n".join(sentence(rng, rng.randrange(1, 90)) for _ in range(3))) for _ in range(60)] + corpus(30)[40:]
    tables = op.learn(op.segmented(frame(spark, rows)))
    monkeypatch.setattr(op, "learn", lambda _: tables)
    whole = sorted(map(tuple, op.format_chats(frame(spark, rows)).collect()), key=str)
    monkeypatch.setattr(op, "SEGMENT", 8)
    monkeypatch.setattr(op, "MAX_ROWS", 6)
    cut = op.format_chats(frame(spark, rows))
    pieces = op.segmented(frame(spark, rows)).groupBy(*op.PIECE).count().collect()
    assert len(pieces) > 20
    assert sorted(map(tuple, cut.collect()), key=str) == whole


def test_held_out_roles_are_recovered(spark):
    rows = corpus(300)
    got = op.format_chats(frame(spark, rows)).withColumn("held", op.held_out(op.F.col("conv_id"))).collect()
    given = {(c, t): r for c, t, r, _ in rows}
    held = [r for r in got if r["held"]]
    assert len(got) == len(rows) and len(held) > 100
    assert sum(given[r["conv_id"], r["turn"]] == r["role"] for r in held) / len(held) > 0.97


def test_markers_split_rows_and_are_removed(spark):
    text = "User: what is this?\nmore\nAssistant: it is that\nUSER: thanks"
    rows = corpus(60) + [(900, 0, None, text), (901, 0, "odd", "<|system|>be brief\n### Human: go")]
    got = {r["conv_id"]: r for r in op.format_chats(frame(spark, rows)).collect() if r["conv_id"] >= 900}
    assert got[900]["n_parts"] == 3 and got[900]["role"] == "user"
    assert got[900]["rendered"] == (
        "<|im_start|>user\nwhat is this?\nmore<|im_end|>\n<|im_start|>assistant\nit is that<|im_end|>\n<|im_start|>user\nthanks<|im_end|>\n"
    )
    assert got[901]["rendered"].startswith("<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\ngo<|im_end|>")


@pytest.mark.parametrize("training", [True, False])
def test_odd_rows(spark, training):
    odd = [(None, 0, "user", "x y"), (None, None, None, None), (1000, None, "user", ""), (1000, 0, None, None)]
    odd += [(1001, 3, "USER ", "same"), (1001, 3, "USER ", "same"), (1002, 0, "user", "word\n" * 5000)]
    rows = odd + (corpus(40) if training else [])
    df = frame(spark, rows).selectExpr("*", "1 as conv", "2 as tie", "3 as seg_a", "4 as given")
    got = op.format_chats(df).collect()
    assert len(got) == len(rows) and all(r["role"] in op.ROLES and r["rendered"].startswith("<|im_start|>") for r in got)
    assert op.format_chats(frame(spark, [])).count() == 0
