"""The pipeline against plain versions of its stages, on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
from llm.helpers import ODD, docs_frame, sentence, words
from llm.test_decontaminate import plain as plain_matches
from llm.test_quality_rules import plain_counts
from llm.test_simhash_dedup import plain_components, plain_fingerprint
from penmark.llm import sharding, source_mix


def corpus():
    rng = random.Random(12)
    items = [(k, sentence(rng, 25)) for k in range(3)]
    rows = [(i, sentence(rng, rng.randrange(10, 90)), "en", rng.choice("abc")) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "a") for i in range(0, 40, 2)]
    rows += [(300 + i, f"{sentence(rng, 20)} {items[i % 3][1]} {sentence(rng, 20)}", "en", "b") for i in range(9)]
    rows += [(400 + i, "same words again " * 15, "de", "c") for i in range(4)]
    return [*rows, *((i, t, "en", None) for i, t in ODD)], items


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, items = corpus()
    docs = docs_frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(50)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == [*docs.columns, "slot", "shard"]

    good = [r for r in rows if not plain_counts(r[1])[-1]]
    root = plain_components([plain_fingerprint(r[1]) for r in good])
    first = {}
    for r in sorted(good, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(root[plain_fingerprint(r[1])], r)
    leaked = {i for i, _ in plain_matches([r[:2] for r in first.values()], items)}
    clean = [r for r in first.values() if r[0] not in leaked]

    taken = {r["doc_id"]: r["taken"] for r in source_mix.Mix(docs_frame(spark, clean)).taken().collect() if r["taken"]}
    got, texts = Counter(), {r[0]: r[1] for r in clean}
    for r in result.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert Counter(words(r["text"])) <= Counter(words(texts[r["doc_id"]]))
    assert dict(got) == taken
    table = sharding.fill_table(sharding.shard_names(sharding.SHARDS), sharding.next_prime(sharding.SLOTS_PER_SHARD * sharding.SHARDS))
    assert all(table[r["slot"]] == r["shard"] for r in result.collect())


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, items = corpus()
    docs_frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules",
        "simhash_near_dedup",
        "benchmark_decontamination",
        "source_mix",
        "sharding",
    ]
    docs = docs_frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
