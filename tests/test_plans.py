"""Shapes of the physical plans that matter at scale."""

import pytest

from penmark.operators.features import linguistic_features
from penmark.operators.joins import connector_table, pair_predictions, unusual_words
from penmark.operators.reshape import split_columns
from penmark.operators.sampling import with_split
from penmark.operators.tfidf import fit_tfidf
from penmark.operators.zeroshot import zero_shot_predict


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "docs")
    rows = [(i, f"the cat number {i} sat on the mat", i % 2, "x") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, label int, extra string").write.parquet(path)
    return spark.read.parquet(path)


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_features_do_not_shuffle_and_read_two_columns(docs, capsys):
    text = plan(linguistic_features(docs), capsys)
    assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_connectors_are_no_join(docs, capsys):
    text = plan(connector_table(docs, ["so", "and"]), capsys)
    assert "Join" not in text and "Exchange" not in text


def test_tfidf_transform_does_not_shuffle(docs, capsys):
    assert "Exchange" not in plan(fit_tfidf(docs, max_features=20).transform(docs), capsys)


def test_word_list_is_broadcast_and_only_counts_move(spark, docs, capsys):
    lexicon = spark.createDataFrame([("the",)], "w string")
    text = plan(unusual_words(docs, lexicon), capsys)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_split_moves_no_rows(docs, capsys):
    text = plan(with_split(docs), capsys)
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_metadata_split_prunes_the_text(docs, capsys):
    meta, _ = split_columns(docs, ["doc_id", "label"])
    assert "ReadSchema: struct<doc_id:bigint,label:int>" in plan(meta, capsys)


def test_filter_reaches_the_scan(docs, capsys):
    text = plan(docs.where("label = 1").select("doc_id"), capsys)
    assert "EqualTo(label,1)" in text


def test_pairs_shuffle_once(docs, capsys):
    preds = docs.selectExpr("doc_id", "extra AS model", "CAST(label AS DOUBLE) AS score")
    text = plan(pair_predictions(preds, ["x", "y", "z"]), capsys)
    assert "Join" not in text and "rangepartitioning" not in text


def test_verdicts_are_row_local(docs, capsys):
    scored = docs.selectExpr("doc_id", "CAST(label AS DOUBLE) AS score")
    assert "Exchange" not in plan(zero_shot_predict(scored, 0.5), capsys)
