"""Stem tables, constraint report, distinct partial summaries."""

from parley.operators import scores as S
from parley.operators.quality import check_constraints
from parley.streaming.annotate import ServiceEcho, annotate


def test_clipped_rouge_with_stems(spark):
    df = spark.createDataFrame([(1, "m", "cats run", "cat runs")], "dialogue_id long, model_id string, h string, r string")
    stems = spark.createDataFrame([("cats", "cat"), ("runs", "run")], "word string, stem string")
    key = ["dialogue_id", "model_id"]
    plain = S.rouge_clipped(df, key, "h", "r", (1,)).first().rouge1_clipped
    stemmed = S.rouge_clipped(df, key, "h", "r", (1, 2), stems=stems).first()
    assert plain == 0.0
    assert stemmed.rouge1_clipped == 1.0 and stemmed.rouge2_clipped == 1.0


def test_constraint_report(spark):
    d = spark.createDataFrame(
        [(1, "training", "t", "s", "positive"), (1, "training", "t", "s", None), (2, None, "t", "s", "maybe"),
         (3, "a-very-long-split", "t", None, "negative")],
        "dialogue_id long, dataset string, dialogue_text string, actual_summary string, actual_sentiment string")
    s = spark.createDataFrame([(1, "m1", "positive"), (9, "m1", "Sentiment: 1"), (2, "zz", "neutral")],
                              "dialogue_id long, model_id string, generated_sentiment string")
    m = spark.createDataFrame([("m1",), ("m1",)], "model_id string")
    got = {(r.table_name, r.check): r.n_violations for r in check_constraints(d, s, m).collect()}
    assert got[("dialogues", "not_null:dataset")] == 1
    assert got[("dialogues", "not_null:actual_summary")] == 1
    assert got[("dialogues", "max_length:dataset")] == 1
    assert got[("dialogues", "domain:actual_sentiment")] == 1
    assert got[("dialogues", "primary_key:dialogue_id")] == 1
    assert got[("sentiments", "max_length:generated_sentiment")] == 1
    assert got[("sentiments", "domain:generated_sentiment")] == 1
    assert got[("sentiments", "foreign_key:dialogue_id->dialogues")] == 1
    assert got[("sentiments", "foreign_key:model_id->models")] == 1
    assert got[("models", "primary_key:model_id")] == 1
    assert got[("dialogues", "not_null:dialogue_text")] == 0


def test_annotate_distinct_parts(spark):
    line = "same words here and there " * 30
    text = "\n".join([line.strip()] * 3)          # three equal chunks
    df = spark.createDataFrame([(1, text)], "dialogue_id long, dialogue_text string")
    full = annotate(df, ServiceEcho()).first()
    once = annotate(df, ServiceEcho(), distinct_parts=True).first()
    assert full.summary.count("\n") == 2 and "\n" not in once.summary
    assert full.sentiment in ("negative", "neutral", "positive")


def test_rows_are_not_lost(spark):
    """Pairs with one side, opposite vectors, repeated labels and models
    without a known label keep their rows."""
    from parley.operators import classification, scores
    from parley.sources import sinks
    tok = spark.createDataFrame([(1, "cand", 1, [1.0, 0.0]), (1, "ref", 2, [0.0, 1.0]), (2, "cand", 3, [1.0, 0.0])],
                                "pair_id long, side string, token_no long, vector array<double>")
    got = {r.pair_id: r for r in scores.bert_score(tok).collect()}
    assert got[1].bert_f1 == 0.0 and got[2].bert_f1 is None
    d = spark.createDataFrame([(1, "old"), (2, "old")], "dialogue_id long, actual_sentiment string")
    lab = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "dialogue_id long, actual_sentiment string, at int")
    assert sorted(tuple(r) for r in sinks.upsert_labels(d, lab, order="at").collect()) == [(1, "a"), (2, "old")]
    assert sorted(tuple(r) for r in sinks.upsert_labels(d, lab).collect()) == [(1, "b"), (2, "old")]
    p = spark.createDataFrame([("m", "odd"), ("n", "neutral")], "model_id string, generated_sentiment string")
    t = classification.label_counts_table(p).collect()
    assert len(t) == 6 and [r.total_classified for r in t if r.model_id == "m"] == [None] * 3
