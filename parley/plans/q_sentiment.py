"""Queries: sentiment parsing, alignment and classification metrics
(I-7, B-11, D-1, E-10..E-13, E-17, E-18, F-4..F-6, F-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.parse import code_to_label, extract_sentiment, sentiment_code
from parley.operators import classification as C
from parley.plans import oracle_metrics  # noqa: F401  (registers CTEs)
from parley.plans.oracle_views import with_views
from parley.plans.registry import query
from parley.sources import fixtures as X


def r6(c):
    return F.round(c, 6)


def _metrics(spark, sf):
    return C.sentiment_metrics(X.dialogues(spark, sf), X.sentiments(spark, sf))


@query("e11_sentiment_metrics", with_views("""
SELECT model_id, n, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1,
       round(macro_f1, 6) AS macro_f1
FROM model_metrics ORDER BY weighted_f1 DESC, model_id""", "model_metrics"))
def q_sentiment_metrics(spark, sf):
    """Flagship: accuracy, weighted and macro F1 of every model, one plan."""
    m = _metrics(spark, sf)
    return m.select("model_id", "n", r6("accuracy").alias("accuracy"),
                    r6("weighted_f1").alias("weighted_f1"), r6("macro_f1").alias("macro_f1")
                    ).orderBy(F.desc("weighted_f1"), "model_id")


@query("e10_accuracy", with_views("""
SELECT model_id, round(accuracy, 6) AS accuracy FROM model_metrics""", "model_metrics"))
def q_accuracy(spark, sf):
    return _metrics(spark, sf).select("model_id", r6("accuracy").alias("accuracy"))


@query("e12_confusion_matrix", with_views(
    "SELECT model_id, actual, predicted, n FROM cells", "cells"))
def q_confusion(spark, sf):
    return C.confusion_cells(C.align(X.dialogues(spark, sf), X.sentiments(spark, sf)))


@query("e13_class_metrics", with_views("""
SELECT model_id, label, tp, support, predicted, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM class_stats""", "class_stats"))
def q_class_metrics(spark, sf):
    cs = C.class_stats(C.confusion_cells(C.align(X.dialogues(spark, sf), X.sentiments(spark, sf))))
    return cs.select("model_id", "label", "tp", "support", "predicted",
                     r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1").alias("f1"))


@query("d1_truth_prediction_join", with_views(
    "SELECT dialogue_id, model_id, actual, predicted FROM aligned", "aligned"))
def q_align(spark, sf):
    return C.align(X.dialogues(spark, sf), X.sentiments(spark, sf))


@query("i7_extract_sentiment", with_views("""
SELECT dialogue_id, model_id, generated_sentiment FROM sentiments""", "sentiments"))
def q_extract_sentiment(spark, sf):
    """v1 parser over every raw output (whole echoed dialogue + answer)."""
    r = X.raw_outputs(spark, sf)
    return r.select("dialogue_id", "model_id",
                    extract_sentiment("raw_output", "v1").alias("generated_sentiment"))


_V2_CODE = r"CASE WHEN regexp_extract(raw_output, 'Sentiment: (-?\d)', 1) = '' THEN 0 ELSE CAST(regexp_extract(raw_output, 'Sentiment: (-?\d)', 1) AS INTEGER) END"


@query("b11_code_label_map", with_views(f"""
SELECT dialogue_id, model_id, CAST({_V2_CODE} AS BIGINT) AS code,
       CASE {_V2_CODE} WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' END AS label,
       ({_V2_CODE}) NOT IN (-1, 0, 1) AS parse_error
FROM raw_outputs""", "raw_outputs"))
def q_code_label(spark, sf):
    """Variant v2 (case-sensitive digit) with the code->label map; a code
    outside -1..1 is flagged instead of failing the job."""
    r = X.raw_outputs(spark, sf)
    code = sentiment_code("raw_output")
    return r.select("dialogue_id", "model_id", code.cast("long").alias("code"),
                    code_to_label(code).alias("label"),
                    (~code.isin(-1, 0, 1)).alias("parse_error"))


@query("i7_extract_sentiment_sentinel", with_views("""
SELECT dialogue_id, model_id,
       trim(string_split(replace(raw_output, chr(10) || chr(10), '$#$#$#'), '$#$#$#')[-1],
            ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS last_segment
FROM raw_outputs""", "raw_outputs"))
def q_extract_sentinel(spark, sf):
    """Variant v3: answer after the last ``$#$#$#`` sentinel. The stand-in
    output marks the prompt end with the sentinel instead of a blank line."""
    r = X.raw_outputs(spark, sf).select(
        "dialogue_id", "model_id",
        F.replace(F.col("raw_output"), F.lit("\n\n"), F.lit("$#$#$#")).alias("raw_output"))
    return r.select("dialogue_id", "model_id",
                    extract_sentiment("raw_output", "v3").alias("last_segment"))


@query("e17_sentiment_count_table", with_views("""
SELECT g.sentiment, g.model_id, CAST(c.n AS BIGINT) AS total_classified
FROM (SELECT m.model_id, l.sentiment FROM (SELECT DISTINCT model_id FROM sentiments) m
      CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) l(sentiment)) g
LEFT JOIN (SELECT model_id, generated_sentiment AS sentiment, count(*) AS n FROM sentiments GROUP BY ALL) c
  ON g.model_id = c.model_id AND g.sentiment = c.sentiment""", "sentiments"))
def q_count_table(spark, sf):
    return C.label_counts_table(X.sentiments(spark, sf))


@query("f4_grouped_bar_table", with_views("""
SELECT g.model_id AS models, g.sentiment, CAST(c.n AS BIGINT) AS total_classified
FROM (SELECT m.model_id, l.sentiment FROM (SELECT DISTINCT model_id FROM sentiments) m
      CROSS JOIN (VALUES ('negative'), ('neutral'), ('positive')) l(sentiment)) g
LEFT JOIN (SELECT model_id, generated_sentiment AS sentiment, count(*) AS n FROM sentiments GROUP BY ALL) c
  ON g.model_id = c.model_id AND g.sentiment = c.sentiment
ORDER BY models, sentiment, total_classified""", "sentiments"))
def q_bar_table(spark, sf):
    """Grouped-bar input: one sort on the full key (model, label, count)."""
    t = C.label_counts_table(X.sentiments(spark, sf))
    return (t.select(F.col("model_id").alias("models"), "sentiment", "total_classified")
             .orderBy("models", "sentiment", "total_classified"))


@query("e18_metric_table", with_views("""
SELECT model_id, metric, CAST(score AS DOUBLE) AS score FROM (
  SELECT model_id, 'Accuracy Score' AS metric, round_even(CAST(accuracy * 100.0 AS DECIMAL(38, 10)), 1) AS score
  FROM model_metrics
  UNION ALL
  SELECT model_id, 'F1 Score', round_even(CAST(weighted_f1 * 100.0 AS DECIMAL(38, 10)), 1) FROM model_metrics)
ORDER BY model_id, metric""", "model_metrics"))
def q_metric_table(spark, sf):
    """Accuracy / F1 x 100 to one decimal (half-even), long form, sorted."""
    return C.metric_table(_metrics(spark, sf))


@query("f6_truth_label_counts", with_views("""
SELECT actual_sentiment, CAST(count(*) AS BIGINT) AS n FROM dialogues
WHERE dataset = 'training' AND actual_sentiment IS NOT NULL
GROUP BY actual_sentiment ORDER BY n DESC, actual_sentiment""", "dialogues"))
def q_truth_counts(spark, sf):
    """Reference lines of the bar chart: true label counts, descending."""
    d = X.dialogues(spark, sf).where((F.col("dataset") == "training") & F.col("actual_sentiment").isNotNull())
    return (d.groupBy("actual_sentiment").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "actual_sentiment"))


@query("f8_heatmap_models", with_views("""
SELECT model_id, actual, predicted, n FROM cells
WHERE model_id IN ('mistral 7b', 'gemma 7b', 'llama 3 8b')""", "cells"))
def q_heatmap(spark, sf):
    """Heat-map cells of a chosen list of models; the model filter runs on
    the predictions before the join."""
    chosen = ["mistral 7b", "gemma 7b", "llama 3 8b"]
    p = X.sentiments(spark, sf).where(F.col("model_id").isin(chosen))
    return C.confusion_cells(C.align(X.dialogues(spark, sf), p))


@query("b13_metric_rounding", with_views("""
SELECT model_id, CAST(round_even(CAST(accuracy * 100.0 AS DECIMAL(38, 10)), 1) AS DOUBLE) AS accuracy_pct,
       CAST(round_even(CAST(weighted_f1 * 100.0 AS DECIMAL(38, 10)), 1) AS DOUBLE) AS f1_pct
FROM model_metrics""", "model_metrics"))
def q_metric_rounding(spark, sf):
    """value x 100 to one decimal, half-even on the decimal value."""
    m = _metrics(spark, sf)
    return m.select("model_id", C.round_metric(F.col("accuracy")).alias("accuracy_pct"),
                    C.round_metric(F.col("weighted_f1")).alias("f1_pct"))


@query("e4_label_frequency", with_views("""
SELECT model_id, generated_sentiment, CAST(count(*) AS BIGINT) AS n FROM sentiments
GROUP BY model_id, generated_sentiment""", "sentiments"))
def q_label_frequency(spark, sf):
    """Frequency of each predicted label per model, all models in one
    grouped count."""
    s = X.sentiments(spark, sf)
    return s.groupBy("model_id", "generated_sentiment").agg(F.count("*").cast("long").alias("n"))
