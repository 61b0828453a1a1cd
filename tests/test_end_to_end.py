"""The README flow end to end: CSV -> parse -> metrics; chunk -> generate ->
score -> distributions -> checked load."""

from pyspark.sql import functions as F

from parley.functions.parse import extract_sentiment
from parley.operators import classification, generate, scores, stats
from parley.session import fresh_path
from parley.sources import files, fixtures as X, sinks

SF = "/root/testdata/sf0.001"


def test_readme_flow(spark):
    d = X.dialogues(spark, SF)
    csv = fresh_path(spark, "e2e-csv")
    sinks.write_csv(d.select(F.col("dialogue_id").cast("string").alias("id"), F.col("dialogue_text").alias("dialogue"),
                             F.col("actual_summary").alias("summary"), "topic",
                             F.col("actual_sentiment").alias("sentiment")), csv)
    dialogues = files.read_dialogue_csv(spark, csv)
    raw = X.raw_outputs(spark, SF).select("dialogue_id", "model_id", "raw_output")
    preds = raw.select("dialogue_id", "model_id", extract_sentiment("raw_output", "v1").alias("generated_sentiment"))
    truth = dialogues.select(F.col("id").cast("long").alias("dialogue_id"), F.col("sentiment").alias("actual_sentiment"))
    metrics = classification.model_metrics(classification.confusion_cells(classification.align(truth, preds)))
    assert metrics.count() == 7

    summaries = generate.summarise_long(dialogues.select(F.col("id").cast("long").alias("dialogue_id"),
                                                         F.col("dialogue").alias("dialogue_text")),
                                        generate.LeadWords(10), "mistral 7b")
    ref = dialogues.select(F.col("id").cast("long").alias("dialogue_id"), F.col("summary").alias("actual_summary"))
    scored = scores.score_summaries(summaries.join(ref, "dialogue_id").withColumnRenamed("summary", "generated_summary"),
                                    ["dialogue_id", "model_id"])
    assert stats.box_stats(scored, ["model_id"], "rouge_1").count() == 1
    assert stats.kde(scored, ["model_id"], "meteor").count() == 200
    base = fresh_path(spark, "e2e-wh")
    sinks.append_table(scored.drop("actual_summary").withColumnsRenamed(
        {"time_taken": "time_summary_taken", "memory_usage": "memory_summary_usage"}), "summaries", base)
    assert spark.read.parquet(f"{base}/summaries").count() == d.count()
