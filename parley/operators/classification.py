"""Sentiment classification metrics for all models in one plan.

Predictions of every model are joined to the truth once (D-1), reduced to
confusion cells with one grouped count (map-side partial aggregation, so
the shuffle carries at most models x labels^2 rows per task), and all
metrics are derived from the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.schemas import LABELS

KEY = "dialogue_id"


def align(truth: DataFrame, preds: DataFrame, key: str = KEY,
          truth_col: str = "actual_sentiment", pred_col: str = "generated_sentiment") -> DataFrame:
    """Inner join truth to predictions on ``key`` for all models at once.
    Rows without a true label are dropped (metrics ignore them)."""
    t = truth.select(key, F.col(truth_col).alias("actual")).where(F.col("actual").isNotNull())
    p = preds.select(key, "model_id", F.col(pred_col).alias("predicted"))
    return t.join(p, key)


def confusion_cells(aligned: DataFrame, labels=LABELS) -> DataFrame:
    """(model_id, actual, predicted, n) with every domain cell present
    (zero cells kept) and observed out-of-domain cells as extra rows.

    One grouped count, then each cell row emits itself plus the fixed
    labels x labels grid with count 0, and a second grouped sum merges
    them: a single chain (the input is read once), nothing collected per
    model, and labels outside the domain simply stay as their own cells."""
    cells = aligned.groupBy("model_id", "actual", "predicted").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    grid = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), zero.alias("n"))
            for a in labels for p in labels]
    own = F.struct(F.col("actual"), F.col("predicted"), F.col("n").cast("long").alias("n"))
    x = cells.select("model_id", F.explode(F.array(own, *grid)).alias("c")).select("model_id", "c.*")
    return x.groupBy("model_id", "actual", "predicted").agg(F.sum("n").cast("long").alias("n"))


def class_stats(cells: DataFrame) -> DataFrame:
    """Per (model, label): tp, support (true count), predicted count,
    precision, recall, f1 (0 on a zero denominator). Each cell contributes
    to its row label and its column label through one ``explode``."""
    both = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("pred")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("pred")))
    x = cells.select("model_id", F.explode(both).alias("x")).select("model_id", "x.*")
    s = (x.where(F.col("label").isNotNull())
          .groupBy("model_id", "label")
          .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("pred").alias("predicted")))
    tp, sup, pr = F.col("tp"), F.col("support"), F.col("predicted")
    return s.select(
        "model_id", "label", "tp", "support", "predicted",
        F.when(pr == 0, 0.0).otherwise(tp / pr).alias("precision"),
        F.when(sup == 0, 0.0).otherwise(tp / sup).alias("recall"),
        F.when(sup + pr == 0, 0.0).otherwise(F.lit(2.0) * tp / (sup + pr)).alias("f1"),
    )


def model_metrics(cells: DataFrame) -> DataFrame:
    """Per model: n, accuracy, weighted F1 (by true support), macro F1
    (over labels seen in truth or prediction) -- all from the per-label
    table, so the plan is one chain (truth rows all have a label, so the
    sum of supports is n and the sum of tp is the number correct)."""
    cs = class_stats(cells)
    f = cs.groupBy("model_id").agg(
        F.sum("tp").alias("correct"),
        F.sum(F.col("support") * F.col("f1")).alias("wf"),
        F.sum("support").alias("sup"),
        F.avg(F.when(F.col("support") + F.col("predicted") > 0, F.col("f1"))).alias("macro_f1"))
    return f.select(
        "model_id", F.col("sup").cast("long").alias("n"),
        (F.col("correct") / F.col("sup")).alias("accuracy"),
        F.when(F.col("sup") == 0, 0.0).otherwise(F.col("wf") / F.col("sup")).alias("weighted_f1"),
        "macro_f1")


def sentiment_metrics(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Minimum end-to-end slice: accuracy and weighted F1 of every model."""
    return model_metrics(confusion_cells(align(truth, preds)))


def label_counts_table(preds: DataFrame, labels=LABELS) -> DataFrame:
    """E-17: counts per (label, model) on the fixed label rows; a label a
    model never produced has NULL (not 0), as the pivoted source table.
    One grouped count, then a per-model map looked up for each label."""
    counts = preds.groupBy("model_id", "generated_sentiment").agg(F.count("*").alias("n"))
    known = F.when(F.col("generated_sentiment").isin(*labels), F.struct("generated_sentiment", "n"))
    per_model = counts.groupBy("model_id").agg(F.map_from_entries(F.collect_list(known)).alias("m"))
    x = per_model.select("model_id", "m", F.explode(F.array(*[F.lit(v) for v in labels])).alias("sentiment"))
    return x.select("sentiment", "model_id", F.element_at("m", F.col("sentiment")).cast("long").alias("total_classified"))


def round_metric(c) -> F.Column:
    """value x 100 to one decimal, half-even on the decimal text."""
    return F.bround(c * F.lit(100.0), 1)


def metric_table(metrics: DataFrame) -> DataFrame:
    """E-18: long (model, metric, score) of accuracy / F1 x 100, rounded,
    sorted by model then metric."""
    m = metrics.select("model_id",
                       round_metric(F.col("accuracy")).alias("Accuracy Score"),
                       round_metric(F.col("weighted_f1")).alias("F1 Score"))
    return (m.unpivot("model_id", ["Accuracy Score", "F1 Score"], "metric", "score")
             .orderBy("model_id", "metric"))
