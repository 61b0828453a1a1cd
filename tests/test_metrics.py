"""Classification metrics: golden matrix, properties, partition invariance."""

import pytest
from pyspark.sql import functions as F

from parley.operators import classification as C

LABELS = ["negative", "neutral", "positive"]
GOLDEN = [[994, 617, 405], [200, 952, 2240], [169, 578, 6272]]


def golden_aligned(spark):
    """Aligned (actual, predicted) rows expanded from the published cells."""
    cells = [(LABELS[i], LABELS[j], GOLDEN[i][j]) for i in range(3) for j in range(3)]
    c = spark.createDataFrame(cells, "actual string, predicted string, n int")
    rows = c.select("actual", "predicted", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return rows.select(F.monotonically_increasing_id().alias("dialogue_id"), F.lit("m").alias("model_id"),
                       "actual", "predicted")


def test_golden_matrix(spark):
    a = golden_aligned(spark)
    cells = C.confusion_cells(a)
    got = {(r.actual, r.predicted): r.n for r in cells.collect()}
    assert all(got[(LABELS[i], LABELS[j])] == GOLDEN[i][j] for i in range(3) for j in range(3))
    m = C.model_metrics(cells).first()
    assert m.n == sum(map(sum, GOLDEN))
    assert m.accuracy == pytest.approx(0.661302, abs=1e-6)
    assert m.weighted_f1 == pytest.approx(0.633867, abs=1e-6)
    assert m.macro_f1 == pytest.approx(0.573078, abs=1e-6)
    f1 = {r.label: r.f1 for r in C.class_stats(cells).collect()}
    assert (round(f1["negative"], 3), round(f1["neutral"], 3), round(f1["positive"], 3)) == (0.588, 0.344, 0.787)


def test_zero_cells_and_out_of_domain(spark):
    a = spark.createDataFrame([(1, "m", "positive", "positive"), (2, "m", "positive", "maybe")],
                              "dialogue_id long, model_id string, actual string, predicted string")
    cells = C.confusion_cells(a)
    assert cells.count() == 10          # 9 grid cells (zeros kept) + the out-of-domain cell
    m = C.model_metrics(cells).first()
    assert m.accuracy == 0.5 and 0 <= m.weighted_f1 <= 1


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partition_invariance(spark, parts):
    from parley.sources import fixtures as X
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = sorted(tuple(r) for r in C.sentiment_metrics(
            X.dialogues(spark, "/root/testdata/sf0.001"), X.sentiments(spark, "/root/testdata/sf0.001")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    ref = sorted(tuple(r) for r in C.sentiment_metrics(
        X.dialogues(spark, "/root/testdata/sf0.001"), X.sentiments(spark, "/root/testdata/sf0.001")).collect())
    assert [r[:2] for r in rows] == [r[:2] for r in ref]
    for x, y in zip(rows, ref):
        assert x[2:] == pytest.approx(y[2:], abs=1e-12)
    total = sum(r[1] for r in rows)
    assert total > 0
