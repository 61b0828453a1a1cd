"""Steps that once kept rows on disk, made folders per batch, or failed on a table in many files."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import bertscore as B
from parley.operators import scores as S
from parley.session import fresh_path
from parley.sources import sinks as SK

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "a b. c\x0bd a", "a b c. d a"), (2, " . x", "x . y"), (3, None, "a"), (4, "", "a"), (5, "É é x-y. ", "é é x y")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j2_rouge_l", "j2_rouge_l_union", "j3_rouge_clipped", "j3_rouge_stemmed", "j3_rouge_porter", "j4_meteor",
                                  "j4_meteor_stems", "j4_meteor_porter", "j6_score_summaries", "b9_struct_to_columns"])
def test_scores_keep_no_queue_of_rows(spark, name):
    import __spark_entry__ as E
    assert "ArrowEvalPython" not in _plan(E.queries()[name](spark, SF))


def test_rouge_of_one_pass_is_that_of_columns(spark):
    df = spark.createDataFrame(TEXTS, "id long, h string, r string")
    a = {r.id: (r.rouge_1, r.rouge_2) for r in S.rouge_n(df, "h", "r").collect()}
    b = {r.id: (r.rouge_1, r.rouge_2) for r in S.rouge_l(df, "h", "r", orders=(1, 2)).collect()}
    assert a == b and a[3] == a[4] == (None, None) and a[2][0] is not None


def test_stream_reads_a_table_in_many_files(spark):
    import __spark_entry__ as E
    base = fresh_path(spark, "split")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{base}/{t}.parquet")
    q = E.queries()
    got, want = (sorted(map(tuple, q[f"k1_annotate_{x}"](spark, base).collect())) for x in ("stream", "batch"))
    assert got == want and got


def test_missing_output_makes_each_summary_once(spark):
    import __spark_entry__ as E
    assert _plan(E.queries()["c4_missing_output"](spark, SF)).count("slice(") <= 3


def test_appended_batches_make_no_folder_each(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.lit("m").alias("model_id"), (F.col("id") % 200).alias("batch_id"))
    path = fresh_path(spark, "appended")
    SK.append_batches(df.where("k < 100"), path, ["k"])
    SK.append_batches(df, path, ["k"])
    back = spark.read.parquet(path)
    assert sorted(r.k for r in back.collect()) == list(range(400)) and back.schema["batch_id"].dataType.simpleString() == "bigint"
    assert len(glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True)) <= 16


@pytest.mark.parametrize("name", ["e15_reassemble_chunks", "d2_reference_generated_join"])
def test_chunks_of_every_model_are_not_shuffled(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF))
    assert "Exchange hashpartitioning(dialogue_id" not in plan.split("Generate explode")[0].replace("REPARTITION", "")


def test_best_cosines_of_repeated_vectors():
    rng = np.random.default_rng(3)
    v = rng.integers(-5, 6, (40, 4)) * 2.0 + 1
    c, r = v[rng.integers(0, 30, 300)], v[rng.integers(10, 40, 200)]
    cos = (c / np.linalg.norm(c, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
    got = B.best_cosines(c, r)
    assert np.allclose(got[0], cos.max(1)) and np.allclose(got[1], cos.max(0))
    assert B.best_cosines(c, r, most=10) is None and B.best_cosines(c, r, most=20 * 40) is not None


def test_long_pair_with_few_distinct_words_is_scored_in_its_row(spark):
    df = spark.createDataFrame([(1, "a b c " * 900, "a b d " * 900)], "id long, h string, r string")
    one, two = (B.score_texts(df, ["id"], "h", "r", in_row=n).first() for n in (600, 10_000))
    assert abs(one.bert_f1 - two.bert_f1) < 1e-9
