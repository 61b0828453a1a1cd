"""Plan review: no cartesian products anywhere; Python only where chosen."""

import pytest

SF = "/root/testdata/sf0.001"
# queries that write files while they are built are covered elsewhere
WRITES = {"a1_read_dialogue_csv", "a5_scan_table", "a6_read_results_csv", "a7_append_batches", "a8_write_csv",
          "a9_append_table", "a9_append_summaries", "a11_recreate_table", "a12_bulk_load", "a16_run_metrics",
          "k1_annotate_stream", "k1_requests_stream", "a7_resumable_ranges",
          "a14_upsert_in_place", "i5_labels_in_parts"}
# must be fully JVM-side (no Python evaluation nodes)
NATIVE = ["e11_sentiment_metrics", "e12_confusion_matrix", "e13_class_metrics", "i7_extract_sentiment",
          "i2_split_dialogue", "j1_rouge_n", "e5_duplicate_dialogues",
          "f2_kde", "f1_histogram", "d7_wide_by_position", "b14_ntile_parts", "e15_reassemble_chunks",
          "a13_check_constraints", "g8_pivot"]
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow")
BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    import __spark_entry__ as E
    bad = {}
    for name in sorted(E.queries()):
        if name in WRITES:
            continue
        plan = _plan(spark, name)
        hits = [b for b in BAD_JOINS if b in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_have_no_python(spark, name):
    plan = _plan(spark, name)
    assert not [p for p in PYTHON_NODES if p in plan]


@pytest.mark.parametrize("name", ["j1_rouge_n", "j2_rouge_l", "j3_rouge_clipped", "j3_rouge_stemmed", "j4_meteor",
                                  "j4_meteor_stems", "j6_score_summaries"])
def test_scores_stay_in_the_row(spark, name):
    """Scoring itself shuffles nothing: no exchange above the pair table."""
    plan = _plan(spark, name)
    above = plan[:plan.rindex("Generate")]
    assert "Exchange" not in above and "Join" not in above


def test_flagship_prunes_columns(spark):
    plan = _plan(spark, "e11_sentiment_metrics")
    # the truth side reads only the key column of documents
    assert "FileScan parquet [doc_id" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,n_chars:bigint>" in plan
