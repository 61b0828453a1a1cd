"""Compiled constraint rules against counts by hand."""

import pytest

from parley.operators.quality import check_declared
from parley.schemas import DECLARED, LABEL_DOMAINS


def _tables(spark):
    d = spark.createDataFrame([(1, "training", "t", "s", "positive"), (1, "x" * 11, "t", None, "bad"), (None, None, None, "s", None),
                               (2, "test", "t", "s", "very negative")],
                              "dialogue_id long, dataset string, dialogue_text string, actual_summary string, actual_sentiment string")
    m = spark.createDataFrame([("a", 1), ("a", 1), ("y" * 51, 1), (None, 1)], "model_id string, gpu_usage int")
    s = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (2, 9, None), (3, None, "a"), (2, 9, "a")], "summary_id long, dialogue_id long, model_id string")
    e = spark.createDataFrame([], "evaluation_id long, model_id string")
    return {"dialogues": d, "models": m, "summaries": s, "sentiment_evaluation": e}


WANT = {
    ("dialogues", "not_null:dialogue_id"): 1, ("dialogues", "primary_key:dialogue_id"): 1, ("dialogues", "not_null:dataset"): 1,
    ("dialogues", "max_length:dataset"): 1, ("dialogues", "not_null:dialogue_text"): 1, ("dialogues", "not_null:actual_summary"): 1,
    ("dialogues", "max_length:actual_sentiment"): 1, ("dialogues", "domain:actual_sentiment"): 2,
    ("models", "not_null:model_id"): 1, ("models", "primary_key:model_id"): 1, ("models", "max_length:model_id"): 1,
    ("summaries", "not_null:summary_id"): 0, ("summaries", "primary_key:summary_id"): 2,
    ("summaries", "foreign_key:dialogue_id->dialogues"): 2, ("summaries", "foreign_key:model_id->models"): 1,
    ("summaries", "max_length:model_id"): 0,
    ("sentiment_evaluation", "not_null:evaluation_id"): 0, ("sentiment_evaluation", "primary_key:evaluation_id"): 0,
    ("sentiment_evaluation", "foreign_key:model_id->models"): 0, ("sentiment_evaluation", "max_length:model_id"): 0,
}


@pytest.mark.parametrize("registries", [None, {"models": ["a"]}])
def test_every_rule_is_counted(spark, registries):
    """By digests, and with the models as a literal set; zeros of an empty table."""
    rows = check_declared(_tables(spark), registries=registries).collect()
    assert {(r.table_name, r.check): r.n_violations for r in rows} == WANT and len(rows) == len(WANT)


def test_rules_of_absent_tables_are_left_out(spark):
    only = {"summaries": _tables(spark)["summaries"]}
    got = {(r.table_name, r.check): r.n_violations for r in check_declared(only).collect()}
    assert got == {k: v for k, v in WANT.items() if k[0] == "summaries" and "foreign_key" not in k[1]}


def test_one_scan_and_one_exchange_of_digests(spark, tmp_path):
    tables = {}
    for name, df in _tables(spark).items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.schema(df.schema).parquet(str(tmp_path / name))
    plan = check_declared(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(tables) and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning(tag") <= 3


def test_all_declared_columns_are_in_the_schemas():
    from parley.schemas import TABLES
    assert {t for t, *_ in DECLARED} == set(TABLES)
    assert all(c in TABLES[t].fieldNames() for t, c, _, _ in DECLARED + LABEL_DOMAINS)
