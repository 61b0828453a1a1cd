"""Registered queries give equal results at 1, 4 and 16 shuffle partitions."""

import math

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["e12_confusion_matrix", "e7_describe", "f1_histogram", "f2_kde", "j3_rouge_clipped", "j4_meteor",
         "b14_ntile_parts", "d7_wide_by_position", "e15_reassemble_chunks", "e5_duplicate_dialogues"]


def _rows(df):
    def norm(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_equal_across_partitions(spark, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = {}
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            out[n] = _rows(q(spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[1] == out[4] == out[16]
    assert len(out[1]) > 0
