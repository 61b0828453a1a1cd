"""Runs that go on after a stop, and tables written range by range."""

import os
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parley.operators import generate as G
from parley.session import fresh_path
from parley.sources.ranges import RangeRun, RangeTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # workers do not import the tests


class Failing:
    """Notes every prompt in a file; fails on one as long as ``flag`` is there."""

    def __init__(self, folder, bad):
        self.folder, self.bad = folder, bad

    def __call__(self, prompts):
        if self.bad in prompts and os.path.exists(f"{self.folder}/flag"):
            raise RuntimeError("model lost")
        with open(f"{self.folder}/calls-{os.getpid()}", "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        return [p.upper() for p in prompts]


def test_a_broken_run_goes_on_without_repeating_a_call(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    model, path = Failing(str(tmp_path), "p57"), fresh_path(spark, "run")
    work = lambda part: G.generate(part, model).select("id", "output")
    (tmp_path / "flag").touch()
    first = RangeRun(spark, path)
    with pytest.raises(Exception, match="model lost"):
        first.run(df, "id", work, 10)
    assert first.pending() == [5, 6, 7, 8, 9]
    assert sorted(r.id for r in first.result().collect()) == list(range(50))
    (tmp_path / "flag").unlink()
    before = _calls(tmp_path)
    second = RangeRun(spark, path)                       # another driver run
    assert second.run(df, "id", work, 10) == 5 and second.pending() == []
    again = _calls(tmp_path) - before
    assert set(again) == {f"p{i}" for i in range(50, 100)} and max(again.values()) == 1
    got = {r.id: (r.output, r.batch_id) for r in second.result().collect()}
    assert got == {i: (f"P{i}", i // 10) for i in range(100)}
    assert second.run(df, "id", work, 10) == 0 and _calls(tmp_path) == before + again


def _calls(folder):
    return Counter(line.strip() for f in folder.glob("calls-*") for line in open(f))


def test_ranges_of_any_key(spark):
    """Strings, nulls, a key with most rows, new keys on resume."""
    rows = [(None,), *[("hot",)] * 40, *[(f"k{i:03d}",) for i in range(30)]]
    df = spark.createDataFrame(rows, "k string")
    run = RangeRun(spark, fresh_path(spark, "run"))
    run.run(df, "k", lambda p: p, 4, at_most=1)
    more = df.unionByName(spark.createDataFrame([("zz",), ("a",)], "k string"))
    run.run(more, "k", lambda p: p, 4)
    got = Counter(r.k for r in run.result().collect())
    assert got == Counter(r[0] for r in rows) + Counter(["zz"])            # "a" falls in the finished range
    per_key = {r.k: r.n for r in run.result().groupBy("k").agg(F.countDistinct("batch_id").alias("n")).collect()}
    assert set(per_key.values()) == {1}
    empty = RangeRun(spark, fresh_path(spark, "run"))
    assert empty.run(df.limit(0), "k", lambda p: p, 4) == 1 and empty.result().count() == 0


def test_upsert_writes_only_what_changes(spark):
    df = spark.range(100).select(F.col("id"), F.lit("old").alias("label"), F.col("id").alias("x"))
    table = RangeTable(spark, fresh_path(spark, "table"))
    table.create(df, "id", 10)
    before = table.log.folders()
    change = spark.createDataFrame([(3, "new"), (77, "a"), (77, "b"), (500, "none"), (42, None), (15, "old")], "id long, label string")
    assert table.upsert(change, "id", ["label"]) == [0, 7]
    after = table.log.folders()
    assert {p for p in after if after[p] != before[p]} == {0, 7}          # the other files stay
    want = {i: ("new" if i == 3 else "b" if i == 77 else "old", i) for i in range(100)}
    assert {r.id: (r.label, r.x) for r in table.read().collect()} == want
    assert table.upsert(change, "id", ["label"]) == [] and table.log.folders() == after
    other = RangeTable(spark, table.path)                # another driver run
    assert {r.id: (r.label, r.x) for r in other.read().collect()} == want


def test_upsert_by_order_and_a_write_that_broke_off(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "id long, label string, score double")
    table = RangeTable(spark, fresh_path(spark, "table"))
    table.create(df, "id", 2)
    change = spark.createDataFrame([(2, "z", 5.0, 1), (2, "b", None, 2)], "id long, label string, score double, at int")
    enter, table.log.enter = table.log.enter, lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with pytest.raises(RuntimeError):
        table.upsert(change, "id", ["label", "score"], "at")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1.0), (2, None, 2.0)]       # files without an entry
    table.log.enter = enter
    assert table.upsert(change, "id", ["label", "score"], "at") == [1]
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert table.upsert(change.limit(0), "id", ["label"]) == []
