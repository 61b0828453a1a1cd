"""Quantiles (one and two levels), positions, histogram, KDE, box statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import shaping as SH
from parley.operators import stats as ST


def _frame(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.choice(["hot", "a", "b"], size=n, p=[0.6, 0.3, 0.1])
    v = np.round(rng.normal(50, 15, size=n), 2)
    return spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)], "g string, v double"), g, v


@pytest.mark.parametrize("levels", [1, 2])
def test_group_quantiles_exact(spark, levels):
    df, g, v = _frame(spark)
    q = ST.group_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p9": 0.9},
                           buckets=4, levels=levels)
    got = {r.g: r for r in q.collect()}
    for key in ("hot", "a", "b"):
        x = v[g == key]
        for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("p9", 0.9)):
            assert getattr(got[key], name) == pytest.approx(np.percentile(x, p * 100), abs=1e-9)


def test_ordinal_and_ntile(spark):
    ids = list(range(0, 3000, 3)) + [10_000_001, 10_000_002] + list(range(50_000, 70_000, 7))
    df = spark.createDataFrame([(i, i % 2) for i in ids], "id long, part int")
    pos = {r.id: r.position for r in SH.ordinal(df, "id", width=400).collect()}
    assert [pos[i] for i in sorted(ids)] == list(range(1, len(ids) + 1))
    per = {(r.part, r.id): r.position for r in SH.ordinal(df, "id", parts=("part",), width=400).collect()}
    for p in (0, 1):
        mine = sorted(i for i in ids if i % 2 == p)
        assert [per[(p, i)] for i in mine] == list(range(1, len(mine) + 1))
    parts = {r.id: r.part for r in SH.ntile_parts(df, "id", 13).collect()}
    want = np.concatenate([np.full(len(a), k + 1) for k, a in enumerate(np.array_split(sorted(ids), 13))])
    assert [parts[i] for i in sorted(ids)] == list(want)


def test_positions_of_any_key(spark):
    """Sparse 64-bit numbers, strings, two order columns, null parts and a
    part with most rows."""
    rng = np.random.default_rng(8)
    big = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 400)]
    part = [None if i % 7 == 0 else "hot" if i % 5 else "b" for i in range(400)]
    rows = [(b, f"k{b:x}", p, i % 3) for i, (b, p) in enumerate(zip(big, part))]
    df = spark.createDataFrame(rows, "n long, s string, part string, m int")
    for col, at in (("n", 0), ("s", 1)):
        want = {r[at]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: r[at]))}
        assert {r[col]: r.position for r in SH.ordinal(df, col).collect()} == want
    got = SH.ordinal(df, ["m", "n"], parts=("part",)).collect()
    for p in ("hot", "b", None):
        mine = sorted((r[3], r[0]) for r in rows if r[2] == p)
        assert [(r.m, r.n) for r in sorted((g for g in got if g.part == p), key=lambda g: g.position)] == mine
        assert {g._total for g in got if g.part == p} == {len(mine)}
        assert sorted(g.position for g in got if g.part == p) == list(range(1, len(mine) + 1))
    assert SH.ordinal(df.limit(0), "n").count() == 0


def test_positions_with_ties(spark):
    """Equal keys get one position each; a tie column deals them to slices."""
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id"))
    for tie in (None, F.col("id")):
        got = SH.ordinal(df, "k", tie=tie, width=100)
        assert sorted(r.position for r in got.collect()) == list(range(1, 1001))


def test_histogram_matches_numpy(spark):
    df, g, v = _frame(spark)
    h = ST.histogram(df, ["g"], "v").collect()
    for key in ("hot", "a", "b"):
        x = v[g == key]
        counts, edges = np.histogram(x, bins="auto")
        mine = sorted((r.bin, r.n, r.lo, r.hi) for r in h if r.g == key)
        assert [m[1] for m in mine] == list(counts)
        assert [m[2] for m in mine] == pytest.approx(list(edges[:-1]))


def test_kde_integrates_to_one(spark):
    df, g, v = _frame(spark)
    k = ST.kde(df, ["g"], "v").collect()
    for key in ("hot", "a"):
        pts = sorted((r.x, r.density) for r in k if r.g == key)
        xs, ys = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        assert np.sum((ys[1:] + ys[:-1]) / 2 * np.diff(xs)) == pytest.approx(1.0, abs=0.01)
        x = v[g == key]
        h = x.std(ddof=1) * len(x) ** (-0.2)
        direct = np.exp(-0.5 * ((xs[50] - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi))
        assert ys[50] == pytest.approx(direct, rel=1e-9)


def test_kde_skips_degenerate_groups(spark):
    df = spark.createDataFrame([("one", 1.0), ("flat", 2.0), ("flat", 2.0)], "g string, v double")
    assert ST.kde(df, ["g"], "v").count() == 0


def test_box_and_outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("m", x) for x in vals], "g string, v double")
    b = ST.box_stats(df, ["g"], "v").first()
    q1, q3 = np.percentile(vals, 25), np.percentile(vals, 75)
    assert (b.q1, b.q3) == (q1, q3)
    assert b.whisker_hi == 5.0 and b.n_fliers == 1
    kept = ST.remove_outliers(df, ["g"], "v").select(F.max("v")).first()[0]
    assert kept == 5.0


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, " a b\n"), (4, "c")], "id long, t string")
    d = {r.id: r.n_copies for r in ST.duplicate_groups(df, "id", "t").collect()}
    assert d == {1: 3, 2: 3, 3: 3}
    s = ST.duplicate_summary(ST.duplicate_groups(df, "id", "t")).first()
    assert (s.duplicate_texts, s.excess_rows) == (1, 2)


def test_duplicates_of_composite_keys_and_long_texts(spark):
    """Keys of any type; equal up to white space; nulls are one text."""
    rows = [(1, "a", "x  y"), (2, "b", " x y\n"), (3, "c", "X y"), (4, "d", "z" * 100_000), (5, "e", "z" * 100_000), (6, "f", "z" * 99_999)]
    df = spark.createDataFrame(rows, "i int, m string, t string").select(F.struct("i", "m").alias("k"), "t")
    got = {tuple(r.k): r.n_copies for r in ST.duplicate_groups(df, "k", "t").collect()}
    assert got == {(1, "a"): 2, (2, "b"): 2, (4, "d"): 2, (5, "e"): 2}
