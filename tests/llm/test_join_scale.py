"""Joins that once grew faster than their input: copies that made every
key look shared, and groups chained by common passages."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from parley.llm import exchange as ex
from parley.llm import ngram_join, suffix_dedup
from test_queries import brute_components, collect


def _texts(n, words, seed):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(words)) for _ in range(n)]


def _repeated(spark, texts, times):
    rows = [(1000 * k + i, t) for k in range(times) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _sets(df, n):
    def compute(data, off):
        h, r = ngram_join.shingle_sets(data, off, n)
        return [pa.array(x) for x in ngram_join.set_names(h, r, len(off) - 1)]
    return ex.write_pieces(df, compute, (("n_shingles", "long"), ("set_a", "long"), ("set_b", "long")))


def test_copies_make_no_candidates(spark):
    texts = _texts(40, 60, 1)
    near = texts[0].split(" ")
    near[30] = "changed"
    df = _repeated(spark, [*texts, " ".join(near)], 4)
    found = ngram_join._candidates(_sets(df, 4), 4, 85, 12)
    assert found.count() == 2                           # the near copy and its origin
    got = collect(ngram_join.classes(df, 4, 85).drop("set_name"))
    assert got == brute_components([tuple(r) for r in df.collect()], 4, 85)


def test_copies_make_no_contexts(spark, monkeypatch):
    seen = []
    stored = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, stem: seen.append((stem, stored(df, stem))) or seen[-1][1])
    df = _repeated(spark, [*_texts(30, 40, 2), None, "", "short"], 3)
    out = suffix_dedup.remove_repeats(df).collect()
    assert dict(seen)["contexts"].count() == 0
    assert {r.doc_id for r in out if r.n_removed} == {r.doc_id for r in out if r.doc_id >= 1000 and r.n_bytes >= 50}
    assert all(r.n_removed in (0, r.n_bytes) for r in out)


def test_group_chained_by_passages_is_split(spark, monkeypatch):
    """Each text has two of five common passages and one that six texts have."""
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", 200)
    rng = random.Random(3)
    common, own = _texts(5, 30, 4), _texts(50, 30, 5)
    rows = [(i, " ".join([*rng.sample(common, 2), own[i // 6]])) for i in range(300)]
    for i in range(0, 300, 10):
        w = rows[i][1].split(" ")
        w[rng.randrange(90)] = "other"
        rows.append((300 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cand = ngram_join._candidates(_sets(df, 4), 4, 85, 12)
    whole = ngram_join._groups(cand)
    split = ngram_join._split(cand, whole, 85, 900)
    most = lambda g: g.groupBy("label").count().agg(F.max("count")).first()[0]
    assert most(whole) > 250 and most(split) < 60
    for task in (10 ** 6, 900):
        assert collect(ngram_join.classes(df, 4, 85, task).drop("set_name")) == brute_components(rows, 4, 85)
