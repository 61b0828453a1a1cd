"""Steps that once shuffled every row twice, or did the same work for each model."""

import numpy as np
from pyspark.sql import functions as F

from parley.functions.stem import FinalS
from parley.operators import bertscore as B
from parley.operators import scores as S
from parley.session import fresh_path
from parley.sources import sinks as SK


def test_resumed_append_leaves_rows_where_they_are(spark, monkeypatch):
    plans = []
    pending = SK.pending

    def planned(*args):
        out = pending(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(SK, "pending", planned)
    models = F.explode(F.array(*[F.lit(m) for m in "abc"]))
    df = (spark.range(600).repartition(8, "id").select("id", models.alias("model_id"), (F.col("id") % 40).alias("batch_id"),
                                                       F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))
    path, keys = fresh_path(spark, "appended"), ["id", "model_id"]
    SK.append_batches(df.where("id < 200"), path, keys)
    SK.append_batches(df, path, keys)
    SK.append_batches(df, path, keys)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    # the rows are dealt once by id, the table's keys follow
    assert "SortMergeJoin" not in plans[-1] and plans[-1].count("Exchange") == 2
    files = (back.where("id >= 200").select("model_id", "batch_id", F.input_file_name().alias("file")).distinct()
             .groupBy("model_id", "batch_id").agg(F.count("file").alias("n")))
    assert files.agg(F.max("n")).first()[0] == 1
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_reference_of_many_models_is_embedded_once(spark):
    class Counting(B.HashEmbedder):
        def __call__(self, texts):
            refs = [tuple(x) for x in texts if x[0] == "ref"]
            assert len(refs) == len(set(refs))
            return super().__call__(texts)

    rows = [(d, m, f"ref w{d} b c {m} d", f"ref w{d} b c d") for d in range(5) for m in range(7)]
    df = spark.createDataFrame(rows, "id long, m int, h string, r string").coalesce(1)
    df = df.withColumn("h", F.expr("substr(h, 5)"))
    got = {(r.id, r.m): r for r in B.score_texts(df, ["id", "m"], "h", "r", Counting).collect()}
    vec = B.HashEmbedder()
    for d, m, h, r in rows:
        c, f = (np.array([vec.vector(t) for t in x.split()], float) for x in (h[4:], r))
        cos = (c / np.linalg.norm(c, axis=1, keepdims=True)) @ (f / np.linalg.norm(f, axis=1, keepdims=True)).T
        assert abs(got[(d, m)].bert_precision - cos.max(1).mean()) < 1e-9 and abs(got[(d, m)].bert_recall - cos.max(0).mean()) < 1e-9


def test_unlike_vectors_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(B, "_FACTORS", np.zeros(4, np.uint64))
    rng = np.random.default_rng(5)
    c, r = rng.normal(size=(20, 4)), rng.normal(size=(30, 4))
    cos = (c / np.linalg.norm(c, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
    got = B.best_cosines(c, r)
    assert np.allclose(got[0], cos.max(1)) and np.allclose(got[1], cos.max(0))


def test_lexicon_is_asked_once_for_rows_of_one_batch(spark, monkeypatch):
    asked = []
    stored = S.stored
    monkeypatch.setattr(S, "stored", lambda df, stem: asked.append(stored(df, stem)) or asked[-1])
    words = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, m, words("h", 20), words("r", 20)) for m in range(50)] + [(2, 0, None, "r1"), (None, 0, "h1 x", "r1 x"), (3, 0, "", "a")]
    df = spark.createDataFrame(rows, "id long, m int, h string, r string").coalesce(1)
    lexicon = spark.createDataFrame([(f"{x}{k}", f"g{k}") for x in "hr" for k in range(0, 20, 2)], "word string, group string")
    got = {(r.id, r.m): r.meteor for r in S.meteor(df, ["id", "m"], "h", "r", lexicon=lexicon).collect()}
    assert len(got) == len(rows) and got[(2, 0)] is None and got[(3, 0)] is None
    assert len({got[(1, m)] for m in range(50)}) == 1 and 0 < got[(1, 0)] < 0.5
    assert asked[0].select(F.explode("_v")).count() == 40            # not 50 times


def test_final_s_in_bytes_is_that_on_columns(spark):
    df = spark.createDataFrame([(1, "Cats, dogs ss s\x0bs És", "cat dog s. és"), (2, "", "a"), (3, None, "a"), (4, "as", "as")],
                               "id long, h string, r string")
    rule = lambda t: F.regexp_replace(t, "s\\z", "")
    for score in (S.meteor, S.rouge_clipped):
        a, b = (sorted(map(tuple, score(df, ["id"], "h", "r", stems=x).collect())) for x in (rule, FinalS()))
        assert a == b
    assert "regexp_replace" not in S.meteor(df, ["id"], "h", "r", stems=FinalS())._jdf.queryExecution().executedPlan().toString()
