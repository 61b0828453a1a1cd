"""The pipeline, stage by stage, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from parley.llm import mixing, packing, pii
from parley.llm.queries import tokenizer
from tests.llm.test_queries import DDL, WORD, brute_components, check_mix, check_pieces, odd_rows, shingles


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(odd_rows(), DDL).write.parquet(str(root / "in"))
    docs, out = spark.read.parquet(str(root / "in")), {}
    for name, f in cp.STAGES:
        f(spark, docs, str(root)).write.parquet(str(root / name))
        got = spark.read.parquet(str(root / name))
        out[name] = (docs, got)
        docs = got
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "personal_data", "mix_sources", "pack"]
    for name, (a, b) in list(stages.items())[:-1]:
        assert b.columns == a.columns, name


def test_stages(stages):
    key = lambda r: str(r.asDict())
    a, b = (x.collect() for x in stages["language_id"])
    assert not Counter(map(key, b)) - Counter(map(key, a))
    assert all(r.text and any(c.isalpha() for c in r.text) for r in b) and len(b) > 0.9 * len(a)
    a, b = (x.collect() for x in stages["near_duplicates"])
    groups = {(g, c) for _, _, c, g in brute_components([(r.doc_id, r.text) for r in a], 5, 80, True)}
    assert Counter(r.doc_id for r in b) == Counter(c for _, c in groups)
    assert all(shingles(r.text, 5) for r in b)
    a, b = (x.collect() for x in stages["personal_data"])
    assert len(a) == len(b)
    for r in b:
        assert pii.identifiers(r.text) == [] and r.n_chars == len(r.text)
    a, b = (x.collect() for x in stages["mix_sources"])
    took = Counter()
    for r in b:
        took[r.doc_id] += len(WORD.findall(r.text))
    rows = [r.asDict() for r in mixing.taken(stages["mix_sources"][0]).collect()]
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in a])
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    assert +took == +want


def test_pack_stage(spark, stages):
    docs, out = stages["pack"]
    pieces = [r.asDict() for r in packing.pack(docs, tokenizer()).collect()]
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], pieces, tokenizer())
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in out.collect()) == Counter(
        (p["doc_id"], p["start"], p["ids_crc32"]) for p in pieces)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DDL)
    for i, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() == 0, name


def test_run_reads_the_table(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
