"""The pair table and the queries over it do each step of a row once."""

import random
from collections import Counter

import pytest

from parley.operators import scores as S
from parley.schemas import MODEL_IDS
from parley.session import fresh_path
from parley.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, rows):
    base = fresh_path(spark, "pairs")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' as source", "'en' as lang", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    return base


def _summary(did, mno, text):
    missing = None if did is None else (abs(did + mno) % 41) * (1 if did + mno >= 0 else -1)
    if missing == 0:
        return None
    if missing == 1:
        return ""
    if text is None:
        return None
    out = []
    for i, w in enumerate(text.replace("\n", " ").split(" ")):
        if not w:
            continue
        i = len([x for x in text.replace("\n", " ").split(" ")[:i] if x])
        turn = None if did is None else (i + did) % (mno + 3) if i + did >= 0 else -(-(i + did) % (mno + 3))
        if turn != 0:
            out.append(w + "s" if turn == 1 else w)
    cut = len(out) * mno // 10
    return " ".join(out[cut:] + out[:cut])


def test_pair_table_is_that_of_its_definition(spark):
    texts = ["", " ", "a", "a b", " \u00e9 x\x0by  z\n", "$1 \\ s ss  a.b", None, *[" ".join(f"w{k}" for k in range(n)) for n in (9, 10, 11, 40)]]
    rows = [(i + 100 * k, t) for i, t in enumerate(texts) for k in range(-11, 12)] + [(None, "a b c d e f g h i"), (None, None), (7, "b a")]
    p = X.summary_pairs(spark, _tables(spark, rows))
    got = Counter((r.dialogue_id, r.model_id, r.generated_summary) for r in p.collect())
    want = Counter((d, m, _summary(d, i + 1, t)) for d, t in rows for i, m in enumerate(MODEL_IDS))
    assert got == want
    assert "regexp_replace" in _plan(p)                    # no function per word for ids from 0 on


def test_sorted_scores_are_made_once(spark):
    import __spark_entry__ as E
    assert "MapInArrow" not in _plan(E.queries()["g1_sort_multi_key"](spark, SF))


@pytest.mark.parametrize("name", ["e5_duplicate_summaries", "e5_duplicate_dialogues"])
def test_texts_are_hashed_once(spark, name):
    import __spark_entry__ as E
    assert "xxhash64" not in _plan(E.queries()[name](spark, SF)).replace("hashpartitioning", "")


def test_plain_sentence_pairs_need_no_trace(monkeypatch):
    calls = []
    real = S.lcs_words
    monkeypatch.setattr(S, "lcs_words", lambda a, b: calls.append(1) or real(a, b))
    assert S.union_lcs_words([list("xay"), list("bcd")], [list("zaq"), list("bwcd")]) == 4 and not calls
    rng = random.Random(5)
    for _ in range(300):
        h, r = ([[rng.choice("abcdef") for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(0, 4))] for _ in range(2))
        assert S.union_lcs_words(h, r) == len(set().union(*[real(a, b) for a in r for b in h]))


def test_clipped_overlaps():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        of_b = S._gram_counts(b, (1, 2, "L"))
        for n in (1, 2):
            x, y = (Counter(zip(*[t[k:] for k in range(n)])) for t in (a, b))
            assert S._overlap(a, b, n, of_b) == sum((x & y).values())


def test_lexicon_meets_only_what_earlier_stages_leave(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["j4_meteor_synonyms"](spark, SF))
    assert "regexp_extract_all(lower(generated_summary" not in plan and "_hf" in plan


def test_runs_of_matches_come_back():
    rng = random.Random(7)
    for _ in range(300):
        h, r = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for _ in range(2))
        forms = [(h, r), ([x.replace("b", "a") for x in h], [x.replace("b", "a") for x in r])]
        groups = {"c": ["x"], "d": ["x", "y"], "e": ["y"]}
        match, hfree, rfree = S._matched(forms)
        S._take_grouped(hfree, rfree, *forms[-1], groups, match)
        n, m, *rest = S._rest_of(forms)
        assert (n, m) == (len(h), len(r)) and S._grouped_chunks(groups, *rest) == S._chunks(match)
