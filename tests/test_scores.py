"""Scores against brute-force Python forms of the written definitions."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import scores as S

PAIRS = [
    ("the cat sat on the mat. it was happy", "the cat was on the mat"),
    ("a b c d", "a b c d"),
    ("x y z", "p q r"),
    ("Hello, world. Good day!", "hello world good day"),
    ("one two two three", "two two one three three"),
]


def rwords(t):
    out = []
    for piece in t.split("."):
        if piece:
            ws = [w for w in re.split(r"[ \t\n\r\f]+", piece) if w]
            out.extend(ws or [""])
    return out


def rouge_n_rule(h, r, n):
    hw, rw = rwords(h), rwords(r)
    hg = {tuple(hw[i:i + n]) for i in range(len(hw) - n + 1)}
    rg = {tuple(rw[i:i + n]) for i in range(len(rw) - n + 1)}
    ov = len(hg & rg)
    p = ov / len(hg) if hg else 0.0
    rc = ov / len(rg) if rg else 0.0
    return 2.0 * ((p * rc) / (p + rc + 1e-8))


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def meteor_rule(h, r, alpha=0.9, beta=3.0, gamma=0.5):
    tok = re.compile(r'[^ \t\n\r\f.,;:!?()"]+|[.,;:!?()"]')
    hyp = list(enumerate(tok.findall(h.lower())))
    ref = list(enumerate(tok.findall(r.lower())))
    hl, rl = len(hyp), len(ref)
    matches = []
    for i in range(len(hyp))[::-1]:
        for j in range(len(ref))[::-1]:
            if hyp[i][1] == ref[j][1]:
                matches.append((hyp[i][0], ref[j][0]))
                hyp.pop(i)
                ref.pop(j)
                break
    matches.sort()
    m = len(matches)
    if m == 0:
        return 0.0
    chunks = 1 + sum(1 for a, b in zip(matches, matches[1:]) if not (b[0] == a[0] + 1 and b[1] == a[1] + 1))
    p, rc = m / hl, m / rl
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    return (1 - gamma * (chunks / m) ** beta) * fmean


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, "m", h, r) for i, (h, r) in enumerate(PAIRS)],
                                 "dialogue_id long, model_id string, hyp string, ref string")


def test_rouge_n_and_l(spark, pairs):
    out = S.rouge_l(S.rouge_n(pairs, "hyp", "ref"), "hyp", "ref").orderBy("dialogue_id").collect()
    for row, (h, r) in zip(out, PAIRS):
        assert row.rouge_1 == pytest.approx(rouge_n_rule(h, r, 1), abs=1e-12)
        assert row.rouge_2 == pytest.approx(rouge_n_rule(h, r, 2), abs=1e-12)
        L = lcs(rwords(h), rwords(r))
        p, rc = L / len(rwords(h)), L / len(rwords(r))
        assert row.rouge_l == pytest.approx(2.0 * ((p * rc) / (p + rc + 1e-8)), abs=1e-12)
    assert out[1].rouge_1 == pytest.approx(1.0, abs=1e-7)


def test_rouge_null_on_empty(spark):
    df = spark.createDataFrame([(1, "", "a b"), (2, None, "a")], "dialogue_id long, hyp string, ref string")
    out = S.rouge_n(df, "hyp", "ref").collect()
    assert all(r.rouge_1 is None for r in out)


def test_meteor_exact_stage(spark, pairs):
    out = {r.dialogue_id: r.meteor for r in S.meteor(pairs, ["dialogue_id", "model_id"], "hyp", "ref").collect()}
    for i, (h, r) in enumerate(PAIRS):
        assert out[i] == pytest.approx(meteor_rule(h, r), abs=1e-12)


def test_missing_texts_give_null_scores(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, "", "a"), (4, "a", " "), (5, "a", "a")],
                               "dialogue_id long, generated_summary string, actual_summary string")
    got = {r.dialogue_id: r for r in S.score_summaries(df, ["dialogue_id"]).collect()}
    clipped = {r.dialogue_id: r.rouge1_clipped for r in
               S.rouge_clipped(df, ["dialogue_id"], "generated_summary", "actual_summary").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert all(got[i].meteor is None and clipped[i] is None for i in (1, 2, 3, 4))
    assert all(got[i].rouge_1 is None for i in (1, 2, 3))
    assert got[5].meteor == pytest.approx(0.5) and clipped[5] == 1.0


def test_meteor_synonym_stage_and_rules(spark):
    key = ["dialogue_id", "model_id"]
    df = spark.createDataFrame([(1, "m", "big dogs run", "large dog run"), (2, "m", None, "x")],
                               "dialogue_id long, model_id string, h string, r string")
    stems = spark.createDataFrame([("dogs", "dog")], "word string, stem string")
    syn = spark.createDataFrame([("big", "large")], "word string, synonym string")
    table = {r.dialogue_id: r.meteor for r in S.meteor(df, key, "h", "r", stems=stems, synonyms=syn).collect()}
    rule = {r.dialogue_id: r.meteor for r in S.meteor(
        df, key, "h", "r", stems=lambda t: F.regexp_replace(t, "s\\z", ""),
        synonyms=lambda t: F.when(t == "big", "large").otherwise(t)).collect()}
    want = (1 - 0.5 * (1 / 3) ** 3) * 1.0        # all three match, in one chunk
    assert table[1] == pytest.approx(want) and rule[1] == pytest.approx(want)
    assert table[2] is None and rule[2] is None


def test_rouge_clipped_stems(spark):
    df = spark.createDataFrame([(1, "cats sit", "cat sits")], "dialogue_id long, h string, r string")
    stems = spark.createDataFrame([("cats", "cat"), ("sits", "sit")], "word string, stem string")
    for s in (stems, lambda t: F.regexp_replace(t, "s\\z", "")):
        r = S.rouge_clipped(df, ["dialogue_id"], "h", "r", (1, 2), stems=s).first()
        assert (r.rouge1_clipped, r.rouge2_clipped) == (1.0, 1.0)


def test_meteor_stem_stage(spark):
    df = spark.createDataFrame([(1, "m", "cats running", "cat runs")], "dialogue_id long, model_id string, h string, r string")
    stems = spark.createDataFrame([("cats", "cat"), ("cat", "cat"), ("running", "run"), ("runs", "run")],
                                  "word string, stem string")
    assert S.meteor(df, ["dialogue_id", "model_id"], "h", "r").first().meteor == 0.0
    assert S.meteor(df, ["dialogue_id", "model_id"], "h", "r", stems=stems).first().meteor > 0.5


def test_rouge_clipped(spark, pairs):
    out = {r.dialogue_id: r.rouge1_clipped for r in
           S.rouge_clipped(pairs, ["dialogue_id", "model_id"], "hyp", "ref", (1,)).collect()}
    from collections import Counter
    for i, (h, r) in enumerate(PAIRS):
        th = [w for w in re.sub("[^a-z0-9]+", " ", h.lower()).split(" ") if w]
        tr = [w for w in re.sub("[^a-z0-9]+", " ", r.lower()).split(" ") if w]
        ov = sum((Counter(th) & Counter(tr)).values())
        p, rc = ov / len(th), ov / len(tr)
        assert out[i] == pytest.approx(0.0 if p + rc == 0 else 2 * p * rc / (p + rc), abs=1e-12)


def test_bertscore_vs_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for pair in range(3):
        for t in range(rng.integers(5, 40)):
            rows.append((pair, "cand" if t % 2 == 0 else "ref", t, [float(x) for x in rng.normal(size=8)]))
    df = spark.createDataFrame(rows, "pair_id long, side string, token_no long, vector array<double>")
    got = {r.pair_id: r for r in S.bert_score(df, block=4).collect()}
    for pair in range(3):
        c = np.array([r[3] for r in rows if r[0] == pair and r[1] == "cand"])
        f = np.array([r[3] for r in rows if r[0] == pair and r[1] == "ref"])
        c = c / np.linalg.norm(c, axis=1, keepdims=True)
        f = f / np.linalg.norm(f, axis=1, keepdims=True)
        sim = c @ f.T
        p, r = sim.max(axis=1).mean(), sim.max(axis=0).mean()
        assert got[pair].bert_precision == pytest.approx(p, abs=1e-12)
        assert got[pair].bert_recall == pytest.approx(r, abs=1e-12)
        assert got[pair].bert_f1 == pytest.approx(2 * p * r / (p + r), abs=1e-12)


def sentences(t):
    return [[w for w in re.split(r"[ \t\n\r\f]+", p) if w] or [""] for p in t.split(".") if p]


def lcs_words_rule(x, y):
    """The LCS of x (reference) and y read off the whole table from its end."""
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
        t[i][j] = t[i - 1][j - 1] + 1 if x[i - 1] == y[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, i, j = set(), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.add(x[i - 1])
            i, j = i - 1, j - 1
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def rouge_union_rule(h, r):
    union = set()
    for x, y in itertools.product(sentences(r), sentences(h)):
        union |= lcs_words_rule(x, y)
    p, rc = len(union) / len(set(rwords(h))), len(union) / len(set(rwords(r)))
    return 2.0 * ((p * rc) / (p + rc + 1e-8))


@pytest.mark.parametrize("bits", [1 << 26, 0])
def test_lcs_words_follow_the_trace(monkeypatch, bits):
    """With all rows kept, and with the square root of them."""
    import random
    monkeypatch.setattr(S, "TRACE_BITS", bits)
    rng = random.Random(4)
    for _ in range(400):
        k = rng.choice([2, 4, 9])
        x, y = ([rng.randrange(k) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert S.lcs_words(x, y) == lcs_words_rule(x, y)


def test_rouge_l_union(spark):
    import random
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abcdef") + rng.choice([" ", " ", ". ", ".", "  "]) for _ in range(rng.randint(1, 60)))
    texts = [*PAIRS, ("a b a", "a a b"), ("a a b", "a b a"), ("x. . y", "y.x. "), *[(text(), text()) for _ in range(60)]]
    df = spark.createDataFrame([*[(i, h, r) for i, (h, r) in enumerate(texts)], (900, None, "a"), (901, "a", None), (902, "", "a"), (903, "...", "a")],
                               "id long, hyp string, ref string")
    got = {r.id: r.rouge_l for r in S.rouge_l(df, "hyp", "ref", union=True).collect()}
    for i, (h, r) in enumerate(texts):
        assert got[i] == pytest.approx(rouge_union_rule(h, r), abs=1e-12)
    assert got[len(PAIRS)] == pytest.approx(1.0, abs=1e-7)
    assert [got[i] for i in (900, 901, 902, 903)] == [None] * 4


def test_lcs_of_long_sentences_keeps_few_rows():
    """A dialogue of one sentence: 20,000 words on both sides."""
    import tracemalloc
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3000, 20000).tolist()
    y = [w for i, w in enumerate(x) if i % 5]
    tracemalloc.start()
    words = S.lcs_words(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == set(y) and peak < 20 << 20
