"""The suffix stemmer, stemmed scores and the lexicon stage."""

import itertools
import random
import re

import duckdb
import pytest

from parley.functions import stem as ST
from parley.operators import scores as S

# Word and stem pairs of the published description, step by step, and of the extensions.
KNOWN = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness
callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti
electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic
gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption
adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize
bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil
died die dies die dying die spied spi enjoy enjoy by by say say news news succeed succeed geology geolog fully fulli
skies sky a a is is yes ye""".split()


def test_known_stems():
    assert {w: ST.porter(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2]))


def test_measure():
    for words, m in (("tr ee tree y by", 0), ("trouble oats trees ivy", 1), ("troubles private oaten orrery", 2)):
        assert {ST.measure(w) for w in words.split()} == {m}


def test_stemmer_equals_its_sql():
    """Column patterns in SQL against runs of consonants and vowels here."""
    from parley.plans.oracle_views import VIEWS
    import parley.plans  # noqa: F401
    rng = random.Random(1)
    ends = [a for a, _ in (*ST.STEP_2, *ST.STEP_3)] + [*ST.STEP_4, "ed", "ing", "eed", "ied", "ies", "s", "sses", "y", "e", "ll", "logi", ""]
    words = {"".join(rng.choice("aeioubcdlrstyzw") for _ in range(rng.randint(0, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ly"])
             for _ in range(6000)} | set(KNOWN) | set(ST.IRREGULAR)
    words = sorted(w for w in words if w and "yy" not in w)
    con = duckdb.connect()
    con.execute("CREATE TABLE vocabulary AS SELECT unnest(?) AS w", [words])
    names = ["stem_1a", "stem_1b", "stem_1c", "stem_2", "stem_3", "stem_4", "stem_5", "stems"]
    got = dict(con.execute("WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names) + " SELECT w, stem FROM stems").fetchall())
    assert got == {w: ST.porter(w) for w in words}


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_stemmed_rouge(spark):
    pairs = [("The cats were running happily", "a cat was run, happily"), ("adjustable relations", "adjusting relation relational"),
             ("its", "it"), ("x", "y"), ("one. two", "two one two")]
    df = spark.createDataFrame([*[(i, h, r) for i, (h, r) in enumerate(pairs)], (8, None, "a"), (9, "!", "a")], "id long, h string, r string")
    got = {r.id: r for r in S.rouge_clipped(df, ["id"], "h", "r", (1, "L"), ST.PorterStems(longer_than=3)).collect()}
    for i, texts in enumerate(pairs):
        h, r = ([ST.porter(w) if len(w) > 3 else w for w in re.sub("[^a-z0-9]+", " ", x.lower()).split()] for x in texts)
        common = sum(min(h.count(w), r.count(w)) for w in set(h))
        for n, m in ((1, common), ("L", lcs(h, r))):
            p, rc = m / len(h), m / len(r)
            assert got[i][f"rouge{n}_clipped"] == pytest.approx(2 * p * rc / (p + rc) if m else 0.0, abs=1e-12)
    assert got[8].rougeL_clipped is None and got[9].rougeL_clipped is None


def meteor_rule(h, r, groups, alpha=0.9, beta=3.0, gamma=0.5):
    """Walks both lists from their ends, stage by stage, over single tokens."""
    tok = re.compile(r'[^ \t\n\r\f.,;:!?()"]+|[.,;:!?()"]')
    hyp, ref = (list(enumerate(tok.findall(x.lower()))) for x in (h, r))
    hl, rl, match = len(hyp), len(ref), []

    def stage(same):
        for i in range(len(hyp))[::-1]:
            for j in range(len(ref))[::-1]:
                if same(hyp[i][1], ref[j][1]):
                    match.append((hyp.pop(i)[0], ref.pop(j)[0]))
                    break
    stage(lambda a, b: a == b)
    hyp[:], ref[:] = ([(i, ST.porter(w)) for i, w in x] for x in (hyp, ref))
    stage(lambda a, b: a == b)
    stage(lambda a, b: bool(groups.get(a, set()) & groups.get(b, set())))
    match.sort()
    m = len(match)
    if not m:
        return 0.0
    chunks = 1 + sum(1 for a, b in zip(match, match[1:]) if (b[0], b[1]) != (a[0] + 1, a[1] + 1))
    p, rc = m / hl, m / rl
    return (1 - gamma * (chunks / m) ** beta) * p * rc / (alpha * p + (1 - alpha) * rc)


def test_lexicon_stage_equals_brute_force(spark):
    """Words in up to three groups, repeated words, words in no group."""
    rng = random.Random(6)
    words = [f"{c}word{k}" for c in "abc" for k in range(5)] + ["runs", "running", "cats", "cat"]
    lex = [(ST.porter(w), f"g{g}") for w in words[:-3] for g in rng.sample(range(6), rng.randint(0, 3))]
    groups: dict = {}
    for w, g in lex:
        groups.setdefault(w, set()).add(g)
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
    rows = [(i, "m", text(), text()) for i in range(80)]
    df = spark.createDataFrame([*rows, (90, "m", None, "x"), (91, "m", "", "x")], "id long, m string, h string, r string")
    table = spark.createDataFrame([*lex, lex[0]], "word string, group string")
    got = {r.id: r.meteor for r in S.meteor(df, ["id", "m"], "h", "r", stems=ST.PorterStems(), lexicon=table).collect()}
    assert len(got) == 82 and got[90] is None and got[91] is None
    for i, _, h, r in rows:
        assert got[i] == pytest.approx(meteor_rule(h, r, groups), abs=1e-12)
    none = S.meteor(df, ["id", "m"], "h", "r", stems=ST.PorterStems(), lexicon=table.limit(0)).collect()
    assert {r.id: r.meteor for r in none}[0] == pytest.approx(meteor_rule(*rows[0][2:], {}), abs=1e-12)
