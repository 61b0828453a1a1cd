"""Helpers of the training-data operators against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import graph, mixing, ngram_join, packing, pii, spotsigs, suffix_dedup
from parley.llm import textvec as tv


def test_pieces_cover_all_rows_once():
    texts = ["", None, "ab", "x" * 5000, "é" * 10, "", "z"]
    col = pa.array(["pad", *texts]).slice(1)
    got = []
    for lo, hi, data, off in tv.pieces(col, 100):
        assert hi - lo == len(off) - 1
        got += [data[s:e].tobytes().decode() for s, e in zip(off, off[1:])]
    assert got == [t or "" for t in texts]
    assert list(tv.pieces(pa.array([], pa.string()))) == []


def test_word_spans_and_hashes():
    data = np.frombuffer(b"ab  cd ab\tcd\x0bx", np.uint8)
    off = np.array([0, 3, 10, len(data)])
    s, e, row = tv.word_spans(data, off)
    assert [data[a:b].tobytes() for a, b in zip(s, e)] == [b"ab", b"cd", b"ab", b"cd", b"x"]
    assert row.tolist() == [0, 1, 1, 2, 2]
    h = tv.span_hash(tv.prefix_hash(data), s, e)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, i) for i in range(501, 560)]
    edges += [(i, i + 1) for i in range(600, 640)] + [(7, 7), (1, 2), (1, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in edges:
        a, b = find(u), find(v)
        if u != v:
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long")
    got = {r.node: r.label for r in graph.components(df).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert graph.components(df.limit(0)).count() == 0


def test_component_rounds_have_small_plans(spark, monkeypatch):
    """A round once read its edges 16 times, in a plan that the driver held."""
    reads, store = [], graph.stored

    def counted(df, stem):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return store(df, stem)
    monkeypatch.setattr(graph, "stored", counted)
    graph.components(spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "u long, v long"))
    assert len(reads) >= 3 and max(reads[1:]) == 4


def test_language_model_is_fitted_without_a_list_of_ids(spark, monkeypatch):
    from parley.llm import langid
    monkeypatch.setattr(langid, "FIT_ROWS", 5)
    docs = spark.createDataFrame([(i % 9 if i % 10 else None, f"text {i} of words", "de" if i % 2 else "en") for i in range(40)],
                                 "doc_id long, text string, lang string")
    seen, fit = [], langid.TextModel.fit.__func__

    def noted(cls, texts, labels):
        seen.append((texts, labels))
        return fit(cls, texts, labels)
    monkeypatch.setattr(langid.TextModel, "fit", classmethod(noted))
    langid.fit_text_model(docs)
    texts, labels = seen[0]
    assert not isinstance(texts, list)
    order = docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").limit(5).collect()
    ids = {r.doc_id for r in order} - {None}
    want = [r.text for r in docs.collect() if r.doc_id in ids]
    assert set(texts.to_pylist()) <= set(want) and len(texts) == min(10, len(want)) == len(labels)


# --- suffix arrays ----------------------------------------------------------

@pytest.mark.parametrize("signs", [1, 2, 3, 30])
def test_suffix_array(signs):
    rng = np.random.default_rng(signs)
    for n in (1, 2, 7, 60, 400):
        for _ in range(5):
            t = np.r_[rng.integers(1, signs + 1, n), 0]
            assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_array_to_a_depth():
    t = np.r_[np.tile([3, 1, 2, 1], 200), 0]
    sa = suffix_dedup.suffix_array(t, 12)
    keys = [t[i:i + 12].tolist() for i in sa]
    assert keys == sorted(keys)


def test_window_minima_agree_on_equal_windows():
    data = np.frombuffer((b"abcdefgh ijkl mnop " * 9 + b"tail")[:160] * 2, np.uint8)
    off = np.array([0, 160, 320])
    m = suffix_dedup.window_minima(data, off, 50)
    assert (m[:111] == m[160:271]).all() and (m[:111] > 0).all()
    assert (m[111:160] == 0).all()


# --- signature trees --------------------------------------------------------

def _joined(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x
    for a, b in links:
        p[find(a)] = find(b)
    roots = [find(i) for i in range(n)]
    return {frozenset(i for i in range(n) if roots[i] == r) for r in roots}


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_signature_links_equal_brute_force(percent):
    rng = random.Random(percent)
    sets = []
    for _ in range(25):
        base = {rng.getrandbits(64) for _ in range(rng.randint(1, 120))}
        sets.append(base)
        for _ in range(rng.randint(0, 6)):
            near = set(rng.sample(sorted(base), max(1, len(base) - rng.randint(0, 15))))
            sets.append(near | {rng.getrandbits(64) for _ in range(rng.randint(0, 6))})
    brute = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    found = ngram_join.signature_links(arrays, percent)
    assert _joined(len(sets), found) == _joined(len(sets), brute)
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in brute}


def test_prefix_filter_keeps_every_linked_pair():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 60)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randint(max(1, int(n * .8)), n))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 5))}
        if a == b or 100 * len(a & b) < 85 * len(a | b):
            continue
        sent, one, need = ngram_join.prefix_lengths(np.array([len(a), len(b)]), 85)
        x, y = sorted(a), sorted(b)
        in_both = set(x[:sent[0]]) & set(y[:sent[1]])
        assert len(in_both) >= max(need), (len(a), len(b))
        assert set(x[:one[0]]) & set(y[:one[1]])


# --- packing ----------------------------------------------------------------

def test_level_array_picks_the_least_sum_of_squares():
    rng = random.Random(2)
    p = packing.LevelPacker(16)
    for _ in range(300):
        n = rng.randint(1, 15)
        before = p.count.copy()
        h = p.level_for(n)

        def after(level):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + n < 16:
                c[level + n] += 1
            return int((c[1:16] ** 2).sum())
        able = [x for x in range(16 - n + 1) if x == 0 or before[x]]
        assert h in able and after(h) == min(map(after, able))
        list(p.add("d", b"\0" * 4 * n))


def test_packer_keeps_every_token_and_pads_nothing():
    rng = random.Random(9)
    p = packing.LevelPacker(64, max_open=5)
    docs = [(i, np.arange(rng.choice([1, 3, 40, 64, 130, 500]), dtype="<u4").tobytes()) for i in range(120)]
    windows = [w for d, ids in docs for w in p.add(d, ids)] + list(p.flush())
    got = {}
    for w in windows:
        n = sum(len(x[2]) // 4 for x in w)
        assert n == 64 or n & (n - 1) == 0
        for d, s, ids, total in w:
            assert ids
            got.setdefault(d, []).append((s, ids))
    assert {d: b"".join(i for _, i in sorted(x)) for d, x in got.items()} == dict(docs)


# --- mixing -----------------------------------------------------------------

def test_permutation_is_one():
    for n in (1, 2, 3, 64, 65, 1000):
        for key in (0, 5):
            assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 1).tolist() != mixing.permute(np.arange(1000), 1000, 2).tolist()


def test_targets_stop_at_twice_and_share_all():
    t = mixing.targets([100, 10, 1000, 0], [3, 1, 2, 3])
    assert t[1] <= 20 and t[0] <= 200 and t[3] == 0 and sum(t) == pytest.approx(1.5 * 1110)
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]


def test_shard_counts_add_up():
    totals = (1000, 17, 0, 333)
    shards, of = mixing.shard_counts(totals, 64, 1)
    rows = [of(s) for s in range(shards)]
    assert [sum(c[i] for c, _ in rows) for i in range(4)] == list(totals)
    at = [0] * 4
    for c, first in rows:
        assert list(first) == at and sum(c) <= 64
        at = [a + x for a, x in zip(at, c)]


# --- personal data ----------------------------------------------------------

def test_base_patterns_equal_the_plain_ones():
    import re
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("aZ@@..09 1-+()_%\n25é") for _ in range(rng.randint(0, 60)))
        want = [("email", m.start(), m.end()) for m in email.finditer(t)]
        want += [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want += [("card", m.start(), m.end()) for m in card.finditer(t)
                 if 16 <= len(digits(m)) <= 19 and pii._luhn(digits(m))]
        want += [("phone", m.start(), m.end()) for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]
        assert pii.identifiers(t) == want, t
    assert pii.identifiers("4111 1111 1111 1111 x 4111-1111-1111-1112") == [("card", 0, 19)]


@pytest.mark.parametrize("text,span", [
    ("write ann [at] site [dot] org now", "ann [at] site [dot] org"),
    ("write ann(at)site(dot)org", "ann(at)site(dot)org"),
    ("mail bob at site dot example dot com please", "bob at site dot example dot com"),
    ("my аnn@site.org ok", "аnn@site.org"),
    ("call plus four nine one seven zero five five five one two three four", None),
    ("host one nine two dot one six eight dot one dot seven here", "one nine two dot one six eight dot one dot seven"),
    ("full-width １９２.168.0.1 and", "１９２.168.0.1"),
    ("hidden a​nn@si­te.org.", "a​nn@si­te.org"),
])
def test_disguises_map_back(text, span):
    base, more = pii.find(text)
    got = [text[s:e] for _, s, e in more]
    assert (span in got) if span else (more and more[0][0] == "phone" and text[more[0][1]:].startswith("plus"))
    for kind, s, e in more:
        assert not any(k == kind and a <= s and e <= b for k, a, b in base)


@pytest.mark.parametrize("address", ["eight dot eight dot eight dot eight", "one point one dot one, dot zero"])
def test_single_digit_parts_spelled_alone(address):
    text = f"the server is {address} today"
    assert pii.find(text) == ([], [("ip", 14, 14 + len(address))])


@pytest.mark.parametrize("kind,found", [
    ("email", "ann@example dot com"), ("email", "ann at example.com"), ("email", "ann [at] example dot com"),
    ("email", "ann at example dot se"), ("email", "john dot smith at example dot com"), ("email", "john dot smith@example.com"),
    ("email", "ann  at  example dot co.uk"), ("email", "ann@example dot museum"), ("email", "ann at example [dot] org"),
    ("phone", "plus four four 20 7946 0958"), ("phone", "+four four (0)20 7946 0958"),
    ("ip", "one nine two dot 168 dot one dot 7"), ("ip", "192 dot 168 dot 1 dot 7"), ("ip", "one nine 2.168 [dot] 1 point seven"),
])
def test_disguises_are_mixed(kind, found):
    text = f"now: {found}, please"
    assert (kind, 5, 5 + len(found)) in pii.find(text)[1]


def test_mixed_disguises_leave_prose():
    for text in ("He looked at me.Then two dots at the dot is 5 or 6.", "Sold at 3.50 or 4 point five, one 10 and two 2019 12.",
                 "see it at www.example.com now", "write ann@example.com dot matrix", "at the dot to the left"):
        assert pii.find(text)[1] == [], text
    spelled = "room 5 one nine two dot one six eight dot one dot seven"
    assert pii.find(spelled)[1] == [("ip", 7, len(spelled))]
    for piece in ("a dot ", "a at ", "a@b dot ", "one 5 ", "1 ", "5 - - ", "one.", "a at b dot c at ", "a\n at "):
        assert isinstance(pii.find(piece * 100_000), tuple)             # linear, or it would not end


def test_plain_prose_gains_nothing():
    assert pii.find("Look at the dot on the map at noon. One of two, three.") == ([], [])
    assert pii.find(None) == ([], []) and pii.find("") == ([], [])
    long = "a." * 200_000 + "9" * 200_000 + "@" * 1000
    assert pii.find(long)[1] == []


# --- fingerprints -----------------------------------------------------------

def test_signature_sets():
    a, b, c, d, e = spotsigs.signatures(pa.array(
        ["the cat sat on the mat by the door today", "The CAT sat on the mat by the door today", "", "???", "cat"]))
    assert (a == b).all() and len(a) == 3 and len(c) == 0 and len(d) == 1 and len(e) == 1
    assert (spotsigs.from_text(spotsigs.as_text(a)) == a).all()


def test_likeness_prunes_only_what_is_below():
    rng = random.Random(4)
    for _ in range(300):
        a = np.unique(np.array([rng.randrange(200) for _ in range(rng.randint(0, 150))], np.uint32))
        b = np.unique(np.r_[a[:rng.randint(0, 150)], np.array([rng.randrange(200) for _ in range(rng.randint(0, 60))], np.uint32)])
        real = len(set(a) & set(b)) / len(set(a) | set(b)) if len(a) or len(b) else 1.0
        assert spotsigs.likeness(a, b) == pytest.approx(real)
        pruned = spotsigs.likeness(a, b, 0.6)
        assert pruned == pytest.approx(real) if real >= 0.6 else pruned in (0.0, pytest.approx(real))
