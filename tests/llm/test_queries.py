"""Operators and queries against brute force on small tables, with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing
columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import langid, mixing, ngram_join, packing, pii, spotsigs, suffix_dedup, token_rollup, topk, warc
from parley.llm.queries import QUERIES, tokenizer
from parley.session import fresh_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, bucket int, piece string, size int, label string"


def odd_rows():
    rng = random.Random(11)
    words = ["the", "a", "der", "le"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows = text(30), []
    for i in range(60):
        t = text(rng.randint(1, 160))
        if i % 4 == 0:
            t += "\n" + passage + ". " + text(20)
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None])))
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(0, 60, 5)]                 # copies
    for i in range(0, 60, 3):                                                            # near copies
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s3"))
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, "  \n ", "en", "s2"), (303, "one two", "en", "s4"),
             (304, "One  TWO", "en", "s4"), (305, "é" * 70 + " ü", "fr", "s4"), (306, "a" * 500, "en", "s4"),
             (307, "a" * 300 + "b", "en", "s4"), (308, text(6000), "en", "s1"), (None, rows[0][1], "en", "s1"),
             (5, rows[5][1], "en", "s1"), (5, rows[6][1] + " x", "en", "s2"), (309, "mail ann [at] x [dot] org 10.0.0.1", "en", "s1")]
    rng.shuffle(rows)
    return [(d, t, la, s, None if t is None else len(t), 7, "p", 3, "l") for d, t, la, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    path = fresh_path(spark, "odd")
    spark.createDataFrame(odd_rows(), DDL).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 1 ----------------------------------------------------------------------

def _brute_top(rows, k=5, every=50):
    x = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            x.setdefault(i, []).append([int(np.floor(256 * float(np.float32(c)))) for c in v])
    out = []
    for q in sorted(x):
        if q % every == 0:
            own = min(x[q])
            sc = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, vs in x.items() if i != q for v in vs if len(v) == len(own))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sc[:k])]
    return sorted(out, key=str)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in np.round(rng.normal(size=6) * (5 if i % 9 else 0.1), 1)]) for i in range(400)]
    rows += [(401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6),
             (405, rows[3][1]), (406, rows[3][1]), (3, rows[3][1]), (450, []), (500, [0.0] * 6), (501, []), (550, [1.0, 2.0]), (600, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as dist", "2 as shard")
    is_q = F.col("vec_id") % 50 == 0
    want = _brute_top(rows)
    assert collect(topk.top_k(df, is_q, 5)) == want
    assert collect(topk.top_k(df, is_q, 5, shard_rows=40, query_group=3, n_pivots=4)) == want
    assert topk.top_k(df.limit(0), is_q, 5).count() == 0


# --- 2 ----------------------------------------------------------------------

def test_fingerprint_query(spark, odd):
    got = [r.asDict() for r in spotsigs.fingerprints(odd).collect()]
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert len(got) == len(rows)
    rows.sort(key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    want, prints = Counter(), defaultdict(set)
    for i, (d, t) in enumerate(rows):
        new = spotsigs.edited(t, rows[(i + 1) % len(rows)][1])
        want[(d, len(t), hashlib.sha256(new.encode()).hexdigest())] += 1
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got) == want
    for g in got:
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for g in got:
        if len(texts[g["doc_id"]]) == 1:
            prints[texts[g["doc_id"]][0]].add(g["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert spotsigs.fingerprints(odd.limit(0)).count() == 0
    one = spotsigs.fingerprints(odd.where("doc_id = 308")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_near_classes(spark, odd):
    prints = spotsigs.fingerprints(odd.where("doc_id is not null and doc_id <> 5")).select("doc_id", "fingerprint")
    sets = {r.doc_id: set(spotsigs.from_text(r.fingerprint).tolist()) for r in prints.collect()}
    ids = sorted(sets)
    label = {i: i for i in ids}
    change = True
    while change:
        change = False
        for a in ids:
            for b in ids:
                u = len(sets[a] | sets[b])
                if label[a] != label[b] and (u == 0 or len(sets[a] & sets[b]) >= 0.8 * u):
                    label[a] = label[b] = min(label[a], label[b])
                    change = True
    assert {r.doc_id: r.class_id for r in spotsigs.near_classes(prints).collect()} == label


# --- 3 ----------------------------------------------------------------------

def check_pieces(docs, pieces, tok):
    """Every id of every document in one piece; windows full or powers of
    two, gapless."""
    from tokenizers import Tokenizer
    enc = Tokenizer.from_file(tok)
    want = Counter()
    for d, t in docs:
        want[(d, np.array(enc.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], p["doc_tokens"], bytes(p["ids"])))
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    one = {d: k for (d, _), k in want.items()}
    for d, x in by_doc.items():
        if one[d] == 1 and sum(k for (e, _), k in want.items() if e == d) == 1:
            ids = b"".join(i for _, _, i in sorted(x))
            assert (d, ids) in want and all(n == len(ids) // 4 for _, n, _ in x)
    assert sum(p["length"] for p in pieces) == sum(len(i) // 4 * k for (_, i), k in want.items())


def test_packing(spark, odd):
    rows = odd.union(spark.createDataFrame(
        [(900, "Ünï <|endoftext|> 'll x\x1cy Á Σας 漢字   ok", None, None, 1, 1, "", 1, "")], DDL))
    pieces = [r.asDict() for r in packing.pack(rows, tokenizer()).collect()]
    check_pieces([(r.doc_id, r.text) for r in rows.collect()], pieces, tokenizer())
    assert packing.pack(odd.limit(0), tokenizer()).count() == 0


def test_packing_query(spark):
    got = QUERIES["op3_pack"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.select("doc_id").distinct().count() == docs.count()
    fill = got.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] == 2048 or r[1] & (r[1] - 1) == 0 for r in fill)


# --- 4 ----------------------------------------------------------------------

def check_mix(rows, docs):
    sizes = Counter()
    for d, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    t = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    src = defaultdict(list)
    for d, x, s in docs:
        src[(d, len(WORD.findall(x or "")))].append(s)
    took = Counter()
    assert len(rows) == len(docs)
    for r in rows:
        ss = src[(r["doc_id"], r["size"])]
        assert any(sizes[s] == r["source_size"] and abs(t[s] - r["target"]) < 1e-6 for s in ss)
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for s in order:
        mine = [x for x in order if (sizes[x], round(t[x], 6)) == (sizes[s], round(t[s], 6))]
        assert abs(took[(sizes[s], round(t[s], 6))] - sum(t[x] for x in mine)) <= 64 * len(mine) + 0.01 * sizes[s]


def test_mixing(spark, odd):
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    a = [r.asDict() for r in mixing.taken(odd).collect()]
    check_mix(a, docs)
    b = [r.asDict() for r in mixing.taken(odd.repartition(5)).collect()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert mixing.taken(odd.limit(0)).count() == 0


def test_mixing_brute_force(spark, odd):
    """Blocks laid out, drawn and taken again, one by one."""
    placed, mixed = mixing.mix_documents(odd, block_words=8)
    placed = placed.collect()
    sources = sorted({(r.sid, r.source_size) for r in placed})
    line = {sid: [] for sid, _ in sources}
    for r in sorted(placed, key=lambda r: (r.sid, r.start)):
        assert r.start == len(line[r.sid]) or r["size"] == 0
        line[r.sid] += [(r.doc_id, r.start)] * r["size"]
    got = Counter()
    for r in mixed.collect():
        for _ in range(r["last"] - r["first"]):
            got[(r.sid, r.doc_id, r.start)] += 1
    t = {r.sid: r.target for r in placed}
    slots = []
    for sid, size in sources:
        blocks = -(-size // 8)
        slots.append(min(2 * blocks, round(t[sid] * blocks / size)) if size else 0)
    want = Counter()
    for (sid, size), n in zip(sources, slots):
        blocks = -(-size // 8)
        for p in range(2):
            k = max(0, min(blocks, n - p * blocks))
            for b in mixing.permute(np.arange(blocks), blocks, (mixing.SEED * 1_000_003 + sid) * 7 + p)[:k] if blocks else []:
                for d in line[sid][8 * b:8 * b + 8]:
                    want[(sid, *d)] += 1
    assert got == want


def test_mixed_documents_hold_what_was_taken(spark, odd):
    words = Counter()
    for r in mixing.taken(odd).collect():
        words[r.doc_id] += r.taken
    got = Counter()
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert +got == +words


# --- 5 ----------------------------------------------------------------------

def test_revisits(spark):
    h = {"server": "s", "etag": '"a"'}
    rows = [
        (1, "http://X.org:80/p/?b=2&a=1#f", 10, 200, '"a"', "m1", h, "d1"),
        (2, "HTTP://x.org/p?a=1&utm_source=q&b=2", 20, 304, 'W/"a"', None, {"etag": 'W/"a"', "server": "no", "age": None}, None),
        (3, "http://x.org/p?a=1&b=2", 30, 304, '"z"', "m1", {}, None),
        (4, "http://x.org/p?a=1&b=2", 31, 304, None, "m1", None, None),
        (5, "http://x.org/p?a=1&b=2", 32, 304, None, "m2", None, None),
        (6, "http://x.org/p?a=1&b=2", 33, 304, None, None, None, None),
        (7, "http://x.org/p?a=1&b=2", 10, 304, '"a"', None, None, None),      # same time is not earlier
        (8, "http://x.org/p?a=1&b=2", 10, 200, '"a"', "m9", None, "d8"),     # tie: larger id counts
        (9, None, 40, 304, '"a"', None, None, None), (10, "http://x.org/p?a=1&b=2", None, 304, '"a"', None, None, None),
        (11, "", 41, 304, None, None, None, None), (12, "http://other.org", 41, 304, '"a"', None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified string, "
                                     "headers map<string,string>, payload_digest string").selectExpr("*", "1 as tb", "2 as near")
    for n in (1, 4, 256):
        got = {r.record_id: r for r in warc.resolve(df, n).collect()}
        assert {k: v.outcome for k, v in got.items()} == {
            2: "resolved", 3: "etag_mismatch", 4: "modified_mismatch", 5: "modified_mismatch", 6: "no_validator",
            7: "no_earlier", 9: "no_earlier", 10: "no_earlier", 11: "no_earlier", 12: "no_earlier"}
        assert got[2].refers_to == 8 and got[2].payload_digest == "d8" and got[2].headers == {"etag": 'W/"a"'}
    only = df.where("record_id in (1, 2, 4)")
    got = {r.record_id: r for r in warc.resolve(only).collect()}
    assert got[4].outcome == "resolved" and got[4].headers == h
    assert got[2].headers == {"server": "s", "etag": 'W/"a"'}
    assert warc.resolve(df.limit(0)).count() == 0


# --- 6 ----------------------------------------------------------------------

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(t, n):
    w = WORD.findall((t or "").encode().translate(_LOWER).decode())
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, percent, with_group=False):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), s in zip(rows, label):
        if d is not None:
            least[s] = min(least.get(s, d), d)
    out = [(d, len(x), least.get(s), s) for (d, _), x, s in zip(rows, sets, label)]
    return sorted(out if with_group else [x[:3] for x in out], key=str)


@pytest.mark.parametrize("n,percent,task", [(4, 85, ngram_join.TASK_SHINGLES), (5, 80, 100)])
def test_ngram_join(spark, odd, n, percent, task):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = collect(ngram_join.classes(odd, n, percent, task).drop("set_name"))
    assert got == brute_components(rows, n, percent)


def test_ngram_join_dense_group(spark):
    """Variants of one text and texts sharing passages, in many tasks."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(90)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(90)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    for i in range(70, 110):
        rows.append((i, " ".join(base[:40] + [rng.choice(words) for _ in range(rng.randint(20, 60))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for task in (10 ** 6, 300):
        assert collect(ngram_join.classes(df, 4, 85, task).drop("set_name")) == brute_components(rows, 4, 85)


def test_keep_one(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    comp = brute_components(rows, 5, 80, True)
    out = ngram_join.keep_one(odd, 5, 80)
    assert out.columns == odd.columns
    got = Counter(r.doc_id for r in out.collect())
    groups = {(g, c) for _, n, c, g in comp if n}
    assert got == Counter(c for _, c in groups) + Counter(d for d, n, _, _ in comp if n == 0)
    assert ngram_join.classes(odd.limit(0), 4, 85).count() == 0


# --- 7 ----------------------------------------------------------------------

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_text_model(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 and n_chars > 20")
    got = langid.identify(langid.from_documents(held), model).selectExpr("row_id as doc_id", "lang as found")
    n, right = held.join(got, "doc_id").selectExpr("count(*)", "sum(int(lang = found))").first()
    assert right >= 0.97 * n


def test_evidence_is_fused(spark):
    model = langid.TextModel.fit(["the cat and the dog went home " * 50, "le chat et le chien sont ici " * 50], ["en", "fr"])
    rows = [(i, "the cat and the dog", "a.org", "a.org", "org", "en") for i in range(40)]
    rows += [(100 + i, "le chien et le chat", "b.fr", "b.fr", "fr", "fr") for i in range(40)]
    rows += [(200, "xx", "a.org", "a.org", "org", "en"), (201, "xx", "b.fr", "b.fr", "fr", "fr"), (202, None, None, None, None, None),
             (203, "1234 !!", "a.org", None, None, None), (204, "", "b.fr", "b.fr", "fr", "fr"), (0, "the cat and the dog", "a.org", "a.org", "org", "en"),
             (205, "the dog", None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, text string, host string, domain string, suffix string, declared string")
    got = {r.row_id: r for r in langid.identify(df, model).collect()}
    assert got[200].lang == "en" and got[201].lang == "fr" and got[205].lang == "en"
    assert all(got[i].lang == "und" and got[i].rejected for i in (202, 203, 204))
    assert all(got[i].lang == ("en" if i < 100 else "fr") and not got[i].rejected for i in (*range(40), *range(100, 140)))
    assert langid.identify(df.limit(0), model).count() == 0
    empty = langid.TextModel.fit([], [])
    assert {r.lang for r in langid.identify(df, empty).collect()} == {"und"}


def test_addresses_and_markup(spark):
    df = spark.createDataFrame([(1, "https://u@News.Example.co:8/x?y", '<!doctype html><HTML class=a lang="FR-ca"><script>var a="<b>";</script><p>Bon&nbsp;jour</p>'),
                                (2, None, None), (3, "nohost", "<p>x")], "page_id long, url string, html string")
    got = {r.row_id: r for r in langid.from_pages(df).collect()}
    assert (got[1].host, got[1].domain, got[1].suffix, got[1].declared) == ("news.example.co", "example.co", "co", "fr")
    assert got[1].text.split() == ["Bon", "jour"] and got[2].host is None and got[3].host is None and got[3].declared is None


def test_language_stage_keeps_clean_rows(spark, odd):
    out = langid.keep_identified(odd.where("lang is not null or text is null or text = ''"))
    assert out.columns == odd.columns
    ids = {r.doc_id for r in out.collect()}
    assert not ids & {300, 301, 302} and 308 in ids and len(ids) > 60
    # ids that are not long, and columns of the key's names, change nothing
    for kind in ("int", "string"):
        other = odd.where("lang is not null or text is null or text = ''").withColumn("doc_id", F.col("doc_id").cast(kind)) \
            .withColumnRenamed("bucket", "key_a")
        assert {None if r.doc_id is None else int(r.doc_id) for r in langid.keep_identified(other).collect()} == ids


def test_language_query(spark):
    got = QUERIES["op7_language_id"](spark, SF)
    assert got.where("doc_id is not null").count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("page_id is not null").count() == spark.read.parquet(f"{SF}/pages.parquet").count()


# --- 8 ----------------------------------------------------------------------

def brute_repeats(rows, length=50):
    seen, out = set(), []
    order = sorted(rows, key=lambda r: suffix_dedup.LAST_ID if r[0] is None else r[0])
    i = 0
    while i < len(order):
        same = [r for r in order[i:] if r[0] == order[i][0]]
        i += len(same)
        new = set()
        for d, t in same:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                if b[k:k + length] in seen:
                    gone[k:k + length] = True
                new.add(b[k:k + length])
            kept = bytes(c for c, g in zip(b, gone) if not g)
            runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0))
            out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        seen |= new
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1024, 0])
def test_repeats(spark, odd, hot):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((*r[:5], bytes(r[5])) for r in suffix_dedup.remove_repeats(odd, 50, True, hot).collect()), key=str)
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert collect(QUERIES["op8_suffix_dedup"](spark, SF)) == [
        x[:5] for x in brute_repeats([(r.doc_id, r.text) for r in docs])]


# --- 9 ----------------------------------------------------------------------

def test_personal_data_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op9_pii"](spark, SF).collect():
        base, more = pii.find(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert r.spans == pii.digest(base + more) and r.n_added == len(more)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]


def test_masking(spark, odd):
    out = pii.mask(odd)
    assert out.columns == odd.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[309] == "mail <EMAIL> <IP>" and got[300] is None and got[301] == ""
    assert pii.spans(odd.limit(0)).count() == 0 and pii.spans(odd).where("doc_id = 300").first().spans == ""


# --- 10 ---------------------------------------------------------------------

def test_rollup_is_idempotent(spark):
    ddl = "source string, lang string, tokenizer string, op string, old_tokens long, new_tokens long"
    one = spark.createDataFrame([("a", "en", "t", "insert", None, 5), ("a", "en", "t", "insert", None, 7),
                                 (None, None, "t", "insert", None, None), ("a", "en", "t", "insert", None, 5)], ddl)
    two = spark.createDataFrame([("a", "en", "t", "revise", 5, 6), ("a", "en", "t", "delete", 7, None)], ddl)
    r = token_rollup.Rollup(spark, fresh_path(spark, "r"))
    assert r.totals().count() == 0
    want = [("a", "en", "t", 2, 11), (None, None, "t", 1, 0)]
    r.commit("1", one)
    r.commit("1", one)
    r.commit("2", two)
    r.commit("3", two.limit(0))
    assert collect(r.totals()) == sorted(want, key=str)
    r.compact()
    r.commit("2", two)
    assert collect(r.totals()) == sorted(want, key=str)
    r.commit("4", spark.createDataFrame([(None, None, "t", "delete", 0, None)], ddl))
    r.compact()
    assert collect(r.totals(drop_empty=True)) == [("a", "en", "t", 2, 11)]
    with pytest.raises(ValueError):
        r.commit("../x", one)


def test_rollup_outlives_its_object(spark):
    ddl = "source string, lang string, tokenizer string, op string, old_tokens long, new_tokens long"
    row = lambda n: spark.createDataFrame([("a", "en", "t", "insert", None, n)], ddl)
    path = fresh_path(spark, "r")
    again = lambda: token_rollup.Rollup(spark, path)
    totals = lambda: [tuple(x)[3:] for x in again().totals().collect()]
    first = again()
    first.commit("1", row(5))
    assert totals() == [(1, 5)]
    again().commit("2", row(7))
    again().commit("1", row(6))                         # replaced by another run
    assert totals() == [(2, 13)] and [tuple(x)[3:] for x in first.totals().collect()] == [(2, 13)]
    again().compact()
    again().commit("2", row(7))                         # replayed after folding
    first.commit("1", row(6))
    assert totals() == [(2, 13)]
    again().commit("3", row(1))
    assert totals() == [(3, 14)]
    first.compact()
    again().compact()
    again().commit("1", row(6))
    assert totals() == [(3, 14)]
