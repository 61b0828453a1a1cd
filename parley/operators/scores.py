"""Summary quality scores (J): each is a Spark job over the pair table.

Definitions (written contract; see README):
* ROUGE-N (set form): words = text cut at '.', whitespace collapsed; the
  n-grams of the concatenated words as sets H (generated) and R
  (reference); P=|H&R|/|H|, R=|H&R|/|R| (0 for an empty side),
  F=2PR/(P+R+1e-8). NULL when either text is NULL or has no words.
* ROUGE-L: L = LCS of the same word lists; P=L/|hyp|, R=L/|ref|, F as above.
  ``union``: the summary level. Sentences are the pieces between dots; for
  each reference and generated sentence one LCS is read off from the ends
  (equal last words belong to it; else the reference's last word goes if
  without it the LCS is longer than without the other's, else the other's).
  L = distinct words of all these, P=L/distinct generated words, R=L/distinct
  reference words.
* ROUGE with clipped counts: lower case, [^a-z0-9] separates tokens,
  optional stems; overlap = sum of min(count_h, count_r) per n-gram; "L":
  overlap = LCS of the tokens. NULL when either text is NULL or has no
  tokens; METEOR likewise.
* METEOR: lower-case word/punctuation tokens; stages exact -> stem ->
  synonym (rules or tables given as input); within a stage the k-th occurrence from
  the end in the hypothesis pairs with the k-th from the end in the
  reference; chunks are runs adjacent in both texts. With a lexicon (word,
  group; a word may be in many groups) two forms match if they share one:
  the hypothesis is walked from its end and takes the last free match.
* BERTScore: see ``parley.operators.bertscore``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import arrow as A
from parley.functions.arrow import once
from parley.functions.stem import PorterStems
from parley.functions.text import meteor_tokens, ngrams, rouge_words, score_tokens
from parley.operators.bertscore import SCORES as BERT_SCORES
from parley.operators.bertscore import bert_score, score_texts
from parley.operators.shaping import SALTS
from parley.session import stored
from parley.schemas import METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA


def _f(p: Column, r: Column) -> Column:
    return F.lit(2.0) * ((p * r) / (p + r + F.lit(1e-8)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _with_words(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Word arrays as columns, computed once per row (Catalyst keeps a
    projection of an expensive expression that is referenced twice)."""
    return df.withColumns({"_hw": rouge_words(F.col(hyp)), "_rw": rouge_words(F.col(ref))})


def _null_if(hyp: str, ref: str) -> Column:
    return (F.col(hyp).isNull() | F.col(ref).isNull() | (F.size("_hw") == 0) | (F.size("_rw") == 0))


def rouge_n(df: DataFrame, hyp: str, ref: str, orders=(1, 2), native: bool = True) -> DataFrame:
    """Adds rouge_<n> columns (J-1); no shuffle, and no Python if ``native``
    (else the sets are made in Arrow batches: fewer CPU seconds).

    Each intermediate (n-gram sets, overlap size) is its own column, so
    every array expression runs once per row: higher-order functions get
    no common-subexpression elimination."""
    if not native:
        return _rouge(df, hyp, ref, tuple(orders), None)
    w = _with_words(df, hyp, ref)
    tmp = ["_hw", "_rw"]
    for n in orders:
        w = w.withColumns({f"_h{n}": F.array_distinct(ngrams(F.col("_hw"), n)),
                           f"_r{n}": F.array_distinct(ngrams(F.col("_rw"), n))})
        w = w.withColumns({f"_o{n}": F.size(F.array_intersect(f"_h{n}", f"_r{n}")),
                           f"_nh{n}": F.size(f"_h{n}"), f"_nr{n}": F.size(f"_r{n}")})
        p, r = _ratio(F.col(f"_o{n}"), F.col(f"_nh{n}")), _ratio(F.col(f"_o{n}"), F.col(f"_nr{n}"))
        w = w.withColumn(f"rouge_{n}", F.when(_null_if(hyp, ref), F.lit(None).cast("double")).otherwise(_f(p, r)))
        tmp += [f"_h{n}", f"_r{n}", f"_o{n}", f"_nh{n}", f"_nr{n}"]
    return w.drop(*tmp)


def _lcs(a, b) -> int:
    """LCS length, bit-parallel (Allison-Dix / Hyyro): one bit per token of
    the shorter side, a few integer operations per token of the longer."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        m = masks.get(w)
        if m is None:
            continue
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


#: Bits of LCS rows that a trace keeps: rows in between are computed again.
TRACE_BITS = 1 << 26


def lcs_words(ref: list, hyp: list) -> set:
    """Words of the LCS that is read off from the ends of both lists.

    Row i has bit j set where the LCS of i reference words grows with the
    generated word j, which is all a trace asks for. Of a long pair only
    every k-th row is kept and the k rows above it are computed again when
    the trace gets there, so memory grows with the square root of the
    rows."""
    if not ref or not hyp:
        return set()
    masks: dict = {}
    for j, w in enumerate(hyp):
        masks[w] = masks.get(w, 0) | (1 << j)
    n, full = len(hyp), (1 << len(hyp)) - 1

    def rows(v: int, lo: int, hi: int) -> list[int]:
        """Rows lo .. hi, from row lo."""
        out = [v]
        for w in ref[lo:hi]:
            u = v & masks.get(w, 0)
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    step = len(ref) if len(ref) * n <= TRACE_BITS else max(1, int(len(ref) ** 0.5))
    kept = [full]
    for lo in range(0, max(0, len(ref) - step), step):
        kept.append(rows(kept[-1], lo, lo + step)[-1])
    out, j = set(), n
    for block in range(len(kept) - 1, -1, -1):
        lo = block * step
        hi = min(lo + step, len(ref))
        if not j or hi <= lo:
            continue
        mine = rows(kept[block], lo, hi)
        i = hi
        while i > lo and j:
            if ref[i - 1] == hyp[j - 1]:
                out.add(ref[i - 1])
                i, j = i - 1, j - 1
            elif mine[i - lo] >> (j - 1) & 1:       # the last word adds nothing: leave it
                j -= 1
            else:
                i -= 1
    return out


def union_lcs_words(hyp: list[list], ref: list[list]) -> int:
    """Distinct words of the LCSs of all pairs of sentences. A pair whose
    common words are all there already can add none and is passed over; of
    a sentence's pairs, those with most open words come first."""
    at: dict = {}
    sets = [set(s) for s in hyp]
    for k, s in enumerate(sets):
        for w in s:
            at.setdefault(w, []).append(k)
    found: set = set()
    for s in ref:
        own = at.keys() & s
        open_ = own - found
        if not open_:
            continue
        for k, _ in Counter(chain.from_iterable([at[w] for w in open_])).most_common():
            if not open_.isdisjoint(sets[k]):
                both = own & sets[k]
                # one common word, or all of them in one order: they are the LCS
                if len(both) == 1 or [w for w in s if w in both] == [w for w in hyp[k] if w in both]:
                    found |= both
                else:
                    found |= lcs_words(s, hyp[k])
                open_ -= found
                if not open_:
                    break
    return len(found)


def rouge_l(df: DataFrame, hyp: str, ref: str, union: bool = False, orders: tuple = ()) -> DataFrame:
    """Adds rouge_l (J-2), with ``union`` at summary level, and rouge_<n>
    (J-1) of ``orders`` from the same pass over the words. Words, LCS and
    n-gram sets are the one Python step (rows stream through in Arrow
    batches); the F formulas stay native."""
    return _rouge(df, hyp, ref, tuple(orders), "union" if union else "whole")


def _rouge(df: DataFrame, hyp: str, ref: str, orders: tuple, lcs: str | None) -> DataFrame:
    names = [f"_{side}{n}" for n in orders for side in "ohr"] + (["_lcs", "_nh", "_nr"] if lcs else [])

    def grams(w):
        return [set(w) if n == 1 else set(zip(*[w[k:] for k in range(n)])) for n in orders]

    def of_text(text):
        parts = A.sentences(text)
        w = [x for s in parts for x in s]
        return parts, w, grams(w)

    def counts(cols):
        out, of_ref, null = [], once(of_text), [None] * len(names)
        for h, r in zip(*map(A.utf8, cols)):
            if not h or not r:
                out.append(null)
                continue
            (hs, hw, hg), (rs, rw, rg) = of_text(h), of_ref(r)
            if not hw or not rw:
                out.append(null)
                continue
            row = [x for a, b in zip(hg, rg) for x in (len(a & b), len(a), len(b))]
            if lcs == "union":
                row += [union_lcs_words(hs, rs), len(set(hw)), len(set(rw))]
            elif lcs:
                row += [_lcs(hw, rw), len(hw), len(rw)]
            out.append(row)
        return [pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * len(names)

    w = A.with_columns(df.withColumns({"_hw": F.col(hyp), "_rw": F.col(ref)}), ["_hw", "_rw"],
                       ", ".join(f"{c} int" for c in names), counts)
    score = lambda o, h, r: F.when(F.col(o).isNotNull(), _f(_ratio(F.col(o), F.col(h)), _ratio(F.col(o), F.col(r))))
    w = w.withColumns({f"rouge_{n}": score(f"_o{n}", f"_h{n}", f"_r{n}") for n in orders})
    return (w.withColumn("rouge_l", score("_lcs", "_nh", "_nr")) if lcs else w).drop(*names)


def _grams(tokens: list, n: int):
    return tokens if n == 1 else zip(*[tokens[k:] for k in range(n)])


def _gram_counts(tokens: list, orders: tuple) -> dict:
    return {n: Counter(_grams(tokens, n)) for n in orders if n != "L"}


def _overlap(a: list, b: list, n, of_b: dict) -> int:
    """Sum of min(count in a, count in b) over the n-grams, given those of
    b by order (``_gram_counts``); for "L" the LCS."""
    if n == "L":
        return _lcs(a, b)
    free, found = dict(of_b[n]), 0
    for g in _grams(a, n):
        left = free.get(g)
        if left:
            free[g] = left - 1
            found += 1
    return found


def _in_python(stems) -> bool:
    """Tokens are made and mapped in Python unless their forms come from a
    rule on columns or from a table."""
    return stems is None or hasattr(stems, "of_tokens")


def _mapped(base: DataFrame, key: list[str], table: DataFrame | Callable[[Column], Column],
            src: str, dst: str, cols: dict[str, str]) -> DataFrame:
    """Adds token arrays (``cols``: input array -> new array) with every token
    replaced by its form, or kept where it has none.

    ``table`` is a rule (Column -> Column) or a stemmer of token arrays,
    applied in the row, or a table with one form per word. A table is joined by (word, salt): its rows are
    repeated per salt, so a frequent word is never one task's work."""
    if hasattr(table, "on_tokens"):
        again = base.withColumns({f"{a}_in": F.col(a) for a in cols})
        def stems(arrays):
            return [pa.array([None if x is None else table.of_words(x) for x in A.lists(c)], pa.list_(pa.string())) for c in arrays]
        return A.with_columns(again, [f"{a}_in" for a in cols], ", ".join(f"{b} array<string>" for b in cols.values()), stems)
    if callable(table):
        return base.withColumns({b: F.transform(F.col(a), table) for a, b in cols.items()})
    words = table.select(F.col(src).alias("token"), F.col(dst).alias("_to"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))

    def tag(side: str):
        return lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), t.alias("token"))

    items = [F.transform(F.coalesce(F.col(a), F.array().cast("array<string>")), tag(b)) for a, b in cols.items()]
    toks = base.select(*key, F.explode(F.concat(*items)).alias("t")).select(*key, "t.*")
    toks = toks.withColumn("_salt", F.pmod(F.xxhash64(*key, "pos"), F.lit(SALTS)).cast("int"))
    form = F.struct("pos", F.coalesce("_to", "token").alias("form"))
    forms = (toks.join(words, ["token", "_salt"], "left").groupBy(*key)
             .agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == b, form))),
                                lambda x: x["form"]).alias(b) for b in cols.values()]))
    return base.join(forms, key, "left")


def rouge_clipped(df: DataFrame, key: list[str], hyp: str, ref: str, orders=(1,),
                  stems: DataFrame | Callable[[Column], Column] | PorterStems | None = None) -> DataFrame:
    """ROUGE-N with clipped counts (J-3) for every order in ``orders``, and
    ROUGE-L of the same tokens for "L": columns ``rouge<n>_clipped``.

    Both token lists of a pair are in its row; one Arrow UDF counts the
    overlaps of all orders, so nothing is shuffled. ``stems`` maps tokens
    before n-grams form: a rule on columns, ``PorterStems`` (its
    ``longer_than`` is 3 in the package whose scores these are), or a table
    (word, stem). NULL where a text is NULL or has no tokens."""
    orders = (orders,) if isinstance(orders, (int, str)) else tuple(orders)
    raw = _in_python(stems)
    stemmer = stems if raw else None            # functions of tasks must hold no DataFrame
    if raw:
        base, forms = df.select(*key, F.lower(hyp).alias("_ht"), F.lower(ref).alias("_rt")), ["_ht", "_rt"]
    else:
        base = df.select(*key, score_tokens(F.col(hyp)).alias("_ht"), score_tokens(F.col(ref)).alias("_rt"))
        base = _mapped(base, key, stems, "word", "stem", {"_ht": "_hs", "_rt": "_rs"}).drop("_ht", "_rt")
        forms = ["_hs", "_rs"]

    def counts(cols):
        def tokens(text):
            found = A.score_tokens(text)
            return stemmer.of_tokens(found) if stemmer is not None else found
        sides = [A.utf8(c) if raw else A.lists(c) for c in cols]
        def counted(x):
            found = tokens(x) if raw else x
            return found, _gram_counts(found, orders)
        of_ref, out = once(counted), []
        for h, r in zip(*sides):
            if h is None or r is None:
                out.append((None, None, None))
                continue
            h, (r, of_r) = tokens(h) if raw else h, of_ref(r)
            out.append(([_overlap(h, r, n, of_r) for n in orders], len(h), len(r)))
        o, hl, rl = zip(*out) if out else ((), (), ())
        return [pa.array(o, pa.list_(pa.int32())), pa.array(hl, pa.int32()), pa.array(rl, pa.int32())]

    w = A.with_columns(base, forms, "_o array<int>, _hl int, _rl int", counts)
    out = {}
    for i, n in enumerate(orders):
        less = 0 if n == "L" else n - 1
        p = _ratio(F.col("_o")[i], F.greatest(F.col("_hl") - less, F.lit(0)))
        rc = _ratio(F.col("_o")[i], F.greatest(F.col("_rl") - less, F.lit(0)))
        f = F.when(p + rc == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * rc / (p + rc))
        out[f"rouge{n}_clipped"] = F.when((F.col("_hl") > 0) & (F.col("_rl") > 0), f)
    return w.select(*key, *[c.alias(name) for name, c in out.items()])


def _take_equal(hfree, rfree, h, r, match: dict[int, int]) -> tuple[list, list]:
    """Walks the hypothesis from its end; each form takes the last free
    reference token of the same form. Returns what is left."""
    at: dict = {}
    for j in rfree:
        at.setdefault(r[j], []).append(j)
    rest = []
    for i in hfree:
        free = at.get(h[i])
        if free:
            match[i] = free.pop()
        else:
            rest.append(i)
    return rest, sorted(j for free in at.values() for j in free)


def _take_grouped(hfree, rfree, h, r, groups: dict[str, list], match: dict[int, int]) -> None:
    """The same, where forms that share a group match."""
    at: dict = {}
    for j in rfree:
        for g in groups.get(r[j], ()):
            at.setdefault(g, []).append(j)
    taken: set[int] = set()
    for i in hfree:
        best = -1
        for g in groups.get(h[i], ()):
            free = at.get(g)
            while free and free[-1] in taken:
                free.pop()
            if free:
                best = max(best, free[-1])
        if best >= 0:
            taken.add(best)
            match[i] = best


def _matched(forms) -> tuple[dict[int, int], list, list]:
    """Matches of one pair (``forms``: its (hypothesis, reference) forms of
    each stage) and the positions that are left, from the hypothesis's end
    and from the reference's beginning."""
    hfree, rfree = range(len(forms[0][0]) - 1, -1, -1), range(len(forms[0][1]))
    match: dict[int, int] = {}
    for h, r in forms:
        hfree, rfree = _take_equal(hfree, rfree, h, r, match)
    return match, hfree, rfree


def _chunks(match: dict[int, int]) -> list[int]:
    """[matches, chunks]."""
    return [len(match), sum(1 for i, j in match.items() if match.get(i - 1) != j - 1)]


def _matches_chunks(forms) -> list[int]:
    return _chunks(_matched(forms)[0])


def _stages(cols) -> list:
    """Rows of token arrays (hypothesis, reference, stage by stage) as pairs per stage."""
    return [None if any(x is None for x in row) else [(row[k], row[k + 1]) for k in range(0, len(row), 2)]
            for row in zip(*map(A.lists, cols))]


#: What the last stage needs of a pair: lengths, the matches so far as runs
#: (hypothesis, reference, length), and position and form of what is left.
_REST = {"_hl": "int", "_rl": "int", "_runs": "array<int>", "_hp": "array<int>", "_hf": "array<string>",
         "_rp": "array<int>", "_rf": "array<string>"}


def _rest_of(forms) -> tuple:
    match, hfree, rfree = _matched(forms)
    runs: list[int] = []
    for i in sorted(match):
        j = match[i]
        if runs and i == runs[-3] + runs[-1] and j == runs[-2] + runs[-1]:
            runs[-1] += 1
        else:
            runs += [i, j, 1]
    h, r = forms[-1]
    word = lambda x: A.as_word(x) if isinstance(x, bytes) else x
    return len(forms[0][0]), len(forms[0][1]), runs, list(hfree), [word(h[i]) for i in hfree], list(rfree), [word(r[j]) for j in rfree]


def _grouped_chunks(groups: dict[str, list], runs, hp, hf, rp, rf) -> list[int]:
    """[matches, chunks] after the last stage, in which forms that share a group match."""
    match = {i + k: j + k for i, j, n in zip(runs[::3], runs[1::3], runs[2::3]) for k in range(n)}
    if groups:
        _take_grouped(hp, rp, dict(zip(hp, hf)), dict(zip(rp, rf)), groups, match)
    return _chunks(match)


def _text_stages(stemmer: PorterStems | None) -> Callable:
    """Rows of lower-case texts (hypothesis, reference) as pairs per stage,
    of tokens as bytes."""
    def stages(cols) -> list:
        def tokens(text):
            found = A.meteor_tokens(text)
            return [found] if stemmer is None else [found, stemmer.of_tokens(found)]
        of_ref = once(tokens)
        return [None if h is None or r is None else list(zip(tokens(h), of_ref(r))) for h, r in zip(*map(A.utf8, cols))]
    return stages


def _lexicon_counts(base: DataFrame, key: list[str], lexicon: DataFrame, taken: list[str], stages: Callable) -> DataFrame:
    """Key, matches and chunks, and both lengths: the earlier stages are
    done in the row and only what they leave is stored (``_REST``).

    The distinct forms of a batch of rows meet the lexicon, one row per word
    with its set of groups, and the batch gets back those of its forms that
    are in it: pairs of one reference, which have most forms in common, ask
    once, and a form in all pairs is one row per batch. A row with a null
    in its key has no entries."""
    arrow = [{"int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}[t] for t in _REST.values()]
    names = [*key, *_REST, "_b", "_v"]

    def rest(batches):
        from pyspark import TaskContext
        piece = TaskContext.get().partitionId() << 32
        for b in batches:
            of = lambda c: b.column(b.schema.get_field_index(c))
            rows = [(None,) * len(_REST) if x is None else _rest_of(x) for x in stages([of(c) for c in taken])]
            open_ = [x for x in rows if x[4] and x[6]]          # else nothing can match
            forms = sorted(set().union(*[x[4] for x in open_], *[x[6] for x in open_]))
            yield pa.RecordBatch.from_arrays(
                [*map(of, key), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(arrow), arrow)],
                 pa.array([piece] * len(rows), pa.int64()),
                 pa.array(([forms] + [None] * len(rows))[:len(rows)], pa.list_(pa.string()))], names)
            piece += 1

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*key).schema)
    left = stored(base.mapInArrow(rest, f"{fields}, {', '.join(f'{c} {t}' for c, t in _REST.items())}, _b long, _v array<string>"), "unmatched")
    sets = lexicon.groupBy(F.col("word").alias("token")).agg(F.collect_set("group").alias("_g"))
    found = left.select(F.col("_b").alias("_of"), F.explode("_v").alias("token")).join(sets, "token").select("_of", "token", "_g")

    def counts(rows: pa.Table, entries: pa.Table) -> pa.Table:
        groups = dict(zip(entries.column("token").to_pylist(), entries.column("_g").to_pylist()))
        null = [any(x is None for x in k) for k in zip(*[rows.column(c).to_pylist() for c in key])]
        mc = [None if x[0] is None else _grouped_chunks({} if no else groups, *x[2:])
              for no, x in zip(null, zip(*[rows.column(c).to_pylist() for c in _REST]))]
        return pa.table({c: rows.column(c) for c in [*key, "_hl", "_rl"]} | {"_mc": pa.array(mc, pa.list_(pa.int32()))})

    return (left.drop("_v").groupBy("_b").cogroup(found.groupBy("_of"))
            .applyInArrow(counts, f"{fields}, _hl int, _rl int, _mc array<int>"))


def meteor(df: DataFrame, key: list[str], hyp: str, ref: str,
           stems: DataFrame | Callable[[Column], Column] | PorterStems | None = None,
           synonyms: DataFrame | Callable[[Column], Column] | None = None,
           lexicon: DataFrame | None = None) -> DataFrame:
    """METEOR per pair (J-4): columns ``key`` and ``meteor``.

    Both token lists of a pair are in its row; one Arrow UDF pairs them
    stage by stage (exact, stems, synonyms of stems) and counts matches and
    chunks, so nothing is shuffled unless a stage is given as a table.
    ``synonyms`` gives one form per stem; ``lexicon`` (word, group) any
    number of groups per stem. NULL where a text is NULL or has no tokens."""
    stemmer = stems if _in_python(stems) else None
    stages = _stages
    if _in_python(stems) and synonyms is None:
        base, taken = df.select(*key, F.lower(hyp).alias("_h"), F.lower(ref).alias("_r")), ["_h", "_r"]
        stages = _text_stages(stemmer)
    else:
        base = df.select(*key, meteor_tokens(F.col(hyp)).alias("_h0"), meteor_tokens(F.col(ref)).alias("_r0"))
        at = 0
        for table, dst in ((stems, "stem"), (synonyms, "synonym")):
            if table is not None:
                base = _mapped(base, key, table, "word", dst, {f"_h{at}": f"_h{at + 1}", f"_r{at}": f"_r{at + 1}"})
                at += 1
        taken = [f"_{side}{k}" for k in range(at + 1) for side in "hr"]

    def counts(cols):
        rows = stages(cols)
        out = [(None, None, None) if x is None else (_matches_chunks(x), len(x[0][0]), len(x[0][1])) for x in rows]
        mc, hl, rl = zip(*out) if out else ((), (), ())
        return [pa.array(mc, pa.list_(pa.int32())), pa.array(hl, pa.int32()), pa.array(rl, pa.int32())]

    w = (_lexicon_counts(base, key, lexicon, taken, stages) if lexicon is not None
         else A.with_columns(base, taken, "_mc array<int>, _hl int, _rl int", counts))
    m = F.col("_mc")[0].cast("double")
    p, rc = m / F.col("_hl"), m / F.col("_rl")
    a = F.lit(METEOR_ALPHA)
    fmean = (p * rc) / (a * p + (F.lit(1.0) - a) * rc)
    pen = F.lit(METEOR_GAMMA) * F.pow(F.col("_mc")[1] / m, F.lit(METEOR_BETA))
    score = F.when(m == 0, F.lit(0.0)).otherwise((F.lit(1.0) - pen) * fmean)
    return w.select(*key, F.when((F.col("_hl") > 0) & (F.col("_rl") > 0), score).alias("meteor"))


def score_summaries(pairs: DataFrame, key: list[str], hyp: str = "generated_summary",
                    ref: str = "actual_summary", token_vectors: DataFrame | None = None,
                    stems: DataFrame | Callable[[Column], Column] | None = None,
                    synonyms: DataFrame | Callable[[Column], Column] | None = None,
                    union: bool = False, make_embedder: Callable | None = None) -> DataFrame:
    """J-6: every score of every (dialogue, model) pair in one table:
    rouge_1, rouge_2, rouge_l (``union``: at summary level), meteor (all
    row-local), and bert_precision / bert_recall / bert_f1 from the texts
    with ``make_embedder``, or from ``token_vectors`` (the key's columns, or
    pair_id with the key, side, token_no, vector); else NULL."""
    scored = rouge_l(pairs, hyp, ref, union, orders=(1, 2))
    if isinstance(stems, DataFrame) or isinstance(synonyms, DataFrame):
        out = scored.join(meteor(pairs, key, hyp, ref, stems=stems, synonyms=synonyms), key, "left")
    else:
        out = meteor(scored, scored.columns, hyp, ref, stems=stems, synonyms=synonyms)
    if make_embedder is not None:
        return out.join(score_texts(pairs, key, hyp, ref, make_embedder), key, "left")
    if token_vectors is not None:
        if "pair_id" in token_vectors.columns:
            one = F.col("pair_id") if len(key) == 1 else F.col("pair_id").getField
            token_vectors = token_vectors.select(*([one.alias(key[0])] if len(key) == 1 else [one(k).alias(k) for k in key]),
                                                 "side", "token_no", "vector")
        return out.join(bert_score(token_vectors, key=key), key, "left")
    return out.withColumns({c: F.lit(None).cast("double") for c in BERT_SCORES})
