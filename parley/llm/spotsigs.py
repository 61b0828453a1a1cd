"""Document fingerprints by SpotSigs.

A signature starts at a common word (an anchor) and chains the next
``CHAIN`` content words, ``STEP`` apart; a document's fingerprint is the
set of its signatures, 32-bit hashes in rising order, written as hex. Words
are runs of letters and digits, A-Z lower-cased. A text without a whole
chain is fingerprinted by its words; one without words, by itself.

Likeness is the Jaccard similarity of two sets, with pruning: sets whose
lengths alone rule out the threshold are not compared, and a comparison
ends once the rest cannot reach it. For all pairs, documents are
partitioned by set length so that like sets meet in their own or the next
partition, and within it by their rarest signatures.

Edge cases: a null text is empty; empty texts have the empty fingerprint,
equal to each other (likeness 1) and unlike all else (0); equal texts have
equal fingerprints, whatever their ids; rows without an id come last in
the order, rows with one id by their text; one document alone is its own
next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parley.llm import textvec as tv
from parley.session import stored

U64 = np.uint64
CHAIN, STEP = 2, 1
#: Articles and forms of "to be" in four languages.
ANCHORS = ("a an the is was are be been "
           "le la les un une des est sont "
           "der die das ein eine ist sind war "
           "el los las una unos es son era").split()
#: Other common words: no anchors and no content.
COMMON = ("and of to in that it for with by on at from this as or not but he she they we you i "
          "et de du en que qui dans pour par sur avec au aux ce se "
          "und von zu mit den dem auf im nicht auch sich "
          "y en que del al por con para no lo").split()

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_GAP[128:] = False


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = tv.word_spans(data, np.array([0, len(data)]), _GAP)
    return np.unique(tv.span_hash(tv.prefix_hash(data), s, e))


_ANCHOR = _word_hashes(ANCHORS)
_STOP = _word_hashes(ANCHORS + COMMON)


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def signatures(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of every text."""
    out: list[np.ndarray] = []
    for lo, hi, raw, off in tv.pieces(texts):
        rows = hi - lo
        data = tv.LOWER[raw]
        p = tv.prefix_hash(data)
        s, e, row = tv.word_spans(data, off, _GAP)
        w = tv.span_hash(p, s, e) if len(s) else np.zeros(0, U64)
        content = ~_in(_STOP, w)
        cw, crow = w[content], row[content]
        at = np.flatnonzero(_in(_ANCHOR, w))
        k = np.cumsum(content)[at] if len(at) else at       # next content word
        end = k + STEP * CHAIN - 1
        whole = end < len(cw)
        at, k, end = at[whole], k[whole], end[whole]
        same = crow[end] == row[at] if len(at) else np.zeros(0, bool)
        at, k = at[same], k[same]
        h = w[at]
        for c in range(CHAIN):
            h = tv.mix(h * U64(0x9FB21C651E98DF25) + cw[k + STEP * (c + 1) - 1])
        r = row[at]
        have = np.bincount(r, minlength=rows) > 0
        few = ~have[row]                                    # no chain: the words
        h, r = np.r_[h, tv.mix(w[few])], np.r_[r, row[few]]
        none = np.flatnonzero((np.bincount(row, minlength=rows) == 0) & (off[1:] > off[:-1]))
        if len(none):                                       # no words: the bytes
            raw_p = tv.prefix_hash(raw)
            h, r = np.r_[h, tv.span_hash(raw_p, off[none], off[none + 1])], np.r_[r, none]
        h = h >> U64(32)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new].astype(np.uint32), r[new]
        out += np.split(h, np.cumsum(np.bincount(r, minlength=rows))[:-1])
    return out


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_text(f: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(f), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0 as soon as it must be below
    ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return 0.0
    both, step = 0, max(64, len(a) // 4)
    for s in range(0, len(a), step):
        part = a[s:s + step]
        at = np.minimum(np.searchsorted(b, part), len(b) - 1)
        both += int((b[at] == part).sum())
        rest = both + len(a) - s - len(part)
        if rest < least * (len(a) + len(b) - rest):
            return 0.0
    return both / (len(a) + len(b) - both)


def length_partition(n, least: float):
    """Partition of a set length: like sets are at most one apart."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.0 / (least - 1e-6))).astype(np.int32)


# --- each document, its edited text and the next document -----------------

def in_order(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """docs (doc_id, text) in partitions of whole id ranges, each sorted by
    falling id and ended by the first row of the next range (``ahead`` 1);
    after the last range comes the first. One shuffle of the texts."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition
    least = -(1 << 63)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(least))
    cuts = sorted({int(c) for c in (d.select(key.cast("double").alias("k")).approxQuantile(
        "k", [i / n for i in range(1, n)], 1.0 / (8 * n)) or [])})
    bounds = np.array(cuts, np.int64)

    @pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, k.to_numpy(np.int64), "left")).astype(np.int32))

    heads = (d.select(key.alias("k")).withColumn("place", place("k")).groupBy("place")
             .agg(F.max("k").alias("k")).orderBy("place").collect())       # one row for each range
    before = {h["k"]: heads[i - 1]["place"] for i, h in enumerate(heads)}
    head_keys = np.array(sorted(before), np.int64)
    head_to = np.array([before[k] for k in sorted(before)], np.int32)

    @pandas_udf("array<struct<place:int,ahead:int>>")
    def places(k: pd.Series) -> pd.Series:
        x = k.to_numpy(np.int64)
        own = len(bounds) - np.searchsorted(bounds, x, "left")
        at = np.minimum(np.searchsorted(head_keys, x), max(0, len(head_keys) - 1))
        return pd.Series([[{"place": int(o), "ahead": 0}] + ([{"place": int(head_to[a]), "ahead": 1}]
                          if head_keys[a] == v else []) for o, a, v in zip(own, at, x)])

    return (d.withColumn("k", key).withColumn("p", F.explode(places("k")))
            .select("p.place", "p.ahead", "doc_id", "k", "text")
            .repartition(n // per_partition, "place")
            .sortWithinPartitions("place", "ahead", F.desc("k"), F.asc_nulls_first("text"))
            .drop("k"))


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the next one."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, set_partition int")


def fingerprints(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and the partition by set length (for
    ``least``)."""
    def run(batches):
        held = None                                 # the row whose next has not come

        def out(ids, texts, sigs, nexts, next_sigs):
            new = [edited(t, f) for t, f in zip(texts, nexts)]
            new_sigs = signatures(pa.array(new, pa.string()))
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                pa.array([as_text(s) for s in sigs], pa.string()), pa.array([as_text(s) for s in new_sigs], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(sigs, new_sigs)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(sigs, next_sigs)], pa.float64()),
                pa.array(length_partition(np.array([len(s) for s in sigs]), least))],
                [c.split()[0] for c in _OUT.split(", ")])

        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                place, ahead, ids = (part.column(i).to_pylist() for i in range(3))
                texts = [t or "" for t in part.column(3).to_pylist()]
                sigs = signatures(pa.array(texts, pa.string()))
                done = []
                for i in range(len(ids)):
                    if held is not None and held[0] == place[i]:
                        done.append((*held[1:], texts[i], sigs[i]))
                    held = None if ahead[i] else (place[i], ids[i], texts[i], sigs[i])
                if done:
                    yield out(*zip(*done))

    return in_order(docs).mapInArrow(run, _OUT)


# --- all pairs ---------------------------------------------------------------

def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id of documents (doc_id, fingerprint): the smallest id
    reachable over pairs of likeness ``least`` or more. Equal fingerprints
    are one set. Sets meet in their length partition and the one above,
    under the rarest of their signatures of which a like set must hold
    one; links are cut to those that join something new."""
    from parley.llm.graph import components
    sets = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    sets = stored(sets.where("fingerprint <> ''"), "prints")

    @pandas_udf("array<string>")
    def split(f: pd.Series) -> pd.Series:
        return f.map(lambda x: [x[i:i + 8] for i in range(0, len(x), 8)])

    each = sets.select("node", F.explode(split("fingerprint")).alias("sig"))
    seen = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = (each.join(seen, "sig").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("sigs")))     # one document's
    n = F.size("sigs")
    part = F.floor(F.log(n) / F.lit(math.log(1.0 / (least - 1e-6)))).cast("int")
    keyed = (ranked.withColumn("part", F.explode(F.array(part, part + 1)))
             .select("node", "part", F.explode(F.slice("sigs", 1, n - F.ceil(n * F.lit(least - 1e-9)).cast("int") + 1)).alias("k")))
    met = keyed.where("k.df > 1").select("node", "part", F.col("k.sig").alias("sig"))
    rows = met.join(sets, "node").select("part", "sig", "node", "fingerprint")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = sorted(((from_text(f), v) for v, f in zip(pdf["node"], pdf["fingerprint"])), key=lambda t: len(t[0]))
        comp, links = list(range(len(x))), []
        lo = 0
        for i in range(1, len(x)):
            while len(x[lo][0]) < least * len(x[i][0]):
                lo += 1
            for j in range(i - 1, lo - 1, -1):
                if comp[i] != comp[j] and likeness(x[j][0], x[i][0], least) >= least:
                    links.append((x[j][1], x[i][1]))
                    old, new = comp[i], comp[j]
                    comp = [new if c == old else c for c in comp]
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    found = components(rows.groupBy("part", "sig").applyInPandas(compare, "u long, v long"))
    least_of = prints.join(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "fingerprint")
    return (least_of.join(found, "node", "left")
            .select("doc_id", F.coalesce("label", "node").alias("class_id")))
