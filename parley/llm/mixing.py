"""Mixing sources to target weights by blocks.

The words of a source, documents one after the other, are cut into blocks
of a fixed number of words. Source targets (in words) become block counts.
The mix is a row of output shards with ``shard_slots`` slots each; every
shard draws its counts of the sources at random: multinomial draws on the
condition that the shards' counts add up to the sources' totals, drawn by
halving the range of shards again and again, so any shard is computed
alone and reruns agree. The slots of a source are numbered through the
shards; slot j of pass p takes block permutation_p(j), a keyed
pseudorandom permutation of the source's block indices, and the blocks
are joined by (source, index). A pass uses each block at most once and
there are at most two passes, so no document gives more than twice its
words.

Sources (null last) are the mixture's configuration: their names and
totals, one number each, go through the driver; documents and blocks
never do.

Edge cases: a null or empty text has size 0 and is never taken; a null
source is a source; repeated rows are documents each; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 20240611
#: Hash buckets of a source whose sizes are added up before the rows within.
BUCKETS = 1024
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_PASSES) -> list[float]:
    """Words of each source: ``share`` of all sizes split by weight; what
    exceeds ``most`` times a source's size is reshared by weight among the
    others until none exceeds it."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """Draws of ``good`` among n of good + bad; for counts beyond the
    generator's range the normal law of the same mean and variance."""
    total = good + bad
    if n == 0 or good == 0:
        return 0
    if total < 10 ** 9:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * good / total
    sd = math.sqrt(max(0.0, mean * (bad / total) * ((total - n) / max(1, total - 1))))
    return int(min(good, n, max(0, n - bad, round(rng.normal(mean, sd)))))


def shard_counts(totals: tuple[int, ...], slots: int, seed: int):
    """f(shard) -> (counts, first slot numbers) of every source."""
    all_slots = sum(totals)
    shards = max(1, math.ceil(all_slots / slots))

    @lru_cache(maxsize=512)
    def node(lo: int, hi: int, have: tuple[int, ...]) -> tuple[int, ...]:
        """Counts of the left half of shards lo..hi."""
        rng = np.random.default_rng([seed, lo, hi])
        mid = (lo + hi) // 2
        want = min(sum(have), (mid - lo) * slots)
        rest, got = sum(have), []
        for h in have:
            rest -= h
            x = _hypergeometric(rng, h, rest, want)
            got.append(x)
            want -= x
        return tuple(got)

    def of(shard: int):
        lo, hi, have = 0, shards, totals
        first = [0] * len(totals)
        while hi - lo > 1:
            left, mid = node(lo, hi, have), (lo + hi) // 2
            if shard < mid:
                hi, have = mid, left
            else:
                first = [f + x for f, x in zip(first, left)]
                lo, have = mid, tuple(h - x for h, x in zip(have, left))
        return have, first
    return shards, of


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1: a Feistel network over the next
    even power of two, walked until it is back in range."""
    from parley.llm.textvec import U64, mix
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, 7, dtype=U64) + U64(key & ((1 << 63) - 1)))
    out = x.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> U64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = (left << U64(half)) | right
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def measure(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (+ kept columns), written once to the shared
    folder, so texts are read once."""
    return stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep), "sizes")


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS) -> list[dict]:
    """One entry per source, by code point, null last: sid, source, size,
    target, blocks (in the source), slots (in the mix)."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    t = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share)
    out = []
    for i, r in enumerate(rows):
        blocks = -(-r["size"] // block_words)
        slots = min(MOST_PASSES * blocks, round(t[i] * blocks / r["size"])) if r["size"] else 0
        out.append({"sid": i, "source": r["source"], "size": r["size"], "target": t[i], "blocks": blocks, "slots": slots})
    return out


def with_source(sizes: DataFrame, sources: list[dict]) -> DataFrame:
    """Adds sid, source_size, target. The source table has a row per
    source; the join is null-safe."""
    spark = sizes.sparkSession
    table = spark.createDataFrame([(s["sid"], s["source"], s["size"], s["target"]) for s in sources],
                                  "sid int, _src string, source_size long, target double")
    hint = F.broadcast(table) if len(sources) <= 100_000 else table
    return sizes.join(hint, sizes["source"].eqNullSafe(table["_src"]), "inner").drop("_src")


def place(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds ``start``: the words of the source before the document, in an
    order by hash bucket, then doc_id. Two-level sums: a window over the
    buckets' totals, then one within (source, bucket)."""
    b = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    totals = b.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("in_bucket")
    totals = totals.select("sid", "bucket", before.alias("before"))
    w = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = b.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return (within.join(totals, ["sid", "bucket"])
            .withColumn("start", F.col("before") + F.col("inside")).drop("bucket", "before", "inside"))


def draw(spark, sources: list[dict], slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: shard, sid, pass, block."""
    totals = tuple(s["slots"] for s in sources)
    blocks = [s["blocks"] for s in sources]
    shards, _ = shard_counts(totals, slots, seed)

    def run(it):
        _, of = shard_counts(totals, slots, seed)
        for pdf in it:
            for shard in pdf["id"].tolist():
                parts = []
                for sid, (n, first) in enumerate(zip(*of(shard))):
                    if not n:
                        continue
                    j = np.arange(first, first + n, dtype=np.int64)
                    turn = j // blocks[sid]
                    block = np.empty(n, np.int64)
                    for p in np.unique(turn):
                        at = turn == p
                        block[at] = permute(j[at] - p * blocks[sid], blocks[sid], (seed * 1_000_003 + sid) * 7 + int(p))
                    parts.append(pd.DataFrame({"shard": np.int64(shard), "sid": np.int32(sid),
                                               "pass": turn.astype("int32"), "block": block}))
                if parts:
                    yield pd.concat(parts)
    if not sum(totals):
        return spark.createDataFrame([], "shard long, sid int, pass int, block long")
    tasks = min(shards, 4 * spark.sparkContext.defaultParallelism + shards // 64)
    return spark.range(0, shards, 1, tasks).mapInPandas(run, "shard long, sid int, pass int, block long")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per (document, block): sid, block, words first..last of the
    document (from 0, end exclusive), with the document's columns."""
    b = F.col("block") * block_words
    return (placed.where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words),
                                                      F.floor((F.col("start") + F.col("size") - 1) / block_words))))
            .withColumn("first", F.greatest(b, F.col("start")) - F.col("start"))
            .withColumn("last", F.least(b + block_words, F.col("start") + F.col("size")) - F.col("start")))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS,
                  seed: int = SEED, shard_slots: int = SHARD_SLOTS, keep: tuple[str, ...] = ()
                  ) -> tuple[DataFrame, DataFrame]:
    """(documents with sid, source_size, target and start; the mix: a row
    for each piece of a document a slot takes: shard, pass, doc_id, sid,
    start, first, last)."""
    sizes = measure(docs, keep)
    sources = plan(sizes, weights, share, block_words)
    placed = place(with_source(sizes, sources), block_words)
    slots = draw(docs.sparkSession, sources, shard_slots, seed)
    mixed = (pieces(placed.select("doc_id", "sid", "start", "size", *keep), block_words)
             .join(slots.hint("merge"), ["sid", "block"])       # slots grow with the corpus: no broadcast
             .select("shard", "pass", "doc_id", "sid", "start", "size", "block", "first", "last", *keep))
    return placed, mixed


def taken(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    placed, mixed = mix_documents(docs, **params)
    got = mixed.groupBy("sid", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    big = placed.where("size > 0").join(got, ["sid", "start"], "left")
    cols = ["doc_id", "size", "source_size", "target"]
    return (big.select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
            .union(placed.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))))


#: A word with the white space before it.
LED_WORD = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"
LEAD = "^[\\x20\\x09-\\x0D]+"


def cut(text, words, ranges, size):
    """Column: the words of the ranges (ordered, without overlap) with the
    white space between them; ranges that do not touch are joined by a
    space. All ``size`` words give the text as it is. ``words``: the text's
    words, each with the white space before it."""
    def piece(r, i):
        got = F.array_join(F.slice(words, r["first"].cast("int") + 1, (r["last"] - r["first"]).cast("int")), "")
        before = F.get(ranges, i - 1)
        bare = F.regexp_replace(got, LEAD, "")
        return F.when(i == 0, bare).when(before["last"] == r["first"], got).otherwise(F.concat(F.lit(" "), bare))
    held = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    # size(words) also keeps the word list a column of its own: it is read
    # more than once, so it is not computed anew for each range
    return F.when(held >= size, text).when(F.size(words) > 0, F.array_join(F.transform(ranges, piece), ""))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` as the mix takes them: for each document and pass a row
    with the words its taken blocks hold (text and n_chars follow), other
    columns as they were. Rows equal in id, source and text share the
    columns of one of them. One shuffle of the texts."""
    key = F.xxhash64("doc_id", "source", "text")
    name = "mix_key"
    while name in docs.columns:
        name += "_"
    placed, mixed = mix_documents(docs.select("doc_id", "source", "text", key.alias(name)), keep=(name,), **params)
    del placed
    taken_ = (mixed.groupBy(name, "sid", "start", "pass")
              .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"), F.max("size").alias("size"))
              .select(name, F.struct("ranges", "size").alias(name + "r")))
    with_key = docs.withColumn(name, key).dropDuplicates([name])
    out = with_key.hint("merge").join(taken_, name)     # texts are never broadcast
    out = out.withColumn(name + "w", F.regexp_extract_all("text", F.lit(LED_WORD), F.lit(0)))
    out = out.withColumn("text", cut(F.col("text"), F.col(name + "w"), F.col(name + "r.ranges"), F.col(name + "r.size")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
