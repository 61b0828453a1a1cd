"""Exact top-k inner-product search with a pivot-distance index.

Vectors become integers, floor(scale * x). To turn the largest inner
product into the smallest distance every candidate gets one more
component, sqrt(M^2 - |x|^2) with M the largest norm, and every query a
zero: then |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each candidate is keyed by its
nearest pivot and its distance to it; sorted by that key the index is a
table of annuli, a block of at most ``block_rows`` vectors per row with
its pivot and distance range. A query looks at the annuli by rising lower
bound |d(q, pivot) - range|, the triangle inequality, and stops where the
bound passes its k-th distance.

Edge cases: null vectors and vectors holding a null or a non-finite
component take no part; a query meets only candidates of its own length
(an empty vector meets empty ones, score 0); repeated rows are candidates
each, of rows repeating a query's id the smallest vector asks, and rows of
the query's id are no candidates; rows without an id are left out; an
empty table gives no rows. Components are
clamped to +-2^31. Scores are 64-bit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import stored

PIVOTS = 48
#: Bounded sample, in order of a hash of the id, from which pivots are
#: chosen and each query gets its first bound.
SAMPLE_ROWS = 4096
BLOCK_ROWS = 1024
#: Rows of an index shard and queries of a query group: what one task holds.
SHARD_ROWS = 8192
QUERY_GROUP = 8192


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, vec array<long>) of the vectors that take part."""
    x = F.col("x")
    ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    big = float(1 << 31)
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vec_col).cast("array<double>").alias("x"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull()).where(ok)
            .select("vec_id", F.transform("x", lambda c: F.floor(
                F.least(F.greatest(c * F.lit(float(scale)), F.lit(-big)), F.lit(big)))).alias("vec")))


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.array(col.tolist(), np.int64).reshape(len(col), dim)


def _augment(m: np.ndarray, top: float) -> np.ndarray:
    """Float vectors with the extra component that makes norms equal."""
    m = m.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, top * top - (m * m).sum(1)))
    return np.hstack([m, rest[:, None]])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats only where they are exact."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class _Best:
    """The k best (score, smaller id) of every query of a group."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        s = np.where(own, np.iinfo(np.int64).min, score)
        i = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, score.shape))
        wide = s.shape[1]
        if wide > 4 * self.k:
            # ties of the k-th value stay, so the smaller id can win below
            kth = np.partition(s, wide - self.k, axis=1)[:, wide - self.k]
            keep = int((s >= kth[:, None]).sum(1).max())
            if keep < wide:
                top = np.argpartition(s, wide - keep, axis=1)[:, wide - keep:]
                s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        s = np.hstack([self.score[rows], s])
        i = np.hstack([self.id[rows], i])
        order = np.lexsort((i, ~s), axis=1)[:, :self.k]     # ~s falls as s rises
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)


def fit_pivots(sample: np.ndarray, n_pivots: int, rounds: int = 6) -> np.ndarray:
    """Centres of the augmented sample: spread starts, then a few mean
    steps. Any pivots give exact results; good ones prune more."""
    n_pivots = min(n_pivots, len(sample))
    first = [0]
    d = _distance(sample, sample[:1])[:, 0]
    while len(first) < n_pivots:
        first.append(int(d.argmax()))
        d = np.minimum(d, _distance(sample, sample[first[-1:]])[:, 0])
    c = sample[first].copy()
    for _ in range(rounds):
        near = _distance(sample, c).argmin(1)
        for p in range(n_pivots):
            if (near == p).any():
                c[p] = sample[near == p].mean(0)
    return c


def build_index(data: DataFrame, pivots: np.ndarray, top: float, dim: int, shards: int,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every vector, keyed (pivot, distance), as a stored table of sorted
    annulus blocks: shard, pivot, lo, hi, ids, vectors (binary).
    Range partitions on (pivot, distance, id) split a hot pivot and a hot
    distance alike."""
    def key(it):
        for pdf in it:
            a = _augment(_matrix(pdf["vec"], dim), top)
            d = _distance(a, pivots)
            p = d.argmin(1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "pivot": p.astype("int32"),
                                "dist": d[np.arange(len(p)), p], "vec": pdf["vec"]})

    def blocks(it):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        for pdf in it:
            p = pdf["pivot"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]).tolist() + [len(p)]
            rows = []
            for lo, hi in zip(cuts, cuts[1:]):
                for s in range(lo, hi, block_rows):
                    part = pdf.iloc[s:min(hi, s + block_rows)]
                    rows.append((shard, int(p[s]), float(part["dist"].iloc[0]), float(part["dist"].iloc[-1]),
                                 part["vec_id"].to_numpy(np.int64).tobytes(), _matrix(part["vec"], dim).tobytes()))
            yield pd.DataFrame(rows, columns=["shard", "pivot", "lo", "hi", "ids", "vecs"])

    keyed = data.mapInPandas(key, "vec_id long, pivot int, dist double, vec array<long>")
    out = (keyed.repartitionByRange(shards, "pivot", "dist", "vec_id")
           .sortWithinPartitions("pivot", "dist", "vec_id")
           .mapInPandas(blocks, "shard int, pivot int, lo double, hi double, ids binary, vecs binary"))
    return stored(out, "annuli")


def _search(dim: int, k: int, pivots: np.ndarray, top: float):
    """Group function over one query group and one index shard."""
    def run(key, qs: pd.DataFrame, ix: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "vec_id", "score"]
        if not len(qs) or not len(ix):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})
        q = _matrix(qs["vec"], dim)
        qid = qs["vec_id"].to_numpy(np.int64)
        flat = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        to_pivot = _distance(flat, pivots)
        sq = (flat * flat).sum(1)
        dp = to_pivot[:, ix["pivot"].to_numpy()]
        gap = np.maximum(0.0, np.maximum(ix["lo"].to_numpy() - dp, dp - ix["hi"].to_numpy()))
        best = _Best(len(q), k)
        floor = qs["bound"].to_numpy(np.float64)     # no k-th score is below it
        slack = 1e-6 * (1.0 + top + np.sqrt(sq))
        for b in np.argsort(gap.mean(0), kind="stable"):     # annuli outwards
            kth = np.maximum(best.score[:, -1].astype(np.float64), floor)
            reach = np.sqrt(np.maximum(0.0, sq + top * top - 2.0 * kth))
            rows = np.flatnonzero(gap[:, b] <= reach + slack)
            if not len(rows):
                continue
            ids = np.frombuffer(ix["ids"].iloc[b], np.int64)
            x = np.frombuffer(ix["vecs"].iloc[b], np.int64).reshape(len(ids), dim)
            best.add(rows, _scores(q[rows], x), ids, qid[rows][:, None] == ids[None])
        r, c = np.nonzero((best.id != np.iinfo(np.int64).max) & (best.score >= floor[:, None]))
        return pd.DataFrame({"query_id": qid[r], "vec_id": best.id[r, c], "score": best.score[r, c]})
    return run


def top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, shard_rows: int = SHARD_ROWS, query_group: int = QUERY_GROUP,
          n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row
    for which ``is_query`` (a Column over vec_id) holds."""
    spark = vectors.sparkSession
    data = stored(quantise(vectors, id_col, vec_col, scale).withColumn("dim", F.size("vec")), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    shape = data.groupBy("dim").agg(
        F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("top"),
        F.sum(F.when(is_query, 1).otherwise(0)).alias("queries")).collect()
    parts = []
    for row in sorted(shape):           # one index for each vector length
        if not row["queries"]:
            continue
        dim, top = row["dim"], float(row["top"])
        of_dim = data.where(F.col("dim") == dim).select("vec_id", "vec")
        sample = of_dim.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
        s_id, s = sample["vec_id"].to_numpy(np.int64), _matrix(sample["vec"], dim)
        pivots = fit_pivots(_augment(s, top), n_pivots)
        shards = max(1, math.ceil(row["n"] / shard_rows))
        groups = max(1, math.ceil(row["queries"] / query_group))
        index = build_index(of_dim, pivots, top, dim, shards)

        def bound(it, s=s, s_id=s_id, dim=dim):
            """A lower bound of the k-th score: the k-th within the sample."""
            for pdf in it:
                q = _matrix(pdf["vec"], dim)
                sc = _scores(q, s).astype(np.float64)
                sc[pdf["vec_id"].to_numpy()[:, None] == s_id[None]] = -np.inf
                kth = np.partition(sc, -k, axis=1)[:, -k] if len(s) >= k else np.full(len(q), -np.inf)
                yield pdf.assign(bound=np.where(np.isfinite(kth), kth, -1e300))

        queries = (of_dim.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
                   .mapInPandas(bound, "vec_id long, vec array<long>, bound double")
                   .withColumn("qg", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
                   .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
        index = index.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        parts.append(queries.groupBy("qg", "shard").cogroup(index.groupBy("qg", "shard"))
                     .applyInPandas(_search(dim, k, pivots, top), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = (found.groupBy("query_id")       # at most k rows from each shard
            .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
                 .alias("top")))
    return best.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"),
        (-F.col("t.s")).alias("score"))
