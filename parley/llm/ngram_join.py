"""Word n-gram Jaccard join by signature trees.

A document's set holds the 64-bit hashes of its distinct n-word shingles
(two 64-bit sums over them name the set). Documents with equal sets are
one. To bring the rest together:

1. With the hashes of a set in rising order and f = n - ceil(t n), two
   linked sets share about l of their first f + l. Keys are these (l = f / 2);
   a set of whose keys fewer than l - 1 occur in another document has no
   partner and goes.
2. Of the keys that two sets share, the rarest is none of the l - 2 most
   frequent of either, as l - 1 are shared: sets left over that share one of
   their other keys are candidates, and candidate groups are the components
   of that graph. Passages that many documents hold join nothing so.
   Chance keys may still chain sets: in a group larger than
   ``TASK_SHINGLES`` the same is done again with all hashes of its sets, of
   which two linked ones share ceil(t n). What is larger still, sets that
   are alike indeed, is dealt to tasks by pairs of (size class, salt), so
   every two sets of like size meet.
3. In a task, a signature tree: leaves are sets, a node holds the OR of
   its leaves' bitmaps, their size range and largest slack (shingles that
   share a bit). A dual traversal from the root drops node pairs whose
   sizes cannot link, whose common bits plus slack stay below the overlap
   a link needs, or whose sets are in one component already. Pairs of
   leaves left are compared exactly.

Every link between different sets is found or already implied by links
found; components over them are exact. Hashes of 64 bits stand for
shingles.

Edge cases: null and empty texts and texts without words have an empty set
and link with nothing (component: their own id); a text of fewer than n
words is one shingle; equal texts, also under one id, are one set; a null
doc_id counts as no smallest id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import exchange as ex
from parley.llm import textvec as tv
from parley.llm.graph import components
from parley.session import stored

U64 = np.uint64
#: Shingles of the sets that one task holds, about.
TASK_SHINGLES = 2_000_000
LEAF, FAN = 8, 8
#: Shingles of a part of a large group, and keys of a bucket, when it is split.
PART_SHINGLES, BUCKET_KEYS = 1 << 15, 1 << 19


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row: (hashes, row of each),
    by row, then hash. A-Z are lower-cased."""
    data = tv.LOWER[data]
    s, e, row = tv.word_spans(data, off)
    if not len(s):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    w = tv.span_hash(tv.prefix_hash(data), s, e)
    count = np.bincount(row, minlength=len(off) - 1)
    seed = tv.mix(np.array([n], U64))[0]

    def chain(first: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(first), seed + U64(length), U64)
        for k in range(length):
            h = tv.mix(h * U64(0x9FB21C651E98DF25) + w[first + k])
        return h

    at = np.arange(len(s))
    start = np.cumsum(count) - count
    full = at[at + n <= (start + count)[row]]
    hs, rs = [chain(full, n)], [row[full]]
    for k in range(1, n):                      # shorter texts: one shingle
        few = start[count == k]
        if len(few):
            hs.append(chain(few, k))
            rs.append(row[few])
    h, r = np.concatenate(hs), np.concatenate(rs)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    return h[new], r[new]


def _bounds(r: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(r, minlength=rows)
    return n, np.cumsum(n) - n


def set_names(h: np.ndarray, r: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit names of each row's set."""
    n, start = _bounds(r, rows)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(rows, U64)
        if len(h):
            total[n > 0] = np.add.reduceat(tv.mix(h ^ U64(salt)), start[n > 0])
        out.append(tv.mix(total + n.astype(U64)).view(np.int64))
    return n, out[0], out[1]


def prefix_lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys sent, first keys of which one is shared, shared ones needed)."""
    f = n - (percent * n + 99) // 100
    need = np.maximum(1, f // 2)
    return np.minimum(n, f + need), np.minimum(n, f + 1), np.maximum(1, need - 1)


def _prefix_keys(n_words: int, percent: int):
    def keys(data, off):
        h, r = shingle_sets(data, off, n_words)
        n, start = _bounds(r, len(off) - 1)
        sent, _, _ = prefix_lengths(n, percent)
        keep = np.arange(len(h)) - start[r] < sent[r]
        return h[keep], r[keep]
    return keys


def signature_links(sets: list[np.ndarray], percent: int, role: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links (index pairs) among sorted hash arrays: two sets in
    one component of all links are joined by those returned. With ``role``
    only pairs of roles that meet count."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    if m < 2:
        return []
    first = np.array([x[0] for x in sets], U64)
    order = np.lexsort((first, np.floor(np.log(size) * 4)))
    sets, size = [sets[i] for i in order], size[order]
    role = None if role is None else role[order]
    bits = 1 << min(15, max(8, int(2 * size.max() - 1).bit_length()))
    words = bits // 64
    maps = np.zeros((m, words), U64)
    for i, x in enumerate(sets):
        b = (x >> U64(20)) & U64(bits - 1)
        np.bitwise_or.at(maps[i], (b >> U64(6)).astype(np.int64), U64(1) << (b & U64(63)))
    slack = size - np.bitwise_count(maps).sum(1).astype(np.int64)

    # levels of the tree: (bitmaps, smallest, largest, slack, first leaf, end)
    levels = [(maps, size, size, slack, np.arange(m), np.arange(m) + 1)]
    while len(levels[-1][1]) > 1:
        b, lo, hi, sl, s, e = levels[-1]
        cut = np.arange(0, len(lo), LEAF if len(levels) == 1 else FAN)
        end = np.r_[cut[1:], len(lo)] - 1
        levels.append((np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut),
                       np.maximum.reduceat(hi, cut), np.maximum.reduceat(sl, cut), s[cut], e[end]))
    comp = np.arange(m)
    links: list[tuple[int, int]] = []

    def alive(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes (a x b) that may hold a link."""
        bm, lo, hi, sl, _, _ = levels[level]
        fit = (100 * hi[b][None] >= percent * lo[a][:, None]) & (100 * hi[a][:, None] >= percent * lo[b][None])
        need = -(-percent * (lo[a][:, None] + lo[b][None]) // (100 + percent))
        common = np.bitwise_count(bm[a][:, None] & bm[b][None]).sum(2).astype(np.int64)
        return fit & (common + np.minimum(sl[a][:, None], sl[b][None]) >= need)

    def joined(level: int, i: int, j: int) -> bool:
        _, _, _, _, s, e = levels[level]
        c = comp[s[i]]
        return bool((comp[s[i]:e[i]] == c).all() and (comp[s[j]:e[j]] == c).all())

    top = len(levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if (i != j or level) and joined(level, i, j):
            continue
        if level == 0:
            if i == j or (role is not None and not _MEET[role[i], role[j]]):
                continue
            x, y = sets[i], sets[j]
            inter = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * inter >= percent * (len(x) + len(y) - inter):
                comp[comp == comp[j]] = comp[i]
                links.append((int(order[i]), int(order[j])))
            continue
        width = LEAF if level == 1 else FAN
        below = len(levels[level - 1][1])
        a = np.arange(i * width, min(below, (i + 1) * width))
        b = np.arange(j * width, min(below, (j + 1) * width))
        ok = alive(level - 1, a, b)
        if i == j:
            ok &= a[:, None] <= b[None]
        # near pairs last on the stack, so first done: they join components
        for p, q in sorted(zip(*np.nonzero(ok)), key=lambda t: -abs(int(a[t[0]]) - int(b[t[1]]))):
            stack.append((level - 1, int(a[p]), int(b[q])))
    return links


def _candidates(table: DataFrame, n_words: int, percent: int, buckets: int) -> DataFrame:
    """Sets that may have a partner: node (128-bit name as text), size,
    hashes (binary), rarest of the keys sent that another one has sent."""
    copies = (ex.rows(table, "n_shingles", "set_a", "set_b").where("n_shingles > 0").groupBy("set_a", "set_b")
              .agg(F.min(F.struct(F.col("piece"), F.col("row"))).alias("kept")))
    firsts = copies.select(F.col("kept.piece").alias("piece"), F.col("kept.row").alias("row"))
    kept = stored(firsts.groupBy("piece").agg(F.collect_list("row").alias("rows")), "firsts")   # rows of one piece
    answers = ex.shared_keys(table, _prefix_keys(n_words, percent), buckets, kept, only=True)
    right = (answers.select("piece", "bucket", "vals", F.lit(None).cast("array<int>").alias("rows"))
             .unionByName(kept.select("piece", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("vals"), "rows")))

    def pick(left: pa.Table, rt: pa.Table) -> pa.Table:
        shared, held = ex.open_answers(rt, buckets)
        firsts = {r for x in rt.column("rows").to_pylist() if x for r in x}
        out = {"set_a": [], "set_b": [], "size": [], "hashes": [], "keys": []}
        batch = ex.open_piece(left)
        texts = batch.column("text").take(pa.array(sorted(firsts), pa.int64())) if batch is not None else pa.array([], pa.string())
        for _, _, data, off in tv.pieces(texts):
            rows = len(off) - 1
            h, r = shingle_sets(data, off, n_words)
            n, a, b = set_names(h, r, rows)
            start = np.cumsum(n) - n
            sent, _, need = prefix_lengths(n, percent)
            hit, at = ex.member(shared, ex.fold(h, buckets))
            place = np.arange(len(h)) - start[r]
            hits = np.bincount(r[hit & (place < sent[r])], minlength=rows)
            for i in np.flatnonzero((n > 0) & (hits >= need)):
                x = h[start[i]:start[i] + n[i]]
                k = np.flatnonzero(hit[start[i]:start[i] + sent[i]])
                out["set_a"].append(int(a[i]))
                out["set_b"].append(int(b[i]))
                out["size"].append(int(n[i]))
                out["hashes"].append(x.tobytes())
                out["keys"].append(_rarest(x[k], held[at[start[i] + k]], need[i]).view(np.int64).tolist())
        return pa.table({"set_a": pa.array(out["set_a"], pa.int64()), "set_b": pa.array(out["set_b"], pa.int64()),
                         "size": pa.array(out["size"], pa.int64()), "hashes": pa.array(out["hashes"], pa.binary()),
                         "keys": pa.array(out["keys"], pa.list_(pa.int64()))})

    got = (table.select("piece", "blob").groupBy("piece").cogroup(right.groupBy("piece"))
           .applyInArrow(pick, "set_a long, set_b long, size long, hashes binary, keys array<long>"))
    return stored(got.select(_node().alias("node"), "size", "hashes", "keys"), "candidates")


def _node():
    return F.concat(F.lpad(F.hex("set_a"), 16, "0"), F.lpad(F.hex("set_b"), 16, "0"))


#: Pairs of roles whose sets a task compares. A task of a large group holds
#: a block of a size class (0), another block of the class (2) and a block
#: of the next class (1); 3: the block alone, which meets itself.
_MEET = np.zeros((4, 4), bool)
for _a, _b in ((3, 3), (3, 1), (0, 2), (0, 1)):
    _MEET[_a, _b] = _MEET[_b, _a] = True


def _deal(cand: DataFrame, groups: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """node, hashes, task, role for every task a set belongs to. A group
    (node, size, label) that fits is a task; of a larger one, each block of
    a size class meets every block of its class and of the next, so sets of
    like size meet. The classes are stored: they are read several times."""
    x = groups.withColumn("cls", F.floor(F.log("size") / F.lit(math.log(100.0 / (percent - 0.1)))).cast("int"))
    per_class = stored(x.groupBy("label", "cls").agg(F.sum("size").alias("w"), F.count("*").alias("members")), "size-classes")
    whole = per_class.groupBy("label").agg(F.sum("w").alias("total"), F.sum("members").alias("all"))
    per_class = per_class.withColumn("s", F.ceil(F.col("w") / F.lit(task_shingles / 2)).cast("int")).select("label", "cls", "s")
    up = per_class.select("label", (F.col("cls") - 1).alias("cls"), F.col("s").alias("s_up"))
    down = per_class.select("label", (F.col("cls") + 1).alias("cls"), F.col("s").alias("s_down"))
    classes = (per_class.join(up, ["label", "cls"], "left").join(down, ["label", "cls"], "left")
               .join(whole.where("all > 1"), "label"))
    x = x.join(classes, ["label", "cls"])
    x = x.withColumn("i", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))

    def to(n):                              # 0 .. n-1, or nothing
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def entry(c, i, j, role):
        text = F.concat_ws(":", F.col("label"), c.cast("string"), i.cast("string"), j.cast("string"))
        return F.struct(text.alias("task"), role.cast("int").alias("role"))

    c, i = F.col("cls"), F.col("i")
    own = F.transform(to(F.greatest("s", F.coalesce("s_up", F.lit(0)))),
                      lambda j: entry(c, i, j, F.when(i == j, 3).otherwise(0)))
    other = F.transform(to(i), lambda k: entry(c, k, i, F.lit(2)))
    below = F.transform(to(F.coalesce("s_down", F.lit(0))), lambda k: entry(c - 1, k, i, F.lit(1)))
    one = F.array(F.struct(F.col("label").alias("task"), F.lit(3).alias("role")))
    tasks = F.when(F.col("total") <= task_shingles, one).otherwise(F.concat(own, other, below))
    dealt = x.select("node", F.explode(tasks).alias("t")).select("node", "t.task", "t.role")
    return dealt.join(cand.select("node", "hashes"), "node")


def _groups(keys: DataFrame) -> DataFrame:
    """(node, label): components of the sets (node, keys) that share a key."""
    by_key = keys.select(F.explode("keys").alias("key"), "node")
    hub = by_key.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other")
    return components(by_key.join(hub.select("key", "hub"), "key").select(F.col("node").alias("u"), F.col("hub").alias("v")))


def _rarest(keys: np.ndarray, held: np.ndarray, need: int) -> np.ndarray:
    """Keys without the ``need`` - 1 most frequent (``held`` pieces hold each)."""
    return keys[np.lexsort((keys, held))[:len(keys) - need + 1]]


def _split(cand: DataFrame, groups: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """(node, size, label) of the groups: those larger than a task fall
    apart into the components of the sets that share one of their rarest
    keys among all hashes, counted within the group."""
    x = stored(cand.select("node", "size").join(groups, "node"), "groups")
    large = stored(x.groupBy("label").agg(F.sum("size").alias("w")).where(F.col("w") > task_shingles), "large")
    total = large.agg(F.sum("w")).first()[0]
    if not total:
        return x
    buckets = max(12, math.ceil(total / BUCKET_KEYS))
    part = F.pmod(F.xxhash64("node"), F.lit(max(1, total // PART_SHINGLES))).alias("piece")
    held_by = x.join(large, "label", "left_semi").join(cand.select("node", "hashes"), "node")
    parts = stored(held_by.select(part, F.struct("node", "label", "hashes").alias("x"))
                   .groupBy("piece").agg(F.collect_list("x").alias("sets")), "parts")

    def opened(sets: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(nodes, keys, row of each) of one part; a group has keys of its own."""
        found = [np.frombuffer(h, U64) ^ tv.mix(np.array([int(g[:16], 16)], U64))
                 for g, h in zip(sets.field("label").to_pylist(), sets.field("hashes").to_pylist())]
        return sets.field("node"), np.concatenate(found), np.repeat(np.arange(len(found)), [len(k) for k in found])

    def send(batches):
        for b in batches:
            for piece, sets in zip(b.column(0).to_pylist(), b.column(1)):
                yield from ex.sent(piece, *opened(sets.values)[1:], buckets)

    def pick(left: pa.Table, rt: pa.Table) -> pa.Table:
        nodes, found = [], []
        if left.num_rows:
            shared, held = ex.open_answers(rt, buckets)
            node, keys, row = opened(left.column("sets")[0].values)
            hit, at = ex.member(shared, ex.fold(keys, buckets))
            n, start = _bounds(row, len(node))
            for i, name in enumerate(node.to_pylist()):
                own = np.arange(start[i], start[i] + n[i])[hit[start[i]:start[i] + n[i]]]
                need = -(-percent * int(n[i]) // 100)
                if len(own) >= need:
                    nodes.append(name)
                    found.append(_rarest(keys[own], held[at[own]], need).view(np.int64))
        return pa.table({"node": pa.array(nodes, pa.string()), "keys": pa.array(found, pa.list_(pa.int64()))})

    answers = ex.answers(parts.select("piece", "sets").mapInArrow(tv.tidy(send), ex.SENT))
    rarest = stored(parts.groupBy("piece").cogroup(answers.groupBy("piece"))
                    .applyInArrow(pick, "node string, keys array<long>"), "rarest")
    again = x.drop("label").join(_groups(rarest), "node")
    return stored(x.join(large, "label", "left_anti").unionByName(again), "groups")


def links(table: DataFrame, n_words: int, percent: int, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """(u, v) node names of spanning links between different sets."""
    cand = _candidates(table, n_words, percent, ex.bucket_count(table))
    groups = _split(cand, _groups(cand), percent, task_shingles)
    dealt = _deal(cand, groups, percent, task_shingles)

    def traverse(t: pa.Table) -> pa.Table:
        names = t.column("node").to_pylist()
        sets = [np.frombuffer(x, U64) for x in t.column("hashes").to_pylist()]
        role = t.column("role").to_numpy()
        found = signature_links(sets, percent, None if (role == 3).all() else role)
        del sets
        tv.release()
        return pa.table({"u": pa.array([names[i] for i, _ in found], pa.string()),
                         "v": pa.array([names[j] for _, j in found], pa.string())})

    return stored(dealt.groupBy("task").applyInArrow(traverse, "u string, v string"), "links")


def _labelled(docs: DataFrame, n_words: int, percent: int, task_shingles: int, carry: bool
              ) -> tuple[DataFrame, DataFrame]:
    """(pieces of docs, (node, label) of every set that has a link)."""
    def compute(data, off):
        h, r = shingle_sets(data, off, n_words)
        n, a, b = set_names(h, r, len(off) - 1)
        return [pa.array(n.astype(np.int64)), pa.array(a), pa.array(b)]

    table = ex.write_pieces(docs, compute, (("n_shingles", "long"), ("set_a", "long"), ("set_b", "long")), carry)
    return table, components(links(table, n_words, percent, task_shingles))


def classes(docs: DataFrame, n_words: int, percent: int, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links)
    and set_name of every document."""
    table, found = _labelled(docs, n_words, percent, task_shingles, False)
    ids = ex.rows(table, "n_shingles", "set_a", "set_b").select("doc_id", "n_shingles", _node().alias("node"))
    some = ids.where("n_shingles > 0")
    sets = some.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = sets.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "label").select("node", "component_id")
    out = some.join(by_set, "node").select("doc_id", "n_shingles", "component_id", F.col("node").alias("set_name"))
    return out.union(ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                                        F.lit(None).cast("string").alias("set_name")))


def keep_one(docs: DataFrame, n_words: int, percent: int, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """``docs``, with one row of each component: the smallest doc_id (of
    equal ids the first stored). Rows without words all stay."""
    table, found = _labelled(docs, n_words, percent, task_shingles, True)
    every = ex.rows(table, "n_shingles", "set_a", "set_b")
    some = every.where("n_shingles > 0").select(
        F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "piece", "row").alias("at"), _node().alias("node"))
    sets = some.groupBy("node").agg(F.min("at").alias("at"))
    best = (sets.join(found, "node", "left").groupBy(F.coalesce("label", "node").alias("label"))
            .agg(F.min("at").alias("at")))
    kept = (best.select("at.piece", "at.row").union(every.where("n_shingles = 0").select("piece", "row"))
            .groupBy("piece").agg(F.collect_list("row").alias("rows")))         # rows of one piece
    schema = docs.schema

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = ex.open_piece(left)
        at = pa.array(sorted(r for x in right.column("rows").to_pylist() for r in x), pa.int64())
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(ex.carried(batch, schema), schema.names)]).take(at)

    kept = stored(kept, "kept")
    return (table.select("piece", "blob").groupBy("piece").cogroup(kept.groupBy("piece")).applyInArrow(take, schema))
