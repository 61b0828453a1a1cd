"""Merkle manifest of a dataset: trees of digests, written as postorder logs.

Each source has a tree over its rows' digests by ascending key: every
``fan`` consecutive nodes of a level become one node of the next, the
digest of their digests (the last run may be shorter), until one is left.
The sources' roots are the leaves of one more tree, by source.

An *aligned builder* is a task over ``fan ** levels`` consecutive nodes of a
tree. It appends nodes to its log as they are complete: a node follows the
last of its children. Its last node is an entry of the next pass, until a
pass has one builder per tree; each pass has ``fan ** levels`` times fewer
nodes. In such a log the place of a node follows from numbers alone: before
node j of level k, which ends with entry e, there are all nodes of each
level that end by then (``postorder_at``). A proof addresses the siblings of
each ancestor by these places, in the log of each pass, from the tree of the
sources down to the leaves.

Rows are dealt by ranges of (source, key) to number them, so a source with
a third of all rows is many builders' work like any other; a builder holds
at most ``fan ** levels`` rows. Texts are read once, by the digests; digests
and logs are stored in the shared folder.

Edge cases: a null field counts as ``-``; a null source is a source of its
own, the first; rows with equal keys stand in order of their digests; a
null key comes first; an empty table gives no rows; extra columns are left
out of the digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.operators.shaping import ordinal
from parley.session import stored

FAN = 3
#: Levels of one builder: 3 ** 8 = 6561 rows.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64

_PATH = "array<struct<left:string,right:string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- digests of rows --------------------------------------------------------

def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def row_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """Digest of a row's fields; ``changed`` replaces some of them."""
    return F.sha2(F.concat(*[field(changed.get(f, F.col(f"`{f}`"))) for f in fields]), 256)


def tree_of(source: Column) -> Column:
    """A name of a source that is never null and sorts as sources do, null first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


# --- shape of a tree --------------------------------------------------------

def height(n: int, fan: int) -> int:
    """Levels above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


def widths(n: int, levels: int, fan: int) -> list[int]:
    """Nodes of each level over n entries."""
    out = [n]
    for _ in range(levels):
        out.append(-(-out[-1] // fan))
    return out


def postorder_at(n: int, levels: int, fan: int, level: int, j: np.ndarray) -> np.ndarray:
    """Places of the nodes j of a level in the postorder log over n entries.

    The node's last entry is number e. Of each level up to its own, the
    nodes that end by e are there, itself included; of the higher ones
    those that end before it."""
    j = np.asarray(j, np.int64)
    e = np.minimum((j + 1) * fan ** level, n)
    done = np.zeros(len(j), np.int64)
    for k in range(levels + 1):
        if k <= level:
            done += np.where(e == n, -(-n // fan ** k), e // fan ** k)
        else:
            done += (e - 1) // fan ** k
    return done - 1


def append_log(entries: list[str], levels: int, fan: int) -> list[str]:
    """The digests of the nodes over entries, in order of completion."""
    log: list[str] = []
    run: list[list[str]] = [[] for _ in range(levels + 1)]

    def complete(digest: str, level: int) -> None:
        log.append(digest)
        if level < levels:
            run[level].append(digest)
            if len(run[level]) == fan:
                close(level)

    def close(level: int) -> None:
        digest = sha("".join(run[level]))
        run[level].clear()
        complete(digest, level + 1)

    for d in entries:
        complete(d, 0)
    for level in range(levels):
        if run[level]:
            close(level)
    return log


def siblings(log: list[str], n: int, levels: int, fan: int) -> list[list[tuple[str, str]]]:
    """For each level below the top and each of its nodes, its siblings'
    digests to the left and to the right, joined."""
    out = []
    for level, width in enumerate(widths(n, levels, fan)[:levels]):
        at = postorder_at(n, levels, fan, level, np.arange(width)).tolist()
        own = []
        for lo in range(0, width, fan):
            run = [log[at[j]] for j in range(lo, min(lo + fan, width))]
            own += [("".join(run[:k]), "".join(run[k + 1:])) for k in range(len(run))]
        out.append(own)
    return out


def fold(digest: str, path) -> str:
    """The root that a digest and its siblings, level by level, give."""
    for left, right in path:
        digest = sha(left + digest + right)
    return digest


# --- logs -------------------------------------------------------------------

class Logs:
    """The logs over trees of entries (tree, idx, digest and others, n:
    entries of the tree); ``passes``: tables of tree, block, n, levels,
    log; ``roots``: tree, digest."""

    def __init__(self, entries: DataFrame, fan: int = FAN, levels: int = LEVELS):
        self.fan, self.levels, self.size = fan, levels, fan ** levels
        self.entries = entries.withColumn("block", F.floor(F.col("idx") / self.size))
        self.passes: list[DataFrame] = []
        now = self.entries.select("tree", "idx", "block", "digest", "n")
        most = now.agg(F.max("n")).first()[0] or 0
        while True:
            out = stored(now.groupBy("tree", "block").applyInArrow(self._builder(), (
                "tree string, block long, n long, levels int, log array<string>, digest string")), "merkle-log")
            self.passes.append(out)
            most = -(-most // self.size)
            if most <= 1:
                break
            now = out.where(F.col("n") > self.size).select(
                "tree", F.col("block").alias("idx"), F.floor(F.col("block") / self.size).alias("block"), "digest",
                F.ceil(F.col("n") / self.size).alias("n"))
        ends = [p.where(F.col("n") <= self.size).select("tree", "digest") for p in self.passes]
        self.roots = ends[0]
        for e in ends[1:]:
            self.roots = self.roots.unionByName(e)

    def _builder(self):
        fan, levels, size = self.fan, self.levels, self.size

        def build(t: pa.Table) -> pa.Table:
            t = t.sort_by("idx")
            n = t.column("n")[0].as_py()
            up = height(t.num_rows, fan) if n <= size else levels
            log = append_log(t.column("digest").to_pylist(), up, fan)
            return pa.table({"tree": t.column("tree").slice(0, 1).cast(pa.string()), "block": t.column("block").slice(0, 1),
                             "n": pa.array([n], pa.int64()), "levels": pa.array([up], pa.int32()),
                             "log": pa.array([log], pa.list_(pa.string())), "digest": pa.array([log[-1]])})
        return build

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, block) of the first pass with ``path``, the siblings above
        its builder's last node, and the columns of ``above`` (tree, path
        above the tree's root, others)."""
        others = [c for c in above.columns if c not in ("tree", "path")]
        here = self.passes[-1].select("tree", "block").join(above, "tree")
        for entries, logs in zip(self.passes[-2::-1], self.passes[:0:-1]):
            own = entries.select("tree", F.col("block").alias("idx"), F.floor(F.col("block") / self.size).alias("block"), "n")
            down = self._extract(own.where(F.col("n") > self.size).drop("n"), logs, here, others)
            done = entries.where(F.col("n") <= self.size).select("tree", "block").join(above, "tree")
            here = down.select("tree", F.col("idx").alias("block"), "path", *others).unionByName(
                done.select("tree", "block", "path", *others))
        return here

    def _extract(self, entries: DataFrame, logs: DataFrame, above: DataFrame, others: list[str]) -> DataFrame:
        """Entries with the whole path above them."""
        fan = self.fan

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            at = left.column("idx").to_numpy() % size
            log, up, n = (right.column(c)[0].as_py() for c in ("log", "levels", "m"))
            sib = siblings(log, n, up, fan)
            top = right.column("path")[0].as_py()
            path = [[*({"left": s[i // fan ** k][0], "right": s[i // fan ** k][1]} for k, s in enumerate(sib)), *top] for i in at.tolist()]
            cols = {"tree": left.column("tree"), "idx": left.column("idx"), "path": pa.array(path, _path_type())}
            for c in others:
                cols[c] = pa.array([right.column(c)[0].as_py()] * left.num_rows, right.schema.field(c).type)
            return pa.table(cols)

        size = self.size
        types = "".join(f", {c} {above.schema[c].dataType.simpleString()}" for c in others)
        right = logs.join(above, ["tree", "block"]).withColumn("m", _entries_of(self.size))
        return (entries.groupBy("tree", "block").cogroup(right.groupBy("tree", "block"))
                .applyInArrow(run, f"tree string, idx long, path {_PATH}{types}"))


def _entries_of(size: int) -> Column:
    """Entries of a builder: a whole block, or what is left for the last."""
    return F.least(F.lit(size), F.col("n") - F.col("block") * size).cast("long")


def _path_type() -> pa.DataType:
    return pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


# --- the manifest -----------------------------------------------------------

def numbered(leaves: DataFrame, by: list[str]) -> DataFrame:
    """Leaves of stored trees with idx, their number in the tree, and n."""
    placed = ordinal(leaves, by, parts=("tree",), name="idx", tie=F.monotonically_increasing_id())
    return placed.withColumn("idx", F.col("idx") - 1).withColumnRenamed("_total", "n")


class Manifest:
    """Logs of all sources and of the tree above them; ``root`` holds the
    one digest that stands for the dataset.

    leaves: source, key, digest, and other columns, which proofs keep."""

    def __init__(self, leaves: DataFrame, fan: int = FAN, levels: int = LEVELS):
        self.fan, self.levels = fan, levels
        own = leaves.withColumn("tree", tree_of(F.col("source"))).drop("source")
        self.trees = Logs(numbered(stored(own, "merkle-leaves"), ["key", "digest"]), fan, levels)
        tops = self.trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        self.top = Logs(numbered(stored(tops, "merkle-roots"), ["name"]), fan, levels)
        self.root = self.top.roots.select(F.col("digest").alias("root"))

    def paths(self) -> DataFrame:
        """(tree, block) of the builders over leaves, with path, subroot, root."""
        above = self.top.roots.select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
        by_block = self.top.paths(above)
        every = self.top._extract(self.top.entries.select("tree", "idx", "block"), self.top.passes[0], by_block, ["root"])
        tops = self.top.entries.select("idx", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
        return self.trees.paths(every.select("idx", "path", "root").join(tops, "idx").drop("idx"))

    def proofs(self) -> DataFrame:
        """Every leaf with ``key``, ``leaf``, ``subroot``, ``root``,
        ``proof_sha256`` and ``folded_root``, from the leaf's column
        ``claimed``, a digest to be verified (null: its own)."""
        fan, size = self.fan, self.fan ** self.levels

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            log, up, n, subroot, root = (right.column(c)[0].as_py() for c in ("log", "levels", "m", "subroot", "root"))
            sib = siblings(log, n, up, fan)
            top = [(p["left"], p["right"]) for p in right.column("path")[0].as_py()]
            tail = "".join(a + b for a, b in top)
            at = (left.column("idx").to_numpy() % size).tolist()
            leaf, claimed = left.column("digest").to_pylist(), left.column("claimed").to_pylist()
            proof, folded = [], []
            for i, own, new in zip(at, leaf, claimed):
                path = [s[i // fan ** k] for k, s in enumerate(sib)]
                proof.append(sha("".join(a + b for a, b in path) + tail))
                folded.append(fold(fold(new or own, path), top))
            rows = left.num_rows
            return pa.table({"key": left.column("key"), "leaf": left.column("digest"), "subroot": pa.array([subroot] * rows),
                             "root": pa.array([root] * rows), "proof_sha256": pa.array(proof), "folded_root": pa.array(folded)})

        logs = self.trees.passes[0].drop("digest").join(self.paths(), ["tree", "block"]) \
            .withColumn("m", _entries_of(size))
        leaves = self.trees.entries.select("tree", "block", "idx", "key", "digest", "claimed")
        key = leaves.schema["key"].dataType.simpleString()
        return (leaves.groupBy("tree", "block").cogroup(logs.groupBy("tree", "block"))
                .applyInArrow(run, f"key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"))


def tampered(docs: DataFrame) -> DataFrame:
    """Leaves of documents; every second one (by its id's checksum) claims
    the digest of its text without newline signs."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    less = F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))
    return docs.select(F.col("source"), F.col("doc_id").cast("long").alias("key"), row_digest().alias("digest"),
                       F.when(odd & F.contains(F.col("text").cast("string"), F.lit("\n")), row_digest(text=less)).alias("claimed"))


def verified(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Proofs of all documents, and whether what they claim folds to the root."""
    got = Manifest(tampered(docs), fan, levels).proofs()
    return got.withColumnRenamed("key", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))
