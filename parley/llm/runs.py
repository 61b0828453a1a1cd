"""Periodic runs of words, by suffix trees, and their collapse.

A run is a stretch of words with smallest period q that neither neighbour
extends. Every run holds, at its Lyndon root, a longest Lyndon word of one
of two letter orders (the given one, or its reverse), so the pairs (i, end
of the longest Lyndon word at i) are all candidates: at most two per word.
The longest Lyndon word at i ends where the next smaller suffix starts. A
candidate (i, j) has period j - i and is extended right by the longest
common extension of the suffixes i and j, and left by that of the prefixes
that end there.

Ukkonen's algorithm builds the suffix trees of the words and of their
reversal. An in-order Euler tour (a leaf, the branching node above it and
its right neighbour, the next leaf ...) gives the order of the suffixes and
the depth of every lowest common ancestor as a range minimum, answered in
constant time from a sparse table, for all candidates at once.

``least`` is the exponent a run must reach, ``shortest`` its words. They
tell where runs can be: all of a run but its last q words come again within
q words, and these are ``least - 1`` periods at least. So only stretches in
which every word recurs within 1/(least - 1) of the stretch's length can
hold a run; what is left after striking all other words until nothing
changes is searched, each stretch with a tail of that length. This loses no
run: its words are never struck, and the words beside it end it.

Work is row by row within scan batches; nothing is shuffled. A document is
in memory by itself, with some hundred bytes a word of its stretches.

Edge cases: a null or empty text has no words, no run and the digest of an
empty string; repeated rows are treated each; a null doc_id is never edited;
an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv

#: Words that a batch's searches take at once.
BATCH_WORDS = 1 << 18

SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, n_dropped long, edited boolean")


# --- suffix trees -----------------------------------------------------------

class SuffixTree:
    """Ukkonen's suffix tree of a list of positive integers and an end sign
    0 that is smaller. Nodes are numbers; their fields are lists; all edges
    are in one table by (node, first sign)."""

    def __init__(self, signs: list[int]):
        self.t = t = [*signs, 0]
        self.n = n = len(t)
        self.start, self.end, self.link = [0], [0], [0]     # edge into a node; a leaf's end is n
        start, end, link = self.start, self.end, self.link
        self.base = base = max(t) + 1
        self.edge = edge = {}
        node, at, length, rest = 0, 0, 0, 0                 # active point, suffixes to come
        for i, c in enumerate(t):
            rest += 1
            last = 0
            while rest:
                if not length:
                    at = i
                key = node * base + t[at]
                to = edge.get(key)
                if to is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = node
                else:
                    size = (end[to] if end[to] <= i else i + 1) - start[to]
                    if length >= size:                      # walk down
                        at += size
                        length -= size
                        node = to
                        continue
                    if t[start[to] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start.append(start[to])
                    end.append(start[to] + length)
                    link.append(0)
                    edge[key] = split
                    edge[split * base + c] = split + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    start[to] += length
                    edge[split * base + t[start[to]]] = to
                    if last:
                        link[last] = split
                    last = split
                rest -= 1
                if not node and length:
                    length -= 1
                    at = i - rest + 1
                elif node:
                    node = link[node]

    def tour(self, downward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, depths of the nodes between neighbours).
        ``downward``: signs by falling value, the end sign still first."""
        base, start, end, n = self.base, self.start, self.end, self.n
        keys = np.fromiter(self.edge.keys(), np.int64, len(self.edge))
        to = np.fromiter(self.edge.values(), np.int64, len(self.edge))
        sign = keys % base
        if downward:
            sign = np.where(sign == 0, 0, base - sign)
        order = np.lexsort((sign, keys // base))
        parents, to = (keys // base)[order], to[order].tolist()
        first = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        leaves, between = [], []
        stack = [(0, first[0], 0)]                          # node, next child, depth
        while stack:
            v, k, depth = stack.pop()
            if k > first[v]:
                between.append(depth)                       # back between two children
            child = to[k]
            if k + 1 < first[v + 1]:
                stack.append((v, k + 1, depth))
            below = depth + end[child] - start[child]
            if end[child] == n:                             # only leaves end there
                leaves.append(n - below)
            else:
                stack.append((child, first[child], below))
        return np.array(leaves, np.int64), np.array(between, np.int32)


class Extensions:
    """Longest common extensions of suffixes: range minima over a tour."""

    def __init__(self, leaves: np.ndarray, between: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.rows = [between]
        while 2 << (len(self.rows) - 1) <= len(between):
            half, x = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(x[:-half], x[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common length of suffixes i and j, i != j; 0 for one past the end."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.rows[k][lo[m]], self.rows[k][hi[m] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix, the start of the next one that is smaller."""
    out, stack = np.zeros(len(rank), np.int64), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return out                                              # the end sign, the smallest, closes all but itself


def find_runs(words: np.ndarray, least: int = 2, shortest: int = 2) -> np.ndarray:
    """(start, length, period) of the runs of an array of positive word
    numbers, by start, then period."""
    n = len(words)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    left = Extensions(*SuffixTree(words[::-1].tolist()).tour())
    tree = SuffixTree(words.tolist())
    right = Extensions(*tree.tour())
    down = np.empty(n + 1, np.int64)
    down[tree.tour(downward=True)[0]] = np.arange(n + 1)
    del tree
    found = []
    for rank in (right.rank, down):
        i = np.arange(n)
        j = next_smaller(rank)[:n]
        period = j - i
        before = left(n - i, n - j)                         # of what ends before i and before j
        start, end = i - before, j + right(i, j)
        ok = (end - start >= np.maximum(shortest, least * period))
        found.append(np.stack([start, end - start, period], 1)[ok])
    return _sorted(np.unique(np.concatenate(found), axis=0))


def _sorted(runs: np.ndarray) -> np.ndarray:
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


# --- where runs can be ------------------------------------------------------

def stretches(words: np.ndarray, least: int = 4, shortest: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of a word array that can hold all of
    a run but its last period; word numbers of different documents differ."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    same = words[order][:-1] == words[order][1:]
    gap = np.full(n, n + 1, np.int64)                       # to the next equal word
    gap[order[:-1][same]] = np.diff(order)[same]
    at = np.flatnonzero(gap <= n)
    least_words = max(shortest - shortest // least, least - 1)      # of any run, without its last period
    while len(at):
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        first = np.r_[0, cut]
        size = np.diff(np.r_[first, len(at)])
        keep = np.repeat(size, size)
        keep = (keep >= least_words) & (gap[at] <= keep // (least - 1))
        if keep.all():
            return at[first], at[first] + size
        at = at[keep]
    return at, at


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = 4, shortest: int = 6) -> list[np.ndarray]:
    """The runs of each document of a word array; bounds: its documents."""
    out = [[] for _ in range(len(bounds) - 1)]
    starts, ends = stretches(words, least, shortest)
    for s, e, d in zip(starts.tolist(), ends.tolist(), (np.searchsorted(bounds, starts, "right") - 1).tolist()):
        stop = min(int(bounds[d + 1]), e + (e - s) // (least - 1) + 1)
        numbers = np.unique(words[s:stop], return_inverse=True)[1].reshape(-1) + 1
        got = find_runs(numbers, least, shortest)
        got = got[got[:, 0] < e - s]                        # later ones belong to the next stretch
        got[:, 0] += s - bounds[d]
        out[d].append(got)
    return [_sorted(np.concatenate(x)) if x else np.zeros((0, 3), np.int64) for x in out]


# --- documents --------------------------------------------------------------

def edit_of(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) from which a document's words are made periodic:
    one document in ten."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(step)[:-1] == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def _row(doc_id, words: list[bytes], runs: np.ndarray, edited: bool) -> tuple:
    kept = collapse(words, runs)
    top = (None,) * 4
    if len(runs):
        s, size, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        top = (s, size, q, 1000 * size // q)
    listed = "".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist())
    return (doc_id, len(words), len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest(), len(words) - len(kept), edited)


def _rows(docs: list[tuple], least: int, shortest: int) -> list[tuple]:
    """Rows of (doc_id, words, edited) documents, searched together."""
    flat, bounds = [], [0]
    for _, words, _ in docs:
        number = defaultdict(count(len(flat) + 1).__next__)     # of its own: numbers of documents do not meet
        flat += map(number.__getitem__, words)
        bounds.append(len(flat))
    found = runs_of(np.array(flat, np.int64), np.array(bounds), least, shortest)
    return [_row(d, words, runs, e) for (d, words, e), runs in zip(docs, found)]


def periodic_runs(docs: DataFrame, edit: bool = True, least: int = 4, shortest: int = 6) -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all
    runs and of the collapsed text; ``edit`` makes one document in ten
    periodic from some word on."""
    def run(batches):
        for b in batches:
            todo, size = [], 0
            for lo, hi, data, off in tv.pieces(b.column(1)):
                text = data.tobytes()
                for k, d in enumerate(b.column(0).slice(lo, hi - lo).to_pylist()):
                    words = text[off[k]:off[k + 1]].split()     # ASCII white space
                    to = edit_of(d, len(words)) if edit else None
                    if to:
                        a, p = to
                        unit, left = words[a:a + p], len(words) - a
                        words[a:] = (unit * (left // p + 1))[:left]
                    todo.append((d, words, to is not None))
                    size += len(words)
                    if size >= BATCH_WORDS:
                        yield _batch(_rows(todo, least, shortest))
                        todo, size = [], 0
            if todo:
                yield _batch(_rows(todo, least, shortest))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(tv.tidy(run), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, kinds = zip(*(f.split() for f in SCHEMA.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], list(names))
