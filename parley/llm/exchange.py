"""Which keys of a corpus occur in more than one document.

Texts are written once as *pieces*: runs of whole documents of about a
megabyte, one row each, compressed. Every piece sends its distinct keys,
packed, to key buckets; a bucket finds the keys that two documents hold
and answers each piece with those of its own. What comes back meets the
piece in a cogroup by piece. A key that a third of all documents hold is
thus one entry for each piece, in and out, and no task holds more than a
bucket or a few pieces; whatever moves texts moves them compressed.

A bucket keeps 47 bits of a key; equal bits of different keys only make a
key look shared, which costs work and changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.session import stored

U64 = np.uint64
PIECE_BYTES = 1 << 20
#: Bytes of text for each key bucket.
BUCKET_BYTES = 16 << 20

#: (bytes, row offsets) -> (keys, row of each)
KeysFn = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def write_pieces(docs: DataFrame, compute=None, columns: tuple[tuple[str, str], ...] = (), carry: bool = False) -> DataFrame:
    """One row per piece: piece, n_bytes, blob, and for its documents the
    arrays doc_id and ``columns`` (name, type), which ``compute(bytes,
    offsets)`` gives. The blob holds the documents themselves, compressed:
    doc_id and text, with ``carry`` the other columns of docs too."""
    names = [n for n, _ in columns]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      *([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)
                         if not _is_own(docs.schema.fields[i])] if carry else []))

    def run(batches):
        from pyspark import TaskContext
        piece = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, data, off in tv.pieces(b.column(1), PIECE_BYTES):
                part = b.slice(lo, hi - lo)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                more = compute(data, off) if compute else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece], pa.int64()), pa.array([len(data)], pa.int64()),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                     pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                     *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in more]],
                    ["piece", "n_bytes", "blob", "doc_id", *names])
                piece += 1

    schema = "piece long, n_bytes long, blob binary, doc_id array<long>" + "".join(f", {n} array<{t}>" for n, t in columns)
    return stored(own.mapInArrow(tv.tidy(run), schema), "pieces")


def _is_own(field) -> bool:
    return (field.name, field.dataType.simpleString()) in (("doc_id", "bigint"), ("text", "string"))


def open_piece(table: pa.Table) -> pa.RecordBatch | None:
    """The documents of the piece in a one-row table; None without one."""
    if not table.num_rows:
        return None
    return pa.ipc.open_stream(table.column("blob")[0].as_buffer()).read_next_batch()


def rows(table: DataFrame, *columns: str) -> DataFrame:
    """piece, row, doc_id and columns of every document, without texts."""
    return (table.select("piece", F.posexplode(F.arrays_zip("doc_id", *columns)).alias("row", "x"))
            .select("piece", "row", "x.doc_id", *[f"x.{c}" for c in columns]))


def carried(batch: pa.RecordBatch, schema) -> list[pa.Array]:
    """The columns of docs, as they were, in the order of ``schema``."""
    return [batch.column(f.name if _is_own(f) else f"c{i}") for i, f in enumerate(schema)]


def bucket_count(table: DataFrame, at_least: int = 12) -> int:
    """Buckets for a pieces table, by its bytes."""
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    return min(1 << 17, max(at_least, math.ceil(total / BUCKET_BYTES)))


def pack48(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(U64)


def fold(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What an answer can tell of a key: its top 47 bits and its bucket."""
    return (keys >> U64(17)) * U64(buckets) + keys % U64(buckets)


#: What a piece sends to a key bucket.
SENT = "bucket int, piece long, vals binary"
_SENT = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("vals", pa.binary())])


def sent(piece: int, key: np.ndarray, row: np.ndarray, buckets: int):
    """``SENT`` of the keys of a piece's rows, as a record batch if any."""
    if not len(key):
        return
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], len(key)] - 1
    many = row[first] != row[last]          # two documents of this piece
    key = key[first]
    where = key % U64(buckets)
    vals = ((key >> U64(17)) << U64(1)) | many.astype(U64)
    order = np.argsort(where, kind="stable")
    where, vals = where[order], vals[order]
    at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    ends = np.r_[at[1:], len(where)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(where[at].astype(np.int32)), pa.array(np.full(len(at), piece, np.int64)),
         pa.array([pack48(vals[s:e]) for s, e in zip(at, ends)], pa.binary())],
        ["bucket", "piece", "vals"])


def answers(up: DataFrame) -> DataFrame:
    """Of what pieces have ``sent``, to each piece those of its keys that
    two rows hold: see ``shared_keys``."""
    def answer(t: pa.Table) -> pa.Table:
        got = [unpack48(v.as_py()) for v in t.column("vals")]
        sizes = [len(g) for g in got]
        v = np.concatenate(got)
        whose = np.repeat(np.arange(len(got)), sizes)
        order = np.argsort(v >> U64(1), kind="stable")
        key = v[order] >> U64(1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        two = (n >= 2) | (np.maximum.reduceat(v[order] & U64(1), first) > 0)
        keep = np.repeat(two, n)
        out = (key << U64(16)) | np.repeat(np.minimum(n, 0xFFFF), n).astype(U64)
        out, to = out[keep], whose[order][keep]
        order = np.argsort(to, kind="stable")
        out, to = out[order], to[order]
        at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        ends = np.r_[at[1:], len(to)]
        piece = t.column("piece").to_numpy()
        return pa.table({"piece": pa.array(piece[to[at]], pa.int64()),
                         "bucket": pa.array(np.full(len(at), t.column("bucket")[0].as_py(), np.int32)),
                         "vals": pa.array([out[s:e].tobytes() for s, e in zip(at, ends)], pa.binary())})

    return up.groupBy("bucket").applyInArrow(answer, "piece long, bucket int, vals binary")


def shared_keys(table: DataFrame, keys_fn: KeysFn, buckets: int, rows: DataFrame, only: bool) -> DataFrame:
    """piece, bucket, vals: for each piece its keys that two documents
    hold, each with the number of pieces that hold it (47 and 16 bits).
    ``rows`` (piece, rows) lists the documents that count, unless ``only``
    those that do not: copies would make all of a text look shared. The
    answers are stored, so what was sent is gone when they meet the pieces."""
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        batch, out = open_piece(left), []
        if batch is not None:
            listed = np.unique(np.array([r for x in right.column("rows").to_pylist() for r in x], np.int64))
            take = listed if only else np.setdiff1d(np.arange(batch.num_rows), listed)
            for _, _, data, off in tv.pieces(batch.column("text").take(pa.array(take, pa.int64())), 1 << 62):   # the piece as one
                out += sent(left.column("piece")[0].as_py(), *keys_fn(data, off), buckets)
        return pa.Table.from_batches(out, _SENT)

    up = (table.select("piece", "blob").groupBy("piece").cogroup(rows.select("piece", "rows").groupBy("piece"))
          .applyInArrow(send, SENT))
    return stored(answers(up), "answers")


def open_answers(right: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted folded keys, pieces that hold each) of one piece's answers."""
    parts, held = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for b, v in zip(right.column("bucket").to_pylist(), right.column("vals").to_pylist()):
        if b is None or v is None or b < 0:
            continue
        x = np.frombuffer(v, U64)
        parts.append((x >> U64(16)) * U64(buckets) + U64(b))
        held.append((x & U64(0xFFFF)).astype(np.int64))
    k, n = np.concatenate(parts), np.concatenate(held)
    order = np.argsort(k)
    return k[order], n[order]


def member(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is in, index) of x in sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x, at

