"""Quoted CSV files read by splits (A-1, A-6).

A record may hold line ends between quotes, so a reader that starts in the
middle of a file does not know whether a line starts a record; the built-in
reader therefore takes such a file as one task. Here files are scanned as
lines, which Spark splits. To a line there are two ways to start: a record,
or the inside of a quoted field. What it does to either (where the line
after it starts) is a small function, and functions of lines compose, so:

1. one scan composes the functions of each split, told apart by the file
   and the place of its first byte;
2. running compositions over the splits of a file (one row per split) tell
   how each split starts;
3. a second scan cuts each split into records. The lines before its first
   and after its last record start belong to a record that crosses into
   other splits; these few are put together by (file, record).

Each record is then parsed by ``from_csv`` with the same options as the
whole-file reader. A quote opens a field only as its first sign; after the
closing quote other signs up to the next comma count as they do there.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import stored

#: A line may start a record (0) or go on inside quotes (1).
RECORD, INSIDE = 0, 1

# A quoted field from its quote, or from the start of a line inside it.
_CLOSED = re.compile(r'"(?:[^"]++|"")*+"')
_REST = re.compile(r'(?:[^"]++|"")*+"')


def line_end(line: str, start: int) -> int:
    """How the line after this one starts, if this one starts so."""
    at, n = 0, len(line)
    if start == INSIDE:
        close = _REST.match(line)
        if not close:
            return INSIDE
        at = line.find(",", close.end())
        if at < 0:
            return RECORD
        at += 1
    while at <= n:
        if line.startswith('"', at):
            close = _CLOSED.match(line, at)
            if not close:
                return INSIDE
            at = close.end()
        at = line.find(",", at)
        if at < 0:
            return RECORD
        at += 1
    return RECORD


def _ends(line: str) -> tuple[int, int]:
    if '"' not in line:
        return RECORD, INSIDE
    return line_end(line, RECORD), line_end(line, INSIDE)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte) and line, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _runs(batch: pa.RecordBatch):
    """(file, split, lines) of each run of one split's lines."""
    files, splits, lines = (c.to_pylist() for c in batch.columns[:3])
    lo = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or (files[i], splits[i]) != (files[lo], splits[lo]):
            yield files[lo], splits[lo], lines[lo:i], lo
            lo = i


def _compose(batches):
    """file, split, how what follows starts if the split starts a record
    (f0) or inside quotes (f1), and whether it starts a file whose first
    line ends in CR LF, of each run of lines a task sees."""
    key, f, crlf = None, (RECORD, INSIDE), False

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([f[0]], pa.int32()),
             pa.array([f[1]], pa.int32()), pa.array([crlf], pa.bool_())], ["file", "split", "f0", "f1", "crlf"])

    for b in batches:
        for file, split, lines, _ in _runs(b):
            if key != (file, split):
                if key:
                    yield row()
                key, f, crlf = (file, split), (RECORD, INSIDE), split == 0 and lines[0].endswith("\r")
            for line in lines:
                if '"' in line:
                    g = _ends(line)
                    f = (g[f[0]], g[f[1]])
    if key:
        yield row()


_PIECE = "file string, split long, kind int, first boolean, crlf boolean, text string"
#: Kinds of pieces: a whole record, the lines before a split's first record
#: start, those from its last one on if it goes on, a split inside a record.
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3


def _cut(batches):
    """Pieces of each split, whose rows carry how the split starts;
    ``first``: of the first record of a file."""
    out: list[tuple] = []
    key, state, held, started, first, crlf = None, RECORD, [], False, False, False

    def close():
        if held:
            kind = (TAIL if started else MIDDLE) if state == INSIDE else (WHOLE if started else HEAD)
            out.append((*key, kind, first, crlf, "\n".join(held)))

    def batch():
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
        cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["file", "split", "kind", "first", "crlf", "text"])

    for b in batches:
        starts, ends = b.column(3).to_pylist(), b.column(4).to_pylist()
        for file, split, lines, at in _runs(b):
            if key != (file, split):
                close()
                key, state, held, started, first, crlf = (file, split), starts[at], [], False, split == 0, ends[at]
            for line in lines:
                if state == RECORD:
                    close()
                    first = first and not started
                    held, started = [], True
                held.append(line)
                state = line_end(line, state) if '"' in line else state
            if len(out) >= 1000:
                yield batch()
    close()
    if out:
        yield batch()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(first, crlf, text): every record of the CSV files under ``path``;
    ``first``: a file's first one, its header if it has one; ``crlf``: the
    file's lines end in CR LF."""
    lines = _lines(spark, path)
    scans = stored(lines.mapInArrow(_compose, "file string, split long, f0 int, f1 int, crlf boolean"), "csv-splits")
    # A split leads to one start whatever its own (f0 = f1), leaves the start as it is, or turns it round.
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("f0") == F.col("f1"), F.struct("split", F.col("f0").alias("to")))
    turns = F.when(F.col("f0") > F.col("f1"), 1).otherwise(0)
    s = scans.withColumns({"last": F.max(fixed).over(before), "turned": F.sum(turns).over(before),
                           "since": F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    then = s.select(F.col("file").alias("_f"), F.col("split").alias("_s"), F.col("since").alias("_turned"))
    s = s.join(then, (F.col("file") == F.col("_f")) & (F.col("last.split") == F.col("_s")), "left")
    turned = F.coalesce("turned", F.lit(0)) - F.coalesce("_turned", F.lit(0))
    crlf = F.max("crlf").over(Window.partitionBy("file")).alias("crlf")
    starts = s.select("file", "split", crlf, ((F.coalesce("last.to", F.lit(RECORD)) + turned) % 2).cast("int").alias("start"))

    known = lines.withColumn("_n", F.monotonically_increasing_id()).join(starts, ["file", "split"])
    known = known.sortWithinPartitions("file", "split", "_n").select("file", "split", "line", "start", "crlf")
    pieces = stored(known.mapInArrow(_cut, _PIECE), "csv-pieces")

    # A record that crosses splits: a tail, any number of splits inside it, a head (or the file ends).
    ends = pieces.where(F.col("kind") != WHOLE)
    opened = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbers = ends.select("file", "split", "kind").withColumn("_no", opened)
    crossing = (ends.join(numbers, ["file", "split", "kind"]).groupBy("file", "_no")
                .agg(F.max("first").alias("first"), F.max("crlf").alias("crlf"), F.array_sort(F.collect_list(F.struct("split", "text"))).alias("parts")))
    crossing = crossing.select("first", "crlf", F.array_join(F.col("parts.text"), "\n").alias("text"))
    return pieces.where(F.col("kind") == WHOLE).select("first", "crlf", "text").unionByName(crossing)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """As ``spark.read.options(**options).schema(schema).csv(path)``, but a
    file is as many tasks as it has splits. Empty lines are no records; with
    ``header`` the first record of each file is left out. Where lines end in
    CR LF, it becomes LF in fields too, as there."""
    text = F.when(F.col("crlf"), F.replace(F.regexp_replace("text", "\\r\\z", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    every = records(spark, path).withColumn("text", text).where("text <> ''")
    if options.get("header", "false").lower() == "true":
        every = every.where("not first")
    own = {k: v for k, v in options.items() if k != "header"}
    return every.select(F.from_csv("text", F.lit(schema.simpleString()[7:-1].replace(":", " ")), own).alias("r")).select("r.*")
