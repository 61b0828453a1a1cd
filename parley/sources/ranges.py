"""Work and tables by key ranges, with a log that says what counts.

A long run of model calls must survive a stop (A-7, I-5), and a label
upsert should write what it changes (A-14). Both cut a key into ranges of
about as many rows, write a range's files under a name of their own, and
then enter that name in a log. A log entry is one small file, so it is there
or not: files of a run that broke off before its entry are never read. The
log is read anew by every call, so any driver run goes on where others
stopped. One writer at a time; readers need not wait.

Ranges are half open, the first without a lower and the last without an
upper end, so every key, old or new, is in exactly one; null keys are in the
first. A key with more rows than a range should have is one range.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.shaping import ntile_parts


class Log:
    """Entries (seq, part, folder) under a folder, one file per ``enter``."""

    SCHEMA = "seq long, part int, folder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def enter(self, folder: str, parts: list[int]) -> None:
        seq = max((r.seq for r in self._rows()), default=0) + 1
        self.spark.createDataFrame([(seq, p, folder) for p in parts], self.SCHEMA).coalesce(1) \
            .write.parquet(f"{self.path}/{seq:09d}-{uuid.uuid4().hex}")

    def _rows(self) -> list:
        try:
            return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.path).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def folders(self) -> dict[int, str]:
        """The last folder entered for each part."""
        return {r.part: r.folder for r in sorted(self._rows(), key=lambda r: (r.seq, r.folder))}


class Ranges:
    """Bounds of a key, kept beside the data so that every run uses the same."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")

    def _bounds(self) -> list | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/bounds").collect()         # one per range
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return sorted(r.lo for r in rows)

    def _cut(self, df: DataFrame, key: str, parts: int) -> list:
        """The bounds; taken from ``df`` and kept if there are none."""
        have = self._bounds()
        if have is None:
            keys = df.select(F.col(key).alias("lo")).where("lo is not null")
            first = ntile_parts(keys, "lo", parts).groupBy("part").agg(F.min("lo").alias("lo")).select("lo").distinct()
            first.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bounds")
            have = self._bounds()
        return have

    @staticmethod
    def _within(key: str, bounds: list, part: int) -> Column:
        c = F.col(key)
        up = c < F.lit(bounds[part + 1]) if part + 1 < len(bounds) else F.lit(True)
        if part:
            return (c >= F.lit(bounds[part])) & up
        return c.isNull() | up

    @staticmethod
    def _part_of(key: str, bounds: list) -> Column:
        """Number of the range that holds a key."""
        above = [F.when(F.col(key) >= F.lit(b), 1).otherwise(0) for b in bounds[1:]]
        return reduce(lambda a, b: a + b, above, F.lit(0)).cast("int")


class RangeRun(Ranges):
    """A run over a table in parts, which goes on after a stop."""

    def run(self, df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], parts: int,
            at_most: int | None = None) -> int:
        """Do ``work`` on every range of ``df`` not yet in the log: its
        result is written with a column ``batch_id`` (the range) and
        entered. Returns how many ranges it did (``at_most``: and stops)."""
        bounds = self._cut(df, key, parts)
        done, n = self.log.folders(), 0
        for part in range(max(1, len(bounds))):
            if part in done:
                continue
            if at_most is not None and n == at_most:
                break
            folder = f"part-{part:05d}-{uuid.uuid4().hex[:12]}"
            work(df.where(self._within(key, bounds, part))).withColumn("batch_id", F.lit(part)) \
                .write.parquet(f"{self.path}/{folder}")
            self.log.enter(folder, [part])
            n += 1
        return n

    def pending(self) -> list[int]:
        """Ranges without an entry."""
        done = self.log.folders()
        return [p for p in range(max(1, len(self._bounds() or []))) if p not in done]

    def result(self) -> DataFrame:
        """All finished parts together."""
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in self.log.folders().values()])


class RangeTable(Ranges):
    """A table whose rows are replaced range by range."""

    def create(self, df: DataFrame, key: str, parts: int) -> None:
        bounds = self._cut(df, key, parts)
        self._write(df, key, bounds)

    def _write(self, rows: DataFrame, key: str, bounds: list) -> list[int]:
        """Writes whole ranges into one folder, then enters all of them at once."""
        folder = f"rows-{uuid.uuid4().hex[:12]}"
        rows.withColumn("_part", self._part_of(key, bounds)).repartitionByRange(F.col(key)) \
            .write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        parts = [r[0] for r in self.spark.read.parquet(f"{self.path}/{folder}").select("_part").distinct().collect()]
        self.log.enter(folder, sorted(parts))
        return sorted(parts)

    def _paths(self, parts: set[int] | None = None) -> list[str]:
        return [f"{self.path}/{f}/_part={p}" for p, f in sorted(self.log.folders().items()) if parts is None or p in parts]

    def read(self) -> DataFrame:
        """The rows that the log's last entries name."""
        return self.spark.read.parquet(*self._paths())

    def upsert(self, changes: DataFrame, key: str, columns: list[str], order: str | None = None) -> list[int]:
        """Set ``columns`` of the rows that ``changes`` names; returns the
        ranges written. A NULL leaves the old value; keys that the table
        does not have are ignored; of several changes of a key the last by
        ``order`` counts (without one, the largest).

        Two passes: one over the key and the columns, of the ranges that the
        changes fall into, tells which ranges hold a row that will differ;
        only those are read whole and written. The same changes again write
        nothing."""
        bounds = self._bounds()
        value = F.struct(*[F.col(c) for c in columns])
        new = changes.groupBy(key).agg((F.max_by(value, order) if order else F.max(value)).alias("_new"))
        near = {r[0] for r in new.select(self._part_of(key, bounds)).distinct().collect()}       # at most one per range
        paths = self._paths(near)
        if not paths:
            return []
        now = self.spark.read.parquet(*paths).select(key, *columns).join(new, key)
        differs = reduce(lambda a, b: a | b, [F.col(f"_new.{c}").isNotNull() & ~F.col(f"_new.{c}").eqNullSafe(F.col(c)) for c in columns])
        hit = {r[0] for r in now.where(differs).select(self._part_of(key, bounds)).distinct().collect()}
        if not hit:
            return []
        rows = self.spark.read.parquet(*self._paths(hit))
        set_ = {c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in columns}
        return self._write(rows.join(new, key, "left").withColumns(set_).select(*rows.columns), key, bounds)
