"""Token-count rollups kept up to date by signed deltas.

A change is an insert, a delete or a revision of one document's count;
it becomes signed rows (a revision is minus the old and plus the new).
A commit adds up a batch's deltas by (source, lang, tokenizer) map-side,
writes them as one small table and then enters the batch's name and table
in a log under the path. The last table entered for a name is the one that
counts, so a batch committed again (a retry, a replay) replaces itself and
totals stay right. Totals are the sum over these tables: they are additive,
so no earlier text or count is read again. ``compact`` folds the batches
into one base table and enters it in the log with all their names; they
are not counted again. Every call reads the log, so any driver run goes on
where others stopped, and a run that breaks off before its entry has
changed nothing. Tables that were replaced or folded stay in the folder.

Native DataFrame functions only. Edge cases: null source and lang are
groups of their own; null counts count as 0; a group whose documents all
went stays with zeros (``docs = 0``) unless ``drop_empty``; an empty batch
commits an empty table.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Entries of the log: a batch's table, or (``base``) a base table, in a row
#: without a batch and a row for each batch that is part of it.
LOG = "seq long, id string, batch string, table string, base boolean"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed rows of changes (op, source, lang, tokenizer, old_tokens,
    new_tokens): ``insert`` adds new, ``delete`` takes old away, ``revise``
    does both with no change in documents."""
    op = F.col("op")
    sign = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    gain = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old).otherwise(0)
    return changes.select(*KEYS, sign.cast("long").alias("docs"), gain.cast("long").alias("tokens"))


class Rollup:
    """A rollup kept under ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> tuple[int, dict[str, str], str | None, set[str]]:
        """Entries so far, table of each batch outside the base, base table,
        batches in it."""
        try:
            rows = (self.spark.read.schema(LOG).option("recursiveFileLookup", "true")
                    .parquet(f"{self.path}/log").collect())         # names only
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        rows.sort(key=lambda r: (r.seq, r.id))
        base = next((r for r in reversed(rows) if r.base), None)
        folded = {r.batch for r in rows if base and r.id == base.id and r.batch is not None}
        live = {r.batch: r.table for r in rows if not r.base and r.batch not in folded}
        return max((r.seq for r in rows), default=0), live, base.table if base else None, folded

    def _enter(self, seq: int, table: str, batches: list[str | None], base: bool) -> None:
        """One file in a folder of its own: it is there or not, and other
        writers are not in its way."""
        entry = uuid.uuid4().hex
        self.spark.createDataFrame([(seq, entry, b, table, base) for b in batches], LOG) \
            .coalesce(1).write.parquet(f"{self.path}/log/{seq:09d}-{entry}")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch; the same name again replaces what it added."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        seq, _, _, folded = self._state()
        if batch in folded:
            return                  # part of the compacted totals already
        table = f"batch-{batch}-{uuid.uuid4().hex[:12]}"
        (deltas(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.parquet(f"{self.path}/{table}"))
        self._enter(seq + 1, table, [batch], False)

    def _tables(self, live: dict[str, str], base: str | None) -> DataFrame:
        paths = [f"{self.path}/{t}" for t in [*live.values(), *([base] if base else [])]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def compact(self) -> None:
        """Fold the committed batches into one table."""
        seq, live, base, folded = self._state()
        if not live:
            return
        table = f"base-{uuid.uuid4().hex[:12]}"
        self._tables(live, base).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")) \
            .write.parquet(f"{self.path}/{table}")
        self._enter(seq + 1, table, [None, *sorted(folded | set(live))], True)

    def totals(self, drop_empty: bool = False) -> DataFrame:
        _, live, base, _ = self._state()
        out = self._tables(live, base).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0 or tokens <> 0") if drop_empty else out
