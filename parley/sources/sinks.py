"""Writers (A-7..A-16): append with resume, CSV export, checked table
appends, DDL, bulk load, label upsert, model registration, run metrics.

Tables live as Parquet folders under a base path (on a cluster: the
shared warehouse / checkpoint folder); JDBC is used only when a URL is
given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.schemas import MODEL_IDS, SURROGATE_KEYS, TABLES
from parley.session import settings, tidy_shuffles

# NULL is written as \N so that an empty string survives a round trip.
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


class ColumnError(ValueError):
    """A frame carries a column its target table does not have."""


def _exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def pending(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are not yet in the table at ``path``
    (resume after a crash: finished batches are skipped)."""
    done = _exists(df.sparkSession, path)
    if done is None:
        return df
    return df.join(done.select(*keys).hint("shuffle_hash"), keys, "left_anti")


#: Rows that lie together by some of the join's keys meet the others where they are.
_WHERE_THEY_ARE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def append_batches(df: DataFrame, path: str, keys: list[str], partition_by: tuple[str, ...] = ("model_id",),
                   cluster_by: tuple[str, ...] = ("batch_id",)) -> None:
    """A-7: append only unfinished rows, so a re-run after a crash writes
    what is missing and nothing twice. A folder per model; a batch is a
    sorted run within one file of it, which row-group statistics find. (A
    folder per batch made as many files as there are batches.) Only the
    rows to write are shuffled, once, by batch, so what models have in
    common lies together and is compressed; in a re-run, keys of the table
    go to where the rows lie if these were dealt by some of the keys."""
    by = [*partition_by, *cluster_by]
    with settings(df.sparkSession, _WHERE_THEY_ARE), tidy_shuffles(df.sparkSession):
        todo = pending(df, path, keys).repartition(*(cluster_by or by)).sortWithinPartitions(*by)
        todo.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A-8: one CSV export (header; quotes where needed; whitespace kept)."""
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def check_columns(df: DataFrame, table: str) -> DataFrame:
    """A-9 check: a column outside the table's schema is an error; missing
    columns are allowed (NULL); types are cast to the table's types."""
    schema = TABLES[table]
    allowed = {f.name for f in schema.fields}
    extra = [c for c in df.columns if c not in allowed]
    if extra:
        raise ColumnError(f"columns {extra} are not in table {table}")
    sk = SURROGATE_KEYS.get(table)
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == sk:
            natural = [c for c in ("dialogue_id", "model_id") if c in df.columns]
            cols.append(F.xxhash64(*natural).alias(f.name) if natural
                        else F.lit(None).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_table(df: DataFrame, table: str, base: str, jdbc_url: str | None = None,
                 batchsize: int = 1000) -> None:
    """A-9: validate, then bulk append. Surrogate keys are a 64-bit hash of
    the natural key (stable under any partitioning; no global window)."""
    checked = check_columns(df, table)
    if jdbc_url:
        checked.write.mode("append").option("batchsize", batchsize).jdbc(jdbc_url, table)
    else:
        checked.write.mode("append").parquet(f"{base}/{table}")


def recreate_table(spark: SparkSession, table: str, base: str,
                   partition_by: tuple[str, ...] = ()) -> None:
    """A-11: drop and create an empty table with its fixed schema."""
    w = spark.createDataFrame([], TABLES[table]).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{base}/{table}")


def bulk_load(df: DataFrame, table: str, base: str, datasets: tuple[str, ...] | None = None,
              jdbc_url: str | None = None, batchsize: int = 1000) -> None:
    """A-12: load splits (all by default; ``datasets`` selects) in
    multi-row batches; stored partitioned by dataset for pruning."""
    if datasets is not None:
        df = df.where(F.col("dataset").isin(*datasets))
    checked = check_columns(df, table)
    if jdbc_url:
        checked.write.mode("append").option("batchsize", batchsize).jdbc(jdbc_url, table)
    else:
        checked.write.mode("append").partitionBy("dataset").parquet(f"{base}/{table}")


def upsert_labels(dialogues: DataFrame, labels: DataFrame, key: str = "dialogue_id",
                  col: str = "actual_sentiment", order: str | None = None) -> DataFrame:
    """A-14: new label where one exists for the key, old label otherwise;
    unmatched label ids are ignored. Of several labels for a key the last
    by ``order`` counts (without one, the largest). One left join instead
    of a lookup per row; the caller rewrites the table (or MERGEs)."""
    pick = F.max_by(col, order) if order else F.max(col)
    new = labels.groupBy(key).agg(pick.alias("_new"))
    j = dialogues.join(new, key, "left")
    return j.withColumn(col, F.coalesce("_new", col)).drop("_new")


def register_models(spark: SparkSession, existing: DataFrame, ids=MODEL_IDS) -> DataFrame:
    """A-15: model ids not yet registered (idempotent insert)."""
    new = spark.createDataFrame([(m,) for m in ids], "model_id string")
    return new.join(existing.select("model_id"), "model_id", "left_anti")


def write_run_metrics(metrics: DataFrame, path: str) -> None:
    """A-16: one text file per model with ``<name>: <value> MB`` lines."""
    lines = metrics.select(
        F.regexp_replace(F.col("model_id"), "[^A-Za-z0-9]+", "_").alias("model_key"),
        F.concat(F.col("name"), F.lit(": "), F.col("value").cast("string"), F.lit(" MB")).alias("value"))
    lines.write.mode("overwrite").partitionBy("model_key").text(path)
