"""Readers (A-1..A-6, A-16 legacy text) and table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.schemas import DIALOGUE_CSV, RESULT_CSV, RESULT_STYLE_2, SPLIT_ALIASES
from parley.sources.splitcsv import read_csv

# CSV options that round-trip long texts with newlines, quotes and edge
# whitespace.
CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
            "nullValue": "\\N", "mode": "FAILFAST"}


def read_dialogue_csv(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """A-1: labelled split (id, dialogue, summary, topic, sentiment) or an
    unlabelled one (no sentiment column -> NULL). Schema is given, never
    inferred (inference scans the data twice). Large files are read by
    splits, although their texts hold line ends and quotes."""
    schema = DIALOGUE_CSV if labelled else T.StructType(DIALOGUE_CSV.fields[:4])
    df = read_csv(spark, path, schema, CSV_READ)
    if not labelled:
        df = df.withColumn("sentiment", F.lit(None).cast("string"))
    return df


def scan_split(dialogues: DataFrame, dataset: str) -> DataFrame:
    """A-2: rows of one split; ``validation`` is read as ``valid``. On a
    table stored ``partitionBy("dataset")`` this prunes partitions."""
    return dialogues.where(F.col("dataset") == SPLIT_ALIASES.get(dataset, dataset))


def scan_model(df: DataFrame, model_id: str) -> DataFrame:
    """A-3 / A-4: predictions or scored summaries of one model."""
    return df.where(F.col("model_id") == model_id)


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A-5: full scan of a stored table."""
    return spark.read.parquet(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A-6: a model result file in either header style, normalised to
    (dialogue_id, summary, time_taken, memory_usage). The header gives the
    names; the file itself is read by splits."""
    names = spark.read.options(**CSV_READ).option("inferSchema", "false").csv(path).columns
    raw = read_csv(spark, path, T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]), CSV_READ) \
        .toDF(*names)
    renamed = raw.withColumnsRenamed({k: v for k, v in RESULT_STYLE_2.items() if k in raw.columns})
    return renamed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_CSV.fields])


RUN_METRIC_RE = "^([A-Za-z_]+): ([-0-9.eE]+) MB$"


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A-16 legacy form: lines ``<name>: <value> MB``; the model comes from
    the folder (``model_key=...``) -> (model_key, name, value)."""
    t = spark.read.text(path)
    return t.select(
        "model_key",
        F.regexp_extract("value", RUN_METRIC_RE, 1).alias("name"),
        F.regexp_extract("value", RUN_METRIC_RE, 2).cast("double").alias("value"))
