"""A training corpus in five stages, each on all its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir)
and returns a DataFrame, written as Parquet and read again as the next
one's docs. All stages but the last return the columns of docs.

Edge cases follow the operators: texts that are null, empty or without
letters are rejected by the first stage; equal texts leave one row, the
one with the smallest doc_id; a masked text's n_chars follows it; a
document that the mix takes twice is there twice. Extra columns of docs
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import langid, mixing, ngram_join, packing, pii
from parley.llm.queries import tokenizer
from parley.session import fresh_path, prepare, read_table

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None

#: Near duplicates: five-word shingles, similarity 0.8.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the evidence does not tell."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the
    smallest id."""
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text."""
    out = pii.mask(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, repeats as rows of their own."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer(), with_ids=False).drop("ids")


def _prepared(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark), docs, sf_dir)
    return run_stage


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mix_sources", mix), ("pack", pack)]
STAGES = [(name, _prepared(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
