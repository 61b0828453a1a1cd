"""Splitting long dialogues into chunks and re-assembling chunk results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.chunk import chunk_array
from parley.schemas import MAX_DIALOGUE_CHARS


def split_dialogue(df: DataFrame, text: str = "dialogue_text", key: str = "dialogue_id",
                   max_length: int = MAX_DIALOGUE_CHARS, drop_empty: bool = False) -> DataFrame:
    """1 -> n rows (I-2): (key, chunk_no, chunk_text, over_long). The chunk
    array is built inside the row; ``posexplode`` keeps the order. No
    shuffle: chunks stay in the partition of their dialogue."""
    out = df.select(key, F.posexplode(chunk_array(text, max_length)).alias("chunk_no", "chunk_text"))
    out = out.select(key, F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_text",
                     (F.length("chunk_text") > max_length).alias("over_long"))
    if drop_empty:
        out = out.where(F.col("chunk_text") != "")
    return out


def length_branch(df: DataFrame, text: str = "dialogue_text",
                  max_length: int = MAX_DIALOGUE_CHARS) -> DataFrame:
    """C-3: which rows pass through (``len < L``) and which go to the
    splitter (``len >= L``), as one CASE column."""
    return df.withColumn("branch", F.when(F.length(text) < max_length, "pass").otherwise("split"))


def reassemble(chunks: DataFrame, keys: list[str], order: str = "chunk_no", text: str = "summary",
               sep: str = "", sums: tuple[str, ...] = ("time_taken", "memory_usage"),
               distinct: bool = False) -> DataFrame:
    """E-15 / G-6: concatenate chunk texts in chunk order (NULL -> ''), sum
    the cost columns. ``distinct`` keeps the first of equal partial texts.
    The group is one dialogue's chunks, bounded by the text length."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("t")))),
                        lambda x: x["t"])
    if distinct:
        parts = F.array_distinct(parts)
    aggs = [F.array_join(parts, sep).alias(text)] + [F.sum(c).alias(c) for c in sums]
    return chunks.groupBy(*keys).agg(*aggs)


def batch_means(results: DataFrame, keys: list[str], batch: str = "batch_id",
                time: str = "time_taken", memory: str = "memory_usage",
                offset: DataFrame | None = None) -> DataFrame:
    """E-16: per batch, total time and (peak memory - offset) divided by the
    batch size. ``offset`` is a (keys..., offset) frame of the memory in
    use before generation; absent -> 0."""
    g = results.groupBy(*keys, batch).agg(
        F.count("*").alias("batch_size"), F.sum(time).alias("_t"), F.max(memory).alias("_peak"))
    if offset is not None:
        g = g.join(offset, keys, "left")
    else:
        g = g.withColumn("offset", F.lit(0.0))
    return g.select(*keys, batch, F.col("batch_size").cast("long").alias("batch_size"),
                    (F.col("_t") / F.col("batch_size")).alias("time_per_dialogue"),
                    ((F.col("_peak") - F.coalesce(F.col("offset"), F.lit(0.0))) / F.col("batch_size"))
                    .alias("memory_per_dialogue"))
