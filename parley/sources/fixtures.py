"""Dialogue-evaluation tables derived from the driver tables.

The pipeline being rebuilt reads dialogues, model outputs, parsed
sentiments and scored summaries. Here they are *derived by Spark* from the
driver's ``documents``, ``labels``, ``conversations`` and ``embeddings``,
so every query's work grows with those tables. The same definitions are
written in DuckDB SQL in ``parley.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.chunk import chunk_array
from parley.functions.parse import extract_sentiment
from parley.functions.text import words
from parley.schemas import MODEL_IDS
from parley.session import dealt, read_table, spread


def registry_array() -> Column:
    """The model registry as a literal array of (model_no, model_id).

    Exploding it replicates a row once per model without a join; its size
    is fixed (seven models)."""
    return F.array(*[F.struct(F.lit(i + 1).alias("model_no"), F.lit(m).alias("model_id"))
                     for i, m in enumerate(MODEL_IDS)])


def per_model(df: DataFrame) -> DataFrame:
    """df x registry, columns of df plus model_no, model_id."""
    return (df.select("*", F.explode(registry_array()).alias("_m"))
              .select(*df.columns, "_m.model_no", "_m.model_id"))


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, m) for i, m in enumerate(MODEL_IDS)], "model_no int, model_id string")


def split_of(doc_id: Column) -> Column:
    r = doc_id % 10
    return F.when(r == 8, "test").when(r == 9, "valid").otherwise("training")


def label_of(toxic: Column, quality: Column) -> Column:
    return (F.when(toxic == 1, "negative").when(quality == 1, "positive")
            .when(quality == 0, "neutral"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels as the dialogues table (+ topic, n_chars,
    lang). The join side is chosen by Catalyst/AQE from statistics."""
    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    labels = read_table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("dialogue_id"),
        split_of(F.col("doc_id")).alias("dataset"),
        F.col("source").alias("topic"),
        F.col("text").alias("dialogue_text"),
        F.array_join(words("text"), " ").alias("actual_summary"),
        label_of(F.col("toxic"), F.col("quality")).alias("actual_sentiment"),
        F.col("n_chars"),
        F.col("lang"),
    )


def dialogues_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dialogue per conversation: ``role: text`` lines in turn order,
    joined by newline. Aggregation is partial (map side) per conv_id."""
    conv = spread(read_table(spark, sf_dir, "conversations"), "conv_id")
    lines = F.struct(F.col("turn"), F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    return (conv.groupBy("conv_id")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]),
                                  "\n").alias("dialogue_text"))
                .select(F.col("conv_id").alias("dialogue_id"), "dialogue_text"))


def _cost_time(n: Column, model_no: Column) -> Column:
    # sqrt(k + 1/2) is irrational, so means never sit exactly on a rounding
    # tie (float summation order then cannot change a rounded result).
    return F.sqrt((n % 97).cast("double") + F.lit(0.5)) * F.lit(0.01) * model_no


def _cost_memory(n: Column, model_no: Column, dialogue_id: Column) -> Column:
    base = (n % 53).cast("double") * F.lit(10.0) + model_no
    return F.when(dialogue_id % 101 == 0, base * F.lit(50.0)).otherwise(base)


def _label_word(k: Column) -> Column:
    return F.when(k == 0, "negative").when(k == 1, "neutral").otherwise("positive")


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in for raw sentiment output: the echoed dialogue,
    a blank line, then one of nine answer styles chosen per (dialogue,
    model). The parsers must scan the whole echoed text."""
    d = dialogues(spark, sf_dir).select("dialogue_id", "dialogue_text", "n_chars")
    x = per_model(d)
    did, mno = F.col("dialogue_id"), F.col("model_no")
    code = (did * 31 + F.col("n_chars") * 7 + mno) % 9
    w1, w2 = _label_word(did % 3), _label_word((did + mno) % 3)
    answer = (F.when(code == 0, F.lit("Sentiment: -1"))
              .when(code == 1, F.lit("Sentiment: 0"))
              .when(code == 2, F.lit("Sentiment: 1"))
              .when(code == 3, F.lit("Sentiment:\n1"))
              .when(code == 4, F.concat(F.lit("Sentiment: "), w1))
              .when(code == 5, F.concat(F.lit("Sentiment: "), w1, F.lit(" or "), w2))
              .when(code == 6, F.concat(F.lit("Sentiment: 2 it is "), w1))
              .when(code == 7, F.lit("No label given."))
              .otherwise(F.lit("Sentiment: 10")))
    return x.select(
        "dialogue_id", "model_id", "model_no", "n_chars",
        F.concat(F.col("dialogue_text"), F.lit("\n\n"), answer).alias("raw_output"),
    )


def sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed sentiment per (dialogue, model) with time and memory cost."""
    r = raw_outputs(spark, sf_dir)
    n, mno, did = F.col("n_chars"), F.col("model_no"), F.col("dialogue_id")
    return r.select(
        "dialogue_id", "model_id",
        extract_sentiment("raw_output", "v1").alias("generated_sentiment"),
        _cost_memory(n, mno, did).alias("memory_sentiment_usage"),
        _cost_time(n, mno).alias("time_sentiment_taken"),
    )


def summary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialogue_id, model_id, actual_summary, generated_summary, cost).

    Model k's summary is the whole dialogue with changes over its full
    length: one word in k+3 is left out, one gets an ``s``, and the first
    k/10 of what remains moves to the end. One summary in 41 is NULL, one
    empty."""
    d = dialogues(spark, sf_dir).select("dialogue_id", "actual_summary", "n_chars", F.size(words("dialogue_text")).alias("_n"))
    x = per_model(d)
    n, mno, did = F.col("n_chars"), F.col("model_no"), F.col("dialogue_id")
    missing = (did + mno) % 41
    return x.select(
        "dialogue_id", "model_id", "actual_summary",
        F.when(missing == 0, F.lit(None).cast("string")).when(missing == 1, F.lit(""))
        .when(did >= 0, _changed_text(F.col("actual_summary"), F.col("_n"), did, mno))
        .otherwise(_changed_words(F.col("actual_summary"), did, mno)).alias("generated_summary"),
        _cost_memory(n, mno, did).alias("memory_summary_usage"),
        _cost_time(n, mno).alias("time_summary_taken"),
    )


def _changed_text(text: Column, n: Column, did: Column, mno: Column) -> Column:
    """Model ``mno``'s summary of ``text``, ``n`` words with a space between
    them, for ids from 0 on: one pass over the text, as functions of array
    elements cost some ten times as much.

    Empty words before and behind the text make it whole runs of
    ``period`` words, each of which begins with the word to leave out."""
    period = mno + 3
    lead = F.pmod(did, period).cast("int")
    tail = F.pmod(-(n + lead), period)
    padded = F.concat(F.repeat(F.lit(" "), lead), text, F.repeat(F.lit(" "), tail + 1))
    run = F.concat(F.lit("[^ ]*+ ([^ ]*+)((?: [^ ]*+){"), (period - 2).cast("string"), F.lit("} )"))
    left = F.regexp_replace(padded, run, F.lit("$1s$2"))
    # of the lead, the first is gone and the second has its "s"; so has the first of a tail of all but one
    begin = F.when(lead >= 2, lead + 1).otherwise(F.lit(1))
    behind = tail + F.when(tail == period - 1, 2).otherwise(1)
    kept = n - (F.ceil((n + lead) / period) - F.ceil(lead / period))
    cut = F.floor(kept * mno / 10).cast("int")

    def moved(own: Column) -> Column:
        """The first ``cut`` words behind the others."""
        first = F.call_function("substring_index", own, F.lit(" "), cut)
        return F.when(cut <= 0, own).otherwise(F.concat(F.substring(own, F.length(first) + 2, F.length(own)), F.lit(" "), first))

    def cut_out(x: Column) -> Column:
        return F.substring(x, begin, F.length(x) - (begin - 1) - behind)

    # a lambda's argument is evaluated once
    own = F.transform(F.transform(F.array(left), cut_out), moved)
    return F.when(kept <= 0, F.when(text.isNotNull(), F.lit(""))).otherwise(F.get(own, F.lit(0)))


def _changed_words(text: Column, did: Column, mno: Column) -> Column:
    """The same for any id, word by word."""
    def changed(w: Column, i: Column) -> Column:
        turn = (i + did) % (mno + 3)
        return F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, F.concat(w, F.lit("s"))).otherwise(w)

    def moved(w: Column) -> Column:
        cut = F.floor(F.size(w) * mno / 10).cast("int")
        return F.array_join(F.concat(F.slice(w, cut + 1, F.size(w)), F.slice(w, F.lit(1), cut)), " ")

    new = F.filter(F.transform(F.split(text, " "), changed), lambda w: w.isNotNull())
    return F.get(F.transform(F.array(new), moved), F.lit(0))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored summaries: summary pairs + ROUGE-1/2 (set form) + ROUGE-L."""
    from parley.operators.scores import rouge_l
    return rouge_l(summary_pairs(spark, sf_dir), "generated_summary", "actual_summary", orders=(1, 2))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary pairs with all seven scores."""
    from parley.operators.bertscore import HashEmbedder
    from parley.operators.scores import score_summaries
    return score_summaries(summary_pairs(spark, sf_dir), ["dialogue_id", "model_id"], make_embedder=HashEmbedder)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of like words, made from the corpus's vocabulary: a stem of
    five signs or more is in the group of its first four and of its last
    four. Stands in for a thesaurus (word, group)."""
    from parley.functions.stem import porter_column
    from parley.functions.text import meteor_tokens
    words_ = dialogues(spark, sf_dir).select(F.explode(F.array_distinct(meteor_tokens("actual_summary"))).alias("w")).distinct()
    stems = words_.select(porter_column(F.col("w")).alias("word")).where(F.length("word") >= 5).distinct()
    groups = F.array(F.concat(F.lit("a"), F.left("word", F.lit(4))), F.concat(F.lit("z"), F.right("word", F.lit(4))))
    return stems.select("word", F.explode(groups).alias("group"))


def chunks(spark: SparkSession, sf_dir: str, max_length: int = 1024) -> DataFrame:
    """One row per chunk of each dialogue (I-2)."""
    d = dealt(dialogues(spark, sf_dir).select("dialogue_id", "dialogue_text"), read_table(spark, sf_dir, "documents"), "dialogue_id")
    return d.select("dialogue_id", F.posexplode(chunk_array("dialogue_text", max_length))
                    .alias("chunk_no", "chunk_text"))


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-chunk generation results of every model: the words of the chunk
    as summary, cost from the chunk length, batches of 25 dialogues."""
    c = per_model(chunks(spark, sf_dir))
    n, mno, did = F.length("chunk_text"), F.col("model_no"), F.col("dialogue_id")
    return c.select(
        "dialogue_id", "model_id", "chunk_no",
        F.array_join(words("chunk_text"), " ").alias("summary"),
        F.floor(did / 25).alias("batch_id"),
        _cost_time(n, mno).alias("time_taken"),
        _cost_memory(n, mno, did).alias("memory_usage"),
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as token vectors of candidate / reference sides."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("long").alias("pair_id"),
        F.when(F.col("vec_id") % 2 == 0, "cand").otherwise("ref").alias("side"),
        F.col("vec_id").alias("token_no"),
        F.col("embedding").alias("vector"),
    )
