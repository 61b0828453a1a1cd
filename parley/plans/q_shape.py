"""Queries: column shaping, joins, set operations and reshaping
(B-1..B-6, B-9, B-10, B-12, B-14, D-2..D-9, G-1, G-3, G-4, G-7, G-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.parse import extract_sentiment, sentiment_code
from parley.operators import chunking as CH
from parley.operators import scores as S
from parley.operators import shaping as SH
from parley.operators import stats as ST
from parley.plans.oracle_views import with_views
from parley.plans.registry import query
from parley.schemas import MODEL_IDS, RESULT_STYLE_2
from parley.session import stored
from parley.sources import fixtures as X

KEY = ["dialogue_id", "model_id"]
SCORES = ["rouge_1", "rouge_2", "rouge_l", "memory_summary_usage", "time_summary_taken"]


def r6(c):
    return F.round(c, 6)


@query("b1_constant_column", with_views("""
SELECT dialogue_id, 'falcon 7b' AS model_id, dataset FROM dialogues WHERE dataset = 'training'""", "dialogues"))
def q_constant(spark, sf):
    d = X.dialogues(spark, sf).where(F.col("dataset") == "training").select("dialogue_id", "dataset")
    return SH.add_constant(d, model_id="falcon 7b").select("dialogue_id", "model_id", "dataset")


@query("b2_typed_null_column", with_views("""
SELECT dialogue_id, dataset, CAST(NULL AS VARCHAR) AS actual_sentiment FROM dialogues WHERE dataset <> 'training'""",
                                          "dialogues"))
def q_typed_null(spark, sf):
    """Unlabelled splits get a typed NULL label column."""
    d = X.dialogues(spark, sf).where(F.col("dataset") != "training").select("dialogue_id", "dataset")
    return SH.add_constant(d, actual_sentiment=(None, "string"))


@query("b3_drop_columns", with_views("""
SELECT dialogue_id, dataset, topic, actual_sentiment FROM dialogues""", "dialogues"))
def q_drop(spark, sf):
    d = X.dialogues(spark, sf)
    return d.drop("dialogue_text", "actual_summary", "n_chars", "lang")


@query("b4_rename", with_views("""
SELECT dialogue_id AS id, dialogue_text AS dialogue, actual_summary AS summary, topic FROM dialogues""",
                               "dialogues"))
def q_rename(spark, sf):
    """Positional rename to a CSV header layout."""
    d = X.dialogues(spark, sf).select("dialogue_id", "dialogue_text", "actual_summary", "topic")
    return SH.rename_positional(d, ["id", "dialogue", "summary", "topic"])


@query("b4_rename_map", with_views("""
SELECT dialogue_id, summary, round(time_taken, 6) AS time_taken, round(memory_usage, 6) AS memory_usage
FROM (SELECT dialogue_id, string_agg(coalesce(summary, ''), '' ORDER BY chunk_no) AS summary,
             sum(time_taken) AS time_taken, sum(memory_usage) AS memory_usage
      FROM chunk_results WHERE model_id = 'mistral 7b' GROUP BY dialogue_id)""", "chunk_results"))
def q_rename_map(spark, sf):
    """Result frame in the second header style, renamed by map to the
    first style."""
    r = CH.reassemble(X.chunk_results(spark, sf).where(F.col("model_id") == "mistral 7b"), ["dialogue_id"])
    style2 = r.select("dialogue_id", F.col("summary").alias("Summary"),
                      F.col("time_taken").alias("Time Taken (s)"), F.col("memory_usage").alias("GPU Usage (MB)"))
    out = SH.rename_map(style2, RESULT_STYLE_2)
    return out.select("dialogue_id", "summary", r6("time_taken").alias("time_taken"),
                      r6("memory_usage").alias("memory_usage"))


_LOAD_LAYOUT = ["dialogue_id", "model_id", "generated_summary", "rouge_1", "rouge_2", "rouge_l",
                "bert_precision", "bert_recall", "bert_f1", "meteor", "memory_summary_usage", "time_summary_taken"]


@query("b5_load_layout", with_views("SELECT " + ", ".join(
    c if c in ("dialogue_id", "model_id", "generated_summary") else f"round({c}, 6) AS {c}" for c in _LOAD_LAYOUT)
    + " FROM all_scores", "all_scores"))
def q_load_layout(spark, sf):
    """The 12-column load layout of scored summaries."""
    return X.scored(spark, sf).select(*[c if c in ("dialogue_id", "model_id", "generated_summary") else r6(c).alias(c)
                                        for c in _LOAD_LAYOUT])


@query("b6_drop_trailing", with_views("""
SELECT dialogue_id, model_id, generated_sentiment FROM sentiments""", "sentiments"))
def q_drop_trailing(spark, sf):
    return SH.drop_trailing(X.sentiments(spark, sf), 2)


@query("b9_struct_to_columns", with_views("""
SELECT dialogue_id, model_id, round(rouge_1, 6) AS rouge1, round(rouge_2, 6) AS rouge2, round(rouge_l, 6) AS rougeL
FROM summaries""", "summaries"))
def q_struct(spark, sf):
    """A dict of scores per row as a struct, expanded to columns."""
    s = X.summaries(spark, sf).select(*KEY, F.struct(r6("rouge_1").alias("rouge1"), r6("rouge_2").alias("rouge2"),
                                                     r6("rouge_l").alias("rougeL")).alias("scores"))
    return SH.flatten_struct(s, "scores")


@query("b10_optional_key", with_views("""
SELECT dialogue_id, model_id, round(rouge_1, 6) AS rouge1, CAST(NULL AS DOUBLE) AS rougeLsum FROM summaries""",
                                      "summaries"))
def q_optional_key(spark, sf):
    """Optional key of a score map: value when present, else NULL."""
    s = X.summaries(spark, sf).select(*KEY, F.create_map(F.lit("rouge1"), r6("rouge_1"),
                                                         F.lit("rougeL"), r6("rouge_l")).alias("m"))
    return s.select(*KEY, F.try_element_at("m", F.lit("rouge1")).alias("rouge1"),
                    F.try_element_at("m", F.lit("rougeLsum")).alias("rougeLsum"))


@query("b12_placeholder_label", with_views("""
SELECT dialogue_id, (((dialogue_id % 1000003) * 2654435761 % 4294967296) >> 16) % 3 AS label FROM dialogues""",
                                          "dialogues"))
def q_placeholder(spark, sf):
    """Evenly spread 0/1/2 placeholder label: a mix of the id, the same
    under any partitioning."""
    d = X.dialogues(spark, sf).select("dialogue_id")
    mixed = (F.col("dialogue_id") % 1000003) * F.lit(2654435761) % F.lit(4294967296)
    return d.withColumn("label", F.shiftright(mixed, 16) % 3)


@query("b14_ntile_parts", with_views("""
SELECT dialogue_id, CAST(ntile(13) OVER (ORDER BY dialogue_id) AS BIGINT) AS part FROM dialogues
WHERE len(list_filter(regexp_split_to_array(dialogue_text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) < 512""",
                                     "dialogues"))
def q_ntile(spark, sf):
    """Teacher-labelling parts: 13 contiguous near-equal parts of the
    dialogues under 512 words, without a single-task global window."""
    from parley.functions.text import word_count
    d = X.dialogues(spark, sf).where(word_count("dialogue_text") < 512).select("dialogue_id")
    return SH.ntile_parts(d, "dialogue_id", 13).select("dialogue_id", "part")


# -- joins -----------------------------------------------------------------------

@query("d2_reference_generated_join", with_views("""
SELECT d.dialogue_id, r.model_id, d.actual_summary, r.summary AS generated_summary
FROM dialogues d JOIN (SELECT dialogue_id, model_id, string_agg(coalesce(summary, ''), '' ORDER BY chunk_no) AS summary
                       FROM chunk_results GROUP BY dialogue_id, model_id) r ON d.dialogue_id = r.dialogue_id""",
                                                "dialogues", "chunk_results"))
def q_ref_gen(spark, sf):
    gen = CH.reassemble(X.chunk_results(spark, sf), KEY).select(*KEY, F.col("summary").alias("generated_summary"))
    return X.dialogues(spark, sf).select("dialogue_id", "actual_summary").join(gen, "dialogue_id")


@query("d3_scores_usage_join", with_views("""
SELECT dialogue_id, model_id, round(rouge_1, 6) AS rouge_1, round(memory_summary_usage, 6) AS memory_summary_usage,
       round(time_summary_taken, 6) AS time_summary_taken FROM summaries""", "summaries"))
def q_scores_usage(spark, sf):
    p = X.summary_pairs(spark, sf)
    sc = S.rouge_n(p.select(*KEY, "generated_summary", "actual_summary"), "generated_summary",
                   "actual_summary", orders=(1,), native=False).select(*KEY, "rouge_1")
    usage = p.select(*KEY, "memory_summary_usage", "time_summary_taken")
    j = sc.join(usage, KEY)
    return j.select(*KEY, r6("rouge_1").alias("rouge_1"), r6("memory_summary_usage").alias("memory_summary_usage"),
                    r6("time_summary_taken").alias("time_summary_taken"))


@query("d4_natural_join", with_views("""
SELECT dialogue_id, model_id, dataset, generated_sentiment FROM dialogues NATURAL JOIN sentiments
WHERE dataset = 'training'""", "dialogues", "sentiments"))
def q_natural(spark, sf):
    """SQL NATURAL JOIN over temp views (common column: dialogue_id)."""
    X.dialogues(spark, sf).select("dialogue_id", "dataset").createOrReplaceTempView("parley_dialogues")
    X.sentiments(spark, sf).select("dialogue_id", "model_id", "generated_sentiment") \
        .createOrReplaceTempView("parley_sentiments")
    return spark.sql("""SELECT dialogue_id, model_id, dataset, generated_sentiment
                        FROM parley_dialogues NATURAL JOIN parley_sentiments WHERE dataset = 'training'""")


@query("d5_align_by_position", with_views("""
SELECT l.position, l.dialogue_id, r.dialogue_id AS dialogue_id_r, r.generated_summary AS generated_summary_r
FROM (SELECT dialogue_id, row_number() OVER (ORDER BY dialogue_id) AS position FROM dialogues
      WHERE dataset = 'training') l
FULL JOIN (SELECT dialogue_id, generated_summary, row_number() OVER (ORDER BY dialogue_id) AS position
           FROM summary_pairs WHERE model_id = 'gemma 7b'
             AND dialogue_id IN (SELECT dialogue_id FROM dialogues WHERE dataset = 'training')) r
  ON l.position = r.position""",
                                         "dialogues", "summary_pairs"))
def q_align_position(spark, sf):
    """A generated column attached by row position (both frames in id
    order), next to the key it came with."""
    left = X.dialogues(spark, sf).where(F.col("dataset") == "training").select("dialogue_id")
    right = X.summary_pairs(spark, sf).where(F.col("model_id") == "gemma 7b") \
        .join(left, "dialogue_id", "left_semi").select("dialogue_id", "generated_summary")
    out = SH.align_by_position(left, right, "dialogue_id", "dialogue_id")
    return out.select(F.col("position").cast("long").alias("position"), "dialogue_id", "dialogue_id_r",
                      "generated_summary_r")


@query("d6_same_row_derived", with_views(r"""
SELECT dialogue_id, model_id,
       CASE WHEN regexp_extract(raw_output, 'Sentiment: (-?\d)', 1) = '' THEN 0
            ELSE CAST(regexp_extract(raw_output, 'Sentiment: (-?\d)', 1) AS INTEGER) END AS code,
       generated_sentiment
FROM raw_outputs JOIN sentiments USING (dialogue_id, model_id)""", "raw_outputs", "sentiments"))
def q_same_row(spark, sf):
    """Derived columns attached in the same row (a struct), not by an
    index join."""
    r = X.raw_outputs(spark, sf).select(*KEY, F.struct(sentiment_code("raw_output").alias("code"),
                                                       extract_sentiment("raw_output", "v1").alias(
                                                           "generated_sentiment")).alias("d"))
    return SH.flatten_struct(r, "d")


@query("d7_wide_by_position", with_views("""
SELECT position, """ + ", ".join(f"round(max(CASE WHEN model_id = '{m}' THEN memory_sentiment_usage END), 6) AS "
                                 f"{m.replace(' ', '_')}" for m in MODEL_IDS) + """
FROM (SELECT model_id, memory_sentiment_usage,
             row_number() OVER (PARTITION BY model_id ORDER BY dialogue_id) AS position
      FROM sentiments WHERE generated_sentiment = 'positive') GROUP BY position""", "sentiments"))
def q_wide(spark, sf):
    """One memory column per model aligned by position, ragged ends NULL."""
    s = X.sentiments(spark, sf).where(F.col("generated_sentiment") == "positive") \
        .select("dialogue_id", "model_id", r6("memory_sentiment_usage").alias("memory_sentiment_usage"))
    return SH.wide_by_position(s, "model_id", "dialogue_id", "memory_sentiment_usage", list(MODEL_IDS))


@query("d8_key_lookup", with_views("""
SELECT d.dialogue_id, l.quality, l.toxic FROM dialogues d LEFT JOIN labels l ON d.dialogue_id = l.doc_id""",
                                   "dialogues"))
def q_lookup(spark, sf):
    from parley.session import read_table
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").alias("dialogue_id"), "quality", "toxic")
    return SH.key_lookup(X.dialogues(spark, sf).select("dialogue_id"), lab, "dialogue_id", "quality")


@query("d9_fk_resolution", with_views("""
SELECT s.dialogue_id, s.model_id, m.model_no FROM sentiments s JOIN models m ON s.model_id = m.model_id""",
                                      "sentiments", "models"))
def q_fk(spark, sf):
    s = X.sentiments(spark, sf).select("dialogue_id", "model_id")
    return SH.resolve_fk(s, X.models(spark), "model_id").select("dialogue_id", "model_id", "model_no")


# -- sorts, unions, reshaping --------------------------------------------------------

@query("g1_sort_multi_key", with_views("""
SELECT model_id, dialogue_id, round(rouge_1, 6) AS rouge_1 FROM summaries
ORDER BY model_id, rouge_1 DESC NULLS LAST, dialogue_id""", "summaries"))
def q_sort(spark, sf):
    s = X.summaries(spark, sf).select("model_id", "dialogue_id", r6("rouge_1").alias("rouge_1"))
    s = stored(s, "scored")                 # a sort reads its rows twice: once for the ranges
    return s.orderBy("model_id", F.desc_nulls_last("rouge_1"), "dialogue_id")


@query("g3_union_splits", with_views("""
SELECT dialogue_id, 'training' AS dataset FROM dialogues WHERE dataset = 'training'
UNION ALL SELECT dialogue_id, 'test' FROM dialogues WHERE dataset = 'test'
UNION ALL SELECT dialogue_id, 'valid' FROM dialogues WHERE dataset = 'valid'""", "dialogues"))
def q_union(spark, sf):
    """Per-split frames, each given its split name, stacked by name."""
    d = X.dialogues(spark, sf).select("dialogue_id", "dataset")
    parts = [SH.add_constant(d.where(F.col("dataset") == s).select("dialogue_id"), dataset=s)
             for s in ("training", "test", "valid")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("g7_unpivot", with_views("""
SELECT dialogue_id, model_id, metric, round(score, 6) AS score FROM
(UNPIVOT (SELECT dialogue_id, model_id, rouge_1, rouge_2, rouge_l, memory_summary_usage, time_summary_taken
          FROM summaries) ON rouge_1, rouge_2, rouge_l, memory_summary_usage, time_summary_taken
 INTO NAME metric VALUE score INCLUDE NULLS)""".replace("INTO NAME metric VALUE score INCLUDE NULLS",
                                                         "INTO NAME metric VALUE score"), "summaries"))
def q_unpivot(spark, sf):
    long = ST.long_scores(X.summaries(spark, sf), KEY, SCORES).where(F.col("score").isNotNull())
    return long.select(*KEY, "metric", r6("score").alias("score"))


@query("g8_pivot", with_views("""
SELECT l.sentiment, """ + ", ".join(
    f"CAST(max(CASE WHEN c.model_id = '{m}' THEN c.n END) AS BIGINT) AS {m.replace(' ', '_')}" for m in MODEL_IDS) + """
FROM (VALUES ('negative'), ('neutral'), ('positive')) l(sentiment)
LEFT JOIN (SELECT model_id, generated_sentiment, count(*) AS n FROM sentiments GROUP BY ALL) c
  ON c.generated_sentiment = l.sentiment
GROUP BY l.sentiment""", "sentiments"))
def q_pivot(spark, sf):
    """Label rows x model columns of counts on a fixed label index (absent
    -> NULL); pivot values are given, so no extra distinct job."""
    s = X.sentiments(spark, sf)
    labels = spark.createDataFrame([("negative",), ("neutral",), ("positive",)], "sentiment string")
    counts = s.groupBy(F.col("generated_sentiment").alias("sentiment")).pivot("model_id", list(MODEL_IDS)) \
        .agg(F.count(F.lit(1)).cast("long"))
    out = labels.join(counts, "sentiment", "left")
    return out.withColumnsRenamed({m: m.replace(" ", "_") for m in MODEL_IDS})


@query("g2_chained_sort", with_views("""
SELECT model_id, generated_sentiment, CAST(count(*) AS BIGINT) AS n FROM sentiments
GROUP BY model_id, generated_sentiment ORDER BY model_id, generated_sentiment, n""", "sentiments"))
def q_chained_sort(spark, sf):
    """Three successive sorts of the source become one sort on the full key."""
    s = X.sentiments(spark, sf).groupBy("model_id", "generated_sentiment").agg(F.count("*").cast("long").alias("n"))
    return s.orderBy("model_id", "generated_sentiment", "n")


@query("g4_column_concat", with_views("""
SELECT position, """ + ", ".join(f"round(max(CASE WHEN model_id = '{m}' THEN memory_sentiment_usage END), 6) AS "
                                 f"{m.replace(' ', '_')}" for m in MODEL_IDS) + """
FROM (SELECT s.model_id, s.memory_sentiment_usage,
             row_number() OVER (PARTITION BY s.model_id ORDER BY s.dialogue_id) AS position
      FROM sentiments s JOIN (
        SELECT model_id, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi
        FROM (SELECT model_id, quantile_cont(memory_sentiment_usage, 0.25) AS q1,
                     quantile_cont(memory_sentiment_usage, 0.75) AS q3 FROM sentiments GROUP BY model_id)) f
        ON s.model_id = f.model_id
      WHERE s.memory_sentiment_usage >= f.lo AND s.memory_sentiment_usage <= f.hi)
GROUP BY position""", "sentiments"))
def q_column_concat(spark, sf):
    """Outlier-free memory columns of every model set side by side (each
    model keeps its own rows; shorter columns end in NULL)."""
    s = X.sentiments(spark, sf).select("dialogue_id", "model_id", "memory_sentiment_usage")
    kept = ST.remove_outliers(s, ["model_id"], "memory_sentiment_usage") \
        .select("dialogue_id", "model_id", r6("memory_sentiment_usage").alias("memory_sentiment_usage"))
    return SH.wide_by_position(kept, "model_id", "dialogue_id", "memory_sentiment_usage", list(MODEL_IDS))
