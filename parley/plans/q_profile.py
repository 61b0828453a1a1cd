"""Queries: corpus profile, filters, statistics and plot-ready tables
(C-1, C-4..C-9, E-1..E-9, E-14, F-1..F-3, F-5, F-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import stats as ST
from parley.plans.oracle_views import kde_sql, with_views
from parley.plans.registry import query
from parley.sources import fixtures as X
from parley.sources.files import scan_model, scan_split

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
NORM = rf"trim(regexp_replace(dialogue_text, '[ \t\n\r\f]+', ' ', 'g'), {WS})"
SCORES = ["rouge_1", "rouge_2", "rouge_l", "memory_summary_usage", "time_summary_taken"]


def r6(c):
    return F.round(c, 6)


# -- counts and distinct values ------------------------------------------------------

@query("e1_row_counts", with_views("""
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_cols FROM dialogues GROUP BY dataset
UNION ALL
SELECT 'all', CAST(count(*) AS BIGINT), CAST(5 AS BIGINT) FROM dialogues""", "dialogues"))
def q_row_counts(spark, sf):
    """Rows per split and in total (the reconciliation: total = sum of
    splits), with the column count of the dialogues table."""
    d = X.dialogues(spark, sf).select("dialogue_id", "dataset", "dialogue_text", "actual_summary",
                                       "actual_sentiment")
    ncols = len(d.columns)
    per = d.groupBy("dataset").agg(F.count("*").alias("n_rows"))
    tot = per.agg(F.lit("all").alias("dataset"), F.sum("n_rows").alias("n_rows"))
    return per.unionByName(tot).select("dataset", F.col("n_rows").cast("long").alias("n_rows"),
                                       F.lit(ncols).cast("long").alias("n_cols"))


@query("e2_distinct_counts", with_views("""
SELECT CAST(count(DISTINCT topic) AS BIGINT) AS n_topics, CAST(count(DISTINCT dialogue_id) AS BIGINT) AS n_ids,
       CAST(count(DISTINCT dialogue_text) AS BIGINT) AS n_dialogues,
       CAST(count(DISTINCT actual_summary) AS BIGINT) AS n_summaries, CAST(count(*) AS BIGINT) AS n_rows
FROM dialogues""", "dialogues"))
def q_distinct_counts(spark, sf):
    d = X.dialogues(spark, sf)
    return d.agg(F.countDistinct("topic").cast("long").alias("n_topics"),
                 F.countDistinct("dialogue_id").cast("long").alias("n_ids"),
                 F.countDistinct("dialogue_text").cast("long").alias("n_dialogues"),
                 F.countDistinct("actual_summary").cast("long").alias("n_summaries"),
                 F.count("*").cast("long").alias("n_rows"))


@query("e3_distinct_values", with_views("SELECT DISTINCT model_id FROM sentiments", "sentiments"))
def q_distinct_values(spark, sf):
    return X.sentiments(spark, sf).select("model_id").distinct()


@query("e4_topic_frequency", with_views("""
SELECT topic, CAST(count(*) AS BIGINT) AS n FROM dialogues GROUP BY topic""", "dialogues"))
def q_topic_freq(spark, sf):
    return X.dialogues(spark, sf).groupBy("topic").agg(F.count("*").cast("long").alias("n"))


@query("c9_top_topics", with_views("""
SELECT topic, CAST(count(*) AS BIGINT) AS n FROM dialogues WHERE dataset = 'training'
GROUP BY topic ORDER BY n DESC, topic LIMIT 10""", "dialogues"))
def q_top_topics(spark, sf):
    """Ten most frequent topics (top-k is the feature)."""
    d = scan_split(X.dialogues(spark, sf), "training")
    return (d.groupBy("topic").agg(F.count("*").cast("long").alias("n"))
             .orderBy(F.desc("n"), "topic").limit(10))


@query("c8_longest_dialogues", with_views("""
SELECT dialogue_id, CAST(length(dialogue_text) AS BIGINT) AS text_length FROM dialogues
ORDER BY text_length DESC, dialogue_id LIMIT 10""", "dialogues"))
def q_longest(spark, sf):
    """Ten longest dialogues: a top-k (TakeOrderedAndProject), no full sort."""
    d = X.dialogues(spark, sf).select("dialogue_id", F.length("dialogue_text").cast("long").alias("text_length"))
    return d.orderBy(F.desc("text_length"), "dialogue_id").limit(10)


@query("c7_first_n", with_views("""
SELECT dialogue_id, dataset FROM dialogues WHERE dataset = 'training' ORDER BY dialogue_id LIMIT 25""",
                                "dialogues"))
def q_first_n(spark, sf):
    """Dry-run subset: first 25 training dialogues by id (explicit order)."""
    d = scan_split(X.dialogues(spark, sf), "training").select("dialogue_id", "dataset")
    return d.orderBy("dialogue_id").limit(25)


@query("c1_equality_filter", with_views("""
SELECT dialogue_id, topic FROM dialogues WHERE topic = 'src3'""", "dialogues"))
def q_eq_filter(spark, sf):
    return X.dialogues(spark, sf).where(F.col("topic") == "src3").select("dialogue_id", "topic")


@query("c4_missing_output", with_views("""
SELECT dialogue_id, model_id FROM summary_pairs WHERE generated_summary IS NULL OR generated_summary = ''""",
                                       "summary_pairs"))
def q_missing(spark, sf):
    s = X.summary_pairs(spark, sf)
    return s.where(F.coalesce("generated_summary", F.lit("")) == "") \
            .select("dialogue_id", "model_id")


@query("c5_membership_filter", with_views("""
SELECT dialogue_id, dataset FROM dialogues WHERE dialogue_id IN (SELECT doc_id FROM labels)""", "dialogues"))
def q_semi(spark, sf):
    """Rows whose key is in another frame: a left-semi join."""
    from parley.session import read_table
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").alias("dialogue_id"))
    return X.dialogues(spark, sf).select("dialogue_id", "dataset").join(lab, "dialogue_id", "left_semi")


@query("a3_scan_sentiments", with_views("""
SELECT dialogue_id, model_id, generated_sentiment FROM sentiments WHERE model_id = 'gemma 7b'""",
                                        "sentiments"))
def q_scan_sentiments(spark, sf):
    return scan_model(X.sentiments(spark, sf), "gemma 7b").select("dialogue_id", "model_id", "generated_sentiment")


@query("a4_scan_summaries", with_views("""
SELECT dialogue_id, model_id, generated_summary, round(rouge_1, 6) AS rouge_1 FROM summaries
WHERE model_id = 'llama 3 8b'""", "summaries"))
def q_scan_summaries(spark, sf):
    s = scan_model(X.summaries(spark, sf), "llama 3 8b")
    return s.select("dialogue_id", "model_id", "generated_summary", r6("rouge_1").alias("rouge_1"))


@query("a2_scan_split", with_views("""
SELECT dialogue_id, dataset, topic FROM dialogues WHERE dataset = 'valid'""", "dialogues"))
def q_scan_split(spark, sf):
    """The validation split, asked for by its alias name."""
    return scan_split(X.dialogues(spark, sf), "validation").select("dialogue_id", "dataset", "topic")


# -- duplicates and reading stats -------------------------------------------------------

@query("e5_duplicate_dialogues", with_views(f"""
SELECT d.dialogue_id, CAST(g.n AS BIGINT) AS n_copies
FROM (SELECT dialogue_id, {NORM} AS k FROM dialogues) d
JOIN (SELECT {NORM} AS k, count(*) AS n FROM dialogues GROUP BY k HAVING count(*) > 1) g ON d.k = g.k""",
                                            "dialogues"))
def q_duplicates(spark, sf):
    return ST.duplicate_groups(X.dialogues(spark, sf), "dialogue_id", "dialogue_text")


@query("e5_duplicate_summary", with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS duplicate_texts, CAST(sum(n - 1) AS BIGINT) AS excess_rows
FROM (SELECT {NORM} AS k, count(*) AS n FROM dialogues GROUP BY k HAVING count(*) > 1)""", "dialogues"))
def q_duplicate_summary(spark, sf):
    return ST.duplicate_summary(ST.duplicate_groups(X.dialogues(spark, sf), "dialogue_id", "dialogue_text"))


_SUMMARY_KEY = NORM.replace("dialogue_text", "generated_summary")


@query("e5_duplicate_summaries", with_views(f"""
SELECT p.dialogue_id, p.model_id, CAST(g.n AS BIGINT) AS n_copies
FROM (SELECT dialogue_id, model_id, {_SUMMARY_KEY} AS k FROM summary_pairs WHERE generated_summary IS NOT NULL) p
JOIN (SELECT {_SUMMARY_KEY} AS k, count(*) AS n FROM summary_pairs WHERE generated_summary IS NOT NULL
      GROUP BY k HAVING count(*) > 1) g ON p.k = g.k""", "summary_pairs"))
def q_duplicate_summaries(spark, sf):
    """Summaries whose normalised text occurs more than once, over all models."""
    # missing ones leave after the digests: a filter before would make every summary twice
    k = F.struct("dialogue_id", "model_id", F.col("generated_summary").isNull().alias("missing"))
    p = X.summary_pairs(spark, sf).select(k.alias("k"), "generated_summary")
    found = ST.duplicate_groups(p, "k", "generated_summary").where("not k.missing")
    return found.select("k.dialogue_id", "k.model_id", "n_copies")


@query("e6_reading_stats", with_views("""
SELECT CAST(ceil(avg(w)) AS BIGINT) AS mean_words, CAST(ceil(quantile_cont(w, 0.5)) AS BIGINT) AS median_words,
       CAST(sum(w) AS BIGINT) AS total_words,
       CAST(ceil(CAST(sum(w) AS DOUBLE) / 236.0::DOUBLE / 60.0::DOUBLE) AS BIGINT) AS hours,
       CAST(ceil(ceil(CAST(sum(w) AS DOUBLE) / 236.0::DOUBLE / 60.0::DOUBLE) / 4.0::DOUBLE) AS BIGINT)
         AS hours_per_reader
FROM (SELECT len(string_split(dialogue_text, ' ')) AS w FROM dialogues WHERE dataset = 'training')""",
                                       "dialogues"))
def q_reading(spark, sf):
    return ST.reading_stats(scan_split(X.dialogues(spark, sf), "training"), "dialogue_text")


# -- per-model statistics ---------------------------------------------------------------

_LONG = """(UNPIVOT (SELECT dialogue_id, model_id, rouge_1, rouge_2, rouge_l, memory_summary_usage,
                            time_summary_taken FROM summaries)
          ON rouge_1, rouge_2, rouge_l, memory_summary_usage, time_summary_taken
          INTO NAME metric VALUE score)"""


@query("e7_describe", with_views(f"""
SELECT model_id, metric, CAST(count(score) AS BIGINT) AS count, round(avg(score), 6) AS mean,
       round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min,
       round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50,
       round(quantile_cont(score, 0.75), 6) AS q75, round(max(score), 6) AS max
FROM {_LONG} GROUP BY model_id, metric""", "summaries"))
def q_describe(spark, sf):
    """count / mean / std / min / quartiles / max of every score, per
    model, in one grouped plan over the long form."""
    long = ST.long_scores(X.summaries(spark, sf), ["dialogue_id", "model_id"], SCORES)
    d = ST.describe(long, ["model_id", "metric"], "score")
    return d.select("model_id", "metric", "count",
                    *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("e7_describe_all", with_views(f"""
SELECT metric, CAST(count(score) AS BIGINT) AS count, round(avg(score), 6) AS mean,
       round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min,
       round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50,
       round(quantile_cont(score, 0.75), 6) AS q75, round(max(score), 6) AS max
FROM {_LONG} GROUP BY metric""", "summaries"))
def q_describe_all(spark, sf):
    """describe() of the whole table: every score over all models."""
    long = ST.long_scores(X.summaries(spark, sf), ["dialogue_id", "model_id"], SCORES)
    d = ST.describe(long, ["metric"], "score")
    return d.select("metric", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("e7_describe_subset", with_views("""
SELECT CAST(count(n_chars) AS BIGINT) AS count, round(avg(n_chars), 6) AS mean,
       round(stddev_samp(n_chars), 6) AS std, round(min(n_chars), 6) AS min,
       round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50,
       round(quantile_cont(n_chars, 0.75), 6) AS q75, round(max(n_chars), 6) AS max
FROM dialogues WHERE length(dialogue_text) >= 1024""", "dialogues"))
def q_describe_subset(spark, sf):
    """describe() of a filtered subset: lengths of the dialogues that
    need splitting."""
    d = X.dialogues(spark, sf).where(F.length("dialogue_text") >= 1024).withColumn("_all", F.lit(1))
    out = ST.describe(d, ["_all"], "n_chars")
    return out.select("count", *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


ALL_SCORES = [*SCORES, "meteor", "bert_precision", "bert_recall", "bert_f1"]


@query("e8_median_per_model", with_views(f"""
SELECT model_id, metric, round(quantile_cont(score, 0.5), 6) AS median
FROM (UNPIVOT (SELECT dialogue_id, model_id, {", ".join(ALL_SCORES)} FROM all_scores) ON {", ".join(ALL_SCORES)}
      INTO NAME metric VALUE score)
GROUP BY model_id, metric""", "all_scores"))
def q_medians(spark, sf):
    """Median of every score and cost per model."""
    long = ST.long_scores(X.scored(spark, sf), ["dialogue_id", "model_id"], ALL_SCORES)
    q = ST.group_quantiles(long, ["model_id", "metric"], "score", {"median": 0.5})
    return q.select("model_id", "metric", r6("median").alias("median"))


@query("e9_model_order_by_median", with_views("""
SELECT model_id, round(median, 6) AS median, CAST(row_number() OVER (ORDER BY median, model_id) AS BIGINT) AS rank
FROM (SELECT model_id, quantile_cont(memory_sentiment_usage, 0.5) AS median FROM sentiments GROUP BY model_id)""",
                                              "sentiments"))
def q_median_order(spark, sf):
    m = ST.median_order(X.sentiments(spark, sf), "model_id", "memory_sentiment_usage")
    return m.select("model_id", r6("median").alias("median"), "rank")


@query("e14_mean_time", with_views("""
SELECT model_id, round(sum(time_sentiment_taken) / count(*), 6) AS time_per_dialogue
FROM sentiments GROUP BY model_id ORDER BY time_per_dialogue, model_id""", "sentiments"))
def q_mean_time(spark, sf):
    """Mean time per dialogue = total time / rows (rows computed, not a
    literal), sorted ascending."""
    s = X.sentiments(spark, sf)
    return (s.groupBy("model_id").agg(r6(F.sum("time_sentiment_taken") / F.count("*")).alias("time_per_dialogue"))
             .orderBy("time_per_dialogue", "model_id"))


@query("f5_metric_bars", with_views("""
SELECT model_id, metric, round(score, 6) AS score FROM (
  SELECT model_id, 'accuracy' AS metric, accuracy AS score FROM model_metrics
  UNION ALL SELECT model_id, 'weighted_f1', weighted_f1 FROM model_metrics
  UNION ALL SELECT m.model_id, 'time_per_dialogue', t.tpd FROM model_metrics m
    JOIN (SELECT model_id, sum(time_sentiment_taken) / count(*) AS tpd FROM sentiments GROUP BY model_id) t
      ON m.model_id = t.model_id)""", "model_metrics", "sentiments"))
def q_metric_bars(spark, sf):
    """Grouped-bar (metric x model) and time-line input in one long table."""
    from parley.operators.classification import sentiment_metrics
    s = X.sentiments(spark, sf)
    m = sentiment_metrics(X.dialogues(spark, sf), s)
    t = s.groupBy("model_id").agg((F.sum("time_sentiment_taken") / F.count("*")).alias("time_per_dialogue"))
    w = m.join(t, "model_id").select("model_id", "accuracy", "weighted_f1", "time_per_dialogue")
    long = w.unpivot("model_id", ["accuracy", "weighted_f1", "time_per_dialogue"], "metric", "score")
    return long.select("model_id", "metric", r6("score").alias("score"))


# -- distributions -----------------------------------------------------------------------

_HIST = """
WITH v AS (SELECT dataset, length(dialogue_text) / 4.0 AS x FROM dialogues),
st AS (SELECT dataset, count(*) AS n, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.25) AS q25,
              quantile_cont(x, 0.75) AS q75 FROM v GROUP BY dataset),
w AS (SELECT *, (mx - mn) / (log2(n) + 1.0::DOUBLE) AS sturges,
             2.0::DOUBLE * (q75 - q25) * pow(n, -1.0::DOUBLE / 3.0::DOUBLE) AS fd FROM st),
e AS (SELECT dataset,
             CAST(CASE WHEN (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END) > 0
                       THEN ceil((mx - mn) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END))
                       ELSE 1 END AS BIGINT) AS nb,
             CASE WHEN mx - mn = 0 THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mx - mn = 0 THEN mx + 0.5 ELSE mx END AS hi FROM w),
b0 AS (SELECT v.dataset, v.x, e.nb, e.lo, e.hi,
              least(floor((v.x - e.lo) * (e.nb / (e.hi - e.lo))), e.nb - 1) AS b FROM v JOIN e ON v.dataset = e.dataset),
b1 AS (SELECT *, CASE WHEN x < lo + b * ((hi - lo) / nb) THEN b - 1 ELSE b END AS b1 FROM b0),
b2 AS (SELECT dataset, CASE WHEN x >= lo + (b1 + 1) * ((hi - lo) / nb) AND b1 <> nb - 1 THEN b1 + 1 ELSE b1 END AS b
       FROM b1),
c AS (SELECT dataset, b, count(*) AS cnt FROM b2 GROUP BY dataset, b),
g AS (SELECT dataset, nb, lo, hi, unnest(range(0, nb)) AS b FROM e)
SELECT g.dataset, CAST(g.b AS BIGINT) AS bin, round(g.lo + g.b * ((g.hi - g.lo) / g.nb), 6) AS lo,
       round(g.lo + (g.b + 1) * ((g.hi - g.lo) / g.nb), 6) AS hi, CAST(coalesce(c.cnt, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.dataset = c.dataset AND g.b = c.b"""


@query("f1_histogram", with_views(_HIST, "dialogues"))
def q_histogram(spark, sf):
    """Token-length histogram per split with numpy's 'auto' bins."""
    d = X.dialogues(spark, sf).select("dataset", (F.length("dialogue_text") / F.lit(4.0)).alias("tokens"))
    h = ST.histogram(d, ["dataset"], "tokens")
    return h.select("dataset", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


_SCORE_HIST = _HIST.replace("dataset", "series").replace(
    "SELECT series, length(dialogue_text) / 4.0 AS x FROM dialogues",
    f"SELECT model_id || '/' || metric AS series, score AS x FROM {_LONG} WHERE metric LIKE 'rouge%' AND score IS NOT NULL")


@query("f1_score_histogram", with_views(_SCORE_HIST, "summaries"))
def q_score_histogram(spark, sf):
    """Histogram of each ROUGE score of each model."""
    long = ST.long_scores(X.summaries(spark, sf), ["dialogue_id", "model_id"], ["rouge_1", "rouge_2", "rouge_l"])
    x = long.select(F.concat_ws("/", "model_id", "metric").alias("series"), "score")
    h = ST.histogram(x, ["series"], "score")
    return h.select("series", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query("f2_kde", with_views(kde_sql("sentiments", ["model_id"], "memory_sentiment_usage"), "sentiments"))
def q_kde(spark, sf):
    """Memory-usage density per model (200-point grid, Scott bandwidth)."""
    k = ST.kde(X.sentiments(spark, sf), ["model_id"], "memory_sentiment_usage")
    return k.select("model_id", "point", r6("x").alias("x"), r6("density").alias("density"))


def _box_sql(factor: float) -> str:
    return f"""
SELECT f.model_id, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3,
       round(min(CASE WHEN x >= lo AND x <= hi THEN x END), 6) AS whisker_lo,
       round(max(CASE WHEN x >= lo AND x <= hi THEN x END), 6) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT (x >= lo AND x <= hi)) AS BIGINT) AS n_fliers
FROM (SELECT model_id, q1, q2, q3, q1 - {factor}::DOUBLE * (q3 - q1) AS lo, q3 + {factor}::DOUBLE * (q3 - q1) AS hi
      FROM (SELECT model_id, quantile_cont(memory_sentiment_usage, 0.25) AS q1,
                   quantile_cont(memory_sentiment_usage, 0.5) AS q2,
                   quantile_cont(memory_sentiment_usage, 0.75) AS q3 FROM sentiments GROUP BY model_id)) f
JOIN (SELECT model_id, memory_sentiment_usage AS x FROM sentiments) s ON f.model_id = s.model_id
GROUP BY f.model_id, q1, q2, q3"""


@query("f3_box_stats", with_views(_box_sql(1.5), "sentiments"))
def q_box(spark, sf):
    b = ST.box_stats(X.sentiments(spark, sf), ["model_id"], "memory_sentiment_usage", 1.5)
    return b.select("model_id", *[r6(c).alias(c) for c in ("q1", "q2", "q3", "whisker_lo", "whisker_hi")],
                    "n_fliers")


@query("f3_box_stats_whis3", with_views(_box_sql(3.0), "sentiments"))
def q_box3(spark, sf):
    b = ST.box_stats(X.sentiments(spark, sf), ["model_id"], "memory_sentiment_usage", 3.0)
    return b.select("model_id", *[r6(c).alias(c) for c in ("q1", "q2", "q3", "whisker_lo", "whisker_hi")],
                    "n_fliers")


@query("c6_iqr_outliers", with_views("""
SELECT s.dialogue_id, s.model_id, round(s.memory_sentiment_usage, 6) AS memory_sentiment_usage
FROM sentiments s JOIN (
  SELECT model_id, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi
  FROM (SELECT model_id, quantile_cont(memory_sentiment_usage, 0.25) AS q1,
               quantile_cont(memory_sentiment_usage, 0.75) AS q3 FROM sentiments GROUP BY model_id)) f
  ON s.model_id = f.model_id
WHERE s.memory_sentiment_usage >= f.lo AND s.memory_sentiment_usage <= f.hi""", "sentiments"))
def q_outliers(spark, sf):
    s = X.sentiments(spark, sf).select("dialogue_id", "model_id", "memory_sentiment_usage")
    k = ST.remove_outliers(s, ["model_id"], "memory_sentiment_usage")
    return k.select("dialogue_id", "model_id", r6("memory_sentiment_usage").alias("memory_sentiment_usage"))


@query("f7_score_density", with_views(kde_sql(_LONG + " lf", ["model_id", "metric"], "score"), "summaries"))
def q_score_density(spark, sf):
    """Ridgeline input: long (model, metric, score) -> KDE per (model,
    metric)."""
    long = ST.long_scores(X.summaries(spark, sf), ["dialogue_id", "model_id"], SCORES)
    k = ST.kde(long, ["model_id", "metric"], "score")
    return k.select("model_id", "metric", "point", r6("x").alias("x"), r6("density").alias("density"))
