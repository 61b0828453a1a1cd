"""Queries: sources and sinks (A-1, A-5..A-9, A-11..A-16). Each writes
Spark-derived data under the shared scratch folder with the operator
under test and reads it back, so the oracle is the source table."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import chunking as CH
from parley.operators import classification as C
from parley.operators import generate as G
from parley.operators.quality import check_constraints, check_declared
from parley.functions.parse import extract_sentiment
from parley.functions.text import words
from parley.plans.oracle_views import with_views
from parley.plans.registry import query
from parley.schemas import MODEL_IDS, SENTIMENTS
from parley.session import fresh_path
from parley.sources import files as FI
from parley.sources import fixtures as X
from parley.sources import sinks as SK
from parley.sources.ranges import RangeRun, RangeTable

KEY = ["dialogue_id", "model_id"]


def r6(c):
    return F.round(c, 6)


def _table_cols(d):
    """The dialogues table's own columns (the load rejects any other)."""
    return d.select("dialogue_id", "dataset", "dialogue_text", "actual_summary", "actual_sentiment")


@query("a1_read_dialogue_csv", with_views("""
SELECT CAST(dialogue_id AS VARCHAR) AS id, dialogue_text AS dialogue, actual_summary AS summary, topic,
       actual_sentiment AS sentiment FROM dialogues WHERE dataset = 'training'""", "dialogues"))
def q_read_csv(spark, sf):
    """Labelled split written as CSV (long texts with newlines and quotes),
    read back with a fixed schema."""
    d = X.dialogues(spark, sf).where(F.col("dataset") == "training").select(
        F.col("dialogue_id").cast("string").alias("id"), F.col("dialogue_text").alias("dialogue"),
        F.col("actual_summary").alias("summary"), "topic", F.col("actual_sentiment").alias("sentiment"))
    path = fresh_path(spark, "train-csv")
    SK.write_csv(d, path)
    return FI.read_dialogue_csv(spark, path, labelled=True)


@query("a5_scan_table", with_views("""
SELECT dialogue_id, dataset, topic, actual_sentiment FROM dialogues""", "dialogues"))
def q_scan_table(spark, sf):
    """All splits bulk-loaded into a table partitioned by dataset, then a
    full scan of the stored table."""
    base = fresh_path(spark, "tables")
    SK.recreate_table(spark, "dialogues", base, partition_by=("dataset",))
    SK.bulk_load(_table_cols(X.dialogues(spark, sf)), "dialogues", base)
    return FI.scan_table(spark, f"{base}/dialogues").select("dialogue_id", "dataset", "actual_sentiment") \
        .join(X.dialogues(spark, sf).select("dialogue_id", "topic"), "dialogue_id") \
        .select("dialogue_id", "dataset", "topic", "actual_sentiment")


@query("a12_bulk_load", with_views("""
SELECT dialogue_id, dataset FROM dialogues WHERE dataset = 'training'""", "dialogues"))
def q_bulk_load(spark, sf):
    """Bulk load of selected splits (training), read back with partition
    pruning on the dataset folder."""
    base = fresh_path(spark, "tables")
    SK.bulk_load(_table_cols(X.dialogues(spark, sf)), "dialogues", base, datasets=("training",), batchsize=1000)
    return FI.scan_split(FI.scan_table(spark, f"{base}/dialogues"), "training").select("dialogue_id", "dataset")


@query("a6_read_results_csv", with_views("""
SELECT dialogue_id, summary, round(time_taken, 6) AS time_taken, round(memory_usage, 6) AS memory_usage
FROM (SELECT dialogue_id, string_agg(coalesce(summary, ''), '' ORDER BY chunk_no) AS summary,
             sum(time_taken) AS time_taken, sum(memory_usage) AS memory_usage
      FROM chunk_results WHERE model_id = 'gemma 7b' GROUP BY dialogue_id)""", "chunk_results"))
def q_read_results(spark, sf):
    """A result file in the second header style, read and normalised."""
    r = CH.reassemble(X.chunk_results(spark, sf).where(F.col("model_id") == "gemma 7b"), ["dialogue_id"])
    style2 = r.select("dialogue_id", F.col("summary").alias("Summary"), F.col("time_taken").alias("Time Taken (s)"),
                      F.col("memory_usage").alias("GPU Usage (MB)"))
    path = fresh_path(spark, "results-csv")
    SK.write_csv(style2, path)
    out = FI.read_results_csv(spark, path)
    return out.select("dialogue_id", "summary", r6("time_taken").alias("time_taken"),
                      r6("memory_usage").alias("memory_usage"))


@query("a7_append_batches", with_views("""
SELECT dialogue_id, model_id, CAST(chunk_no AS BIGINT) AS chunk_no, summary, batch_id,
       round(time_taken, 6) AS time_taken, round(memory_usage, 6) AS memory_usage FROM chunk_results""",
                                       "chunk_results"))
def q_append_batches(spark, sf):
    """Batches appended per (model, batch); a first run stops after the
    training split (a crash), the re-run appends only what is missing."""
    res = X.chunk_results(spark, sf).withColumn("chunk_no", F.col("chunk_no").cast("long"))
    keys = ["dialogue_id", "model_id", "chunk_no"]
    path = fresh_path(spark, "batches")
    training = X.dialogues(spark, sf).where(F.col("dataset") == "training").select("dialogue_id")
    SK.append_batches(res.join(training, "dialogue_id", "left_semi"), path, keys)
    SK.append_batches(res, path, keys)
    out = spark.read.parquet(path)
    return out.select("dialogue_id", "model_id", "chunk_no", "summary", F.col("batch_id").cast("long"),
                      r6("time_taken").alias("time_taken"), r6("memory_usage").alias("memory_usage"))


@query("a8_write_csv", with_views("""
SELECT dialogue_id, model_id, generated_sentiment, round(memory_sentiment_usage, 6) AS memory_sentiment_usage,
       round(time_sentiment_taken, 6) AS time_sentiment_taken FROM sentiments""", "sentiments"))
def q_write_csv(spark, sf):
    s = X.sentiments(spark, sf)
    path = fresh_path(spark, "sentiments-csv")
    SK.write_csv(s, path)
    schema = "dialogue_id long, model_id string, generated_sentiment string, memory_sentiment_usage double, " \
             "time_sentiment_taken double"
    back = spark.read.options(**FI.CSV_READ).schema(schema).csv(path)
    return back.select("dialogue_id", "model_id", "generated_sentiment",
                       r6("memory_sentiment_usage").alias("memory_sentiment_usage"),
                       r6("time_sentiment_taken").alias("time_sentiment_taken"))


@query("a9_append_table", with_views("""
SELECT dialogue_id, model_id, generated_sentiment, round(memory_sentiment_usage, 6) AS memory_sentiment_usage,
       round(time_sentiment_taken, 6) AS time_sentiment_taken, true AS has_key FROM sentiments""", "sentiments"))
def q_append_table(spark, sf):
    """Column-checked append into the sentiments table (surrogate key
    generated), read back."""
    base = fresh_path(spark, "tables")
    SK.append_table(X.sentiments(spark, sf), "sentiments", base)
    t = spark.read.schema(SENTIMENTS).parquet(f"{base}/sentiments")
    return t.select("dialogue_id", "model_id", "generated_sentiment",
                    r6("memory_sentiment_usage").alias("memory_sentiment_usage"),
                    r6("time_sentiment_taken").alias("time_sentiment_taken"),
                    F.col("sentiment_id").isNotNull().alias("has_key"))


@query("a11_recreate_table", with_views("""
SELECT model_id, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS f1_score FROM model_metrics""",
                                        "model_metrics"))
def q_recreate(spark, sf):
    """sentiment_evaluation recreated empty from its schema, then loaded
    with every model's accuracy and F1."""
    base = fresh_path(spark, "tables")
    SK.recreate_table(spark, "sentiment_evaluation", base)
    m = C.sentiment_metrics(X.dialogues(spark, sf), X.sentiments(spark, sf))
    SK.append_table(m.select("model_id", "accuracy", F.col("weighted_f1").alias("f1_score")),
                    "sentiment_evaluation", base)
    t = FI.scan_table(spark, f"{base}/sentiment_evaluation")
    return t.select("model_id", r6("accuracy").alias("accuracy"), r6("f1_score").alias("f1_score"))


@query("a13_check_constraints", with_views(f"""
WITH d AS (SELECT dialogue_id, dataset, dialogue_text, actual_summary, actual_sentiment FROM dialogues
           UNION ALL
           SELECT dialogue_id, 'training', dialogue_text,
                  array_to_string(list_filter(regexp_split_to_array(dialogue_text, '[ \\t\\n\\r\\f]+'),
                                              lambda w: w <> ''), ' '), NULL FROM dialogues_conv),
s AS (SELECT dialogue_id, model_id,
             trim(string_split(replace(raw_output, chr(10) || chr(10), '$#$#$#'), '$#$#$#')[-1],
                  ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS generated_sentiment FROM raw_outputs),
m AS (SELECT model_id FROM models UNION ALL SELECT 'mistral 7b')
SELECT 'dialogues' AS table_name, 'not_null:dataset' AS "check", CAST(count(*) FILTER (WHERE dataset IS NULL) AS BIGINT) AS n_violations FROM d
UNION ALL SELECT 'dialogues', 'not_null:dialogue_text', CAST(count(*) FILTER (WHERE dialogue_text IS NULL) AS BIGINT) FROM d
UNION ALL SELECT 'dialogues', 'not_null:actual_summary', CAST(count(*) FILTER (WHERE actual_summary IS NULL) AS BIGINT) FROM d
UNION ALL SELECT 'dialogues', 'max_length:dataset', CAST(count(*) FILTER (WHERE length(dataset) > 10) AS BIGINT) FROM d
UNION ALL SELECT 'dialogues', 'max_length:actual_sentiment', CAST(count(*) FILTER (WHERE length(actual_sentiment) > 8) AS BIGINT) FROM d
UNION ALL SELECT 'dialogues', 'domain:actual_sentiment', CAST(count(*) FILTER (WHERE actual_sentiment IS NOT NULL AND actual_sentiment NOT IN ('negative', 'neutral', 'positive')) AS BIGINT) FROM d
UNION ALL SELECT 'dialogues', 'primary_key:dialogue_id', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT dialogue_id, count(*) AS c FROM d GROUP BY dialogue_id HAVING count(*) > 1)
UNION ALL SELECT 'sentiments', 'max_length:generated_sentiment', CAST(count(*) FILTER (WHERE length(generated_sentiment) > 8) AS BIGINT) FROM s
UNION ALL SELECT 'sentiments', 'domain:generated_sentiment', CAST(count(*) FILTER (WHERE generated_sentiment IS NOT NULL AND generated_sentiment NOT IN ('negative', 'neutral', 'positive')) AS BIGINT) FROM s
UNION ALL SELECT 'sentiments', 'foreign_key:dialogue_id->dialogues', CAST(count(*) AS BIGINT) FROM s WHERE dialogue_id NOT IN (SELECT dialogue_id FROM d)
UNION ALL SELECT 'sentiments', 'foreign_key:model_id->models', CAST(count(*) AS BIGINT) FROM s WHERE model_id NOT IN (SELECT model_id FROM m)
UNION ALL SELECT 'models', 'not_null:model_id', CAST(count(*) FILTER (WHERE model_id IS NULL) AS BIGINT) FROM m
UNION ALL SELECT 'models', 'max_length:model_id', CAST(count(*) FILTER (WHERE length(model_id) > 50) AS BIGINT) FROM m
UNION ALL SELECT 'models', 'primary_key:model_id', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT model_id, count(*) AS c FROM m GROUP BY model_id HAVING count(*) > 1)""",
                                           "dialogues", "dialogues_conv", "raw_outputs", "models"))
def q_constraints(spark, sf):
    """Constraint report over dialogues (documents plus conversations,
    whose ids collide), raw sentiment answers (not yet parsed: too long,
    outside the label domain) and a model table with a repeated insert."""
    d = X.dialogues(spark, sf).select("dialogue_id", "dataset", "dialogue_text", "actual_summary", "actual_sentiment")
    conv = X.dialogues_conv(spark, sf).select(
        "dialogue_id", F.lit("training").alias("dataset"), "dialogue_text",
        F.array_join(words("dialogue_text"), " ").alias("actual_summary"), F.lit(None).cast("string").alias("actual_sentiment"))
    raw = X.raw_outputs(spark, sf).select(
        *KEY, F.replace(F.col("raw_output"), F.lit("\n\n"), F.lit("$#$#$#")).alias("raw_output"))
    s = raw.select(*KEY, extract_sentiment("raw_output", "v3").alias("generated_sentiment"))
    m = X.models(spark).select("model_id").unionByName(spark.createDataFrame([("mistral 7b",)], "model_id string"))
    return check_constraints(d.unionByName(conv), s, m)


def _declared_sql() -> str:
    """The five tables with planted faults, and one count per rule."""
    from parley.schemas import DECLARED, LABEL_DOMAINS
    key = {t: c for t, c, rule, _ in DECLARED if rule == "primary_key"}
    counts = []
    for t, c, rule, v in DECLARED + LABEL_DOMAINS:
        broken = {"not_null": f"{c} IS NULL", "max_length": f"length({c}) > {v}", "primary_key": f"{c} IS NULL",
                  "domain": f"{c} IS NOT NULL AND {c} NOT IN ('negative', 'neutral', 'positive')",
                  "foreign_key": f"{c} IS NOT NULL AND {c} NOT IN (SELECT {key.get(v)} FROM t_{v} WHERE {key.get(v)} IS NOT NULL)"}[rule]
        name = f"not_null:{c}" if rule == "primary_key" else f"foreign_key:{c}->{v}" if rule == "foreign_key" else f"{rule}:{c}"
        counts.append(f"SELECT '{t}' AS table_name, '{name}' AS \"check\", CAST(count(*) AS BIGINT) AS n_violations FROM t_{t} WHERE {broken}")
        if rule == "primary_key":
            counts.append(f"SELECT '{t}', 'primary_key:{c}', CAST(count({c}) - count(DISTINCT {c}) AS BIGINT) FROM t_{t}")
    return """
WITH t_dialogues AS (
  SELECT CASE WHEN dialogue_id % 83 = 5 THEN dialogue_id - 1 ELSE dialogue_id END AS dialogue_id,
         CASE WHEN dialogue_id % 97 = 0 THEN dataset || '-with-a-long-name' ELSE dataset END AS dataset, dialogue_text,
         CASE WHEN dialogue_id % 89 <> 0 THEN actual_summary END AS actual_summary, actual_sentiment FROM dialogues),
t_summaries AS (
  SELECT CASE WHEN dialogue_id % 101 <> 0 THEN dialogue_id * 8 + model_no END AS summary_id,
         CASE WHEN dialogue_id % 71 = 0 THEN -1 - dialogue_id WHEN dialogue_id % 71 <> 1 THEN dialogue_id END AS dialogue_id,
         CASE WHEN (dialogue_id + model_no) % 113 = 0 THEN 'unknown ' || repeat('x', 60) ELSE model_id END AS model_id
  FROM raw_outputs),
t_sentiments AS (
  SELECT dialogue_id * 8 AS sentiment_id, dialogue_id, model_id,
         CASE WHEN dialogue_id % 61 = 0 THEN 'very ' || generated_sentiment ELSE generated_sentiment END AS generated_sentiment
  FROM sentiments),
t_models AS (SELECT model_id FROM models UNION ALL SELECT 'mistral 7b'),
t_sentiment_evaluation AS (
  SELECT CAST(length(model_id) AS BIGINT) AS evaluation_id, CASE WHEN n > 0 THEN model_id || '!' ELSE model_id END AS model_id
  FROM (SELECT model_id, count(*) FILTER (WHERE dialogue_id IS NULL) AS n FROM sentiments GROUP BY model_id))
""" + "\nUNION ALL ".join(counts)


@query("a13_declared_constraints", with_views(_declared_sql(), "dialogues", "raw_outputs", "sentiments", "models"))
def q_declared(spark, sf):
    """Every declared rule of all five tables, with planted faults: repeated,
    missing and unknown keys, texts over their length, labels outside the
    domain. The models are a registry: a literal set."""
    did = F.col("dialogue_id")
    d = X.dialogues(spark, sf)
    td = d.select(F.when(did % 83 == 5, did - 1).otherwise(did).alias("dialogue_id"),
                  F.when(did % 97 == 0, F.concat("dataset", F.lit("-with-a-long-name"))).otherwise(F.col("dataset")).alias("dataset"),
                  "dialogue_text", F.when(did % 89 != 0, F.col("actual_summary")).alias("actual_summary"), "actual_sentiment")
    ts = X.raw_outputs(spark, sf).select(
        F.when(did % 101 != 0, did * 8 + F.col("model_no")).alias("summary_id"),
        F.when(did % 71 == 0, -1 - did).when(did % 71 != 1, did).alias("dialogue_id"),
        F.when((did + F.col("model_no")) % 113 == 0, F.concat(F.lit("unknown "), F.repeat(F.lit("x"), 60)))
        .otherwise(F.col("model_id")).alias("model_id"))
    sent = X.sentiments(spark, sf)
    tn = sent.select((did * 8).alias("sentiment_id"), "dialogue_id", "model_id",
                     F.when(did % 61 == 0, F.concat(F.lit("very "), F.col("generated_sentiment")))
                     .otherwise(F.col("generated_sentiment")).alias("generated_sentiment"))
    tm = spark.createDataFrame([(m,) for m in (*MODEL_IDS, MODEL_IDS[0])], "model_id string")
    te = sent.groupBy("model_id").agg(F.count_if(did.isNull()).alias("n")).select(
        F.length("model_id").cast("long").alias("evaluation_id"),
        F.when(F.col("n") > 0, F.concat("model_id", F.lit("!"))).otherwise(F.col("model_id")).alias("model_id"))
    return check_declared({"dialogues": td, "models": tm, "summaries": ts, "sentiments": tn, "sentiment_evaluation": te},
                          registries={"models": MODEL_IDS})


@query("a14_upsert_labels", with_views("""
SELECT d.dialogue_id, coalesce(s.generated_sentiment, d.actual_sentiment) AS actual_sentiment
FROM dialogues d LEFT JOIN (SELECT s.dialogue_id, s.generated_sentiment FROM sentiments s
                            JOIN dialogues d2 ON s.dialogue_id = d2.dialogue_id
                            WHERE s.model_id = 'mistral 7b' AND d2.dataset = 'test') s
  ON d.dialogue_id = s.dialogue_id""", "dialogues", "sentiments"))
def q_upsert(spark, sf):
    """Labels of the test split replaced by one model's predictions."""
    d = X.dialogues(spark, sf)
    test_ids = d.where(F.col("dataset") == "test").select("dialogue_id")
    new = (X.sentiments(spark, sf).where(F.col("model_id") == "mistral 7b")
           .join(test_ids, "dialogue_id", "left_semi")
           .select("dialogue_id", F.col("generated_sentiment").alias("actual_sentiment")))
    return SK.upsert_labels(d, new).select("dialogue_id", "actual_sentiment")


@query("a14_upsert_in_place", with_views("""
SELECT d.dialogue_id, d.dataset, d.topic, coalesce(s.generated_sentiment, d.actual_sentiment) AS actual_sentiment
FROM dialogues d LEFT JOIN (SELECT s.dialogue_id, s.generated_sentiment FROM sentiments s
                            JOIN dialogues d2 ON s.dialogue_id = d2.dialogue_id
                            WHERE s.model_id = 'mistral 7b' AND d2.dataset = 'test') s
  ON d.dialogue_id = s.dialogue_id""", "dialogues", "sentiments"))
def q_upsert_in_place(spark, sf):
    """The same labels written into a stored table of 20 ranges; the upsert
    is run again, which writes nothing."""
    d = X.dialogues(spark, sf).select("dialogue_id", "dataset", "topic", "actual_sentiment")
    new = (X.sentiments(spark, sf).where(F.col("model_id") == "mistral 7b")
           .join(d.where(F.col("dataset") == "test").select("dialogue_id"), "dialogue_id", "left_semi")
           .select("dialogue_id", F.col("generated_sentiment").alias("actual_sentiment")))
    table = RangeTable(spark, fresh_path(spark, "dialogues"))
    table.create(d, "dialogue_id", 20)
    for _ in range(2):
        table.upsert(new, "dialogue_id", ["actual_sentiment"])
    return table.read()


@query("a7_resumable_ranges", with_views(f"""
SELECT dialogue_id, CAST(ntile(5) OVER (ORDER BY dialogue_id) - 1 AS INTEGER) AS batch_id,
       CASE (length(dialogue_text) + {len(G.TEACHER_PROMPT) - 2}) % 3
            WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS output
FROM dialogues""", "dialogues"))
def q_resumable(spark, sf):
    """Generation over five key ranges, stopped after two and gone on with
    by a second run, which takes up the first one's log."""
    d = X.dialogues(spark, sf).select("dialogue_id", "dialogue_text")
    path = fresh_path(spark, "generated")

    def work(part):
        return G.generate(G.render_prompt(part, template=G.TEACHER_PROMPT), G.LengthTeacher()).select("dialogue_id", "output")
    RangeRun(spark, path).run(d, "dialogue_id", work, 5, at_most=2)
    again = RangeRun(spark, path)
    again.run(d, "dialogue_id", work, 5)
    return again.result().select("dialogue_id", "batch_id", "output")


@query("a15_register_models", with_views("""
SELECT model_id FROM (VALUES """ + ", ".join(f"('{m}')" for m in MODEL_IDS + ("mpt 7b",)) + """) t(model_id)
WHERE model_id NOT IN (SELECT DISTINCT model_id FROM sentiments)""", "sentiments"))
def q_register(spark, sf):
    """Idempotent registration: ids already present (in the predictions
    table) are not inserted again."""
    existing = X.sentiments(spark, sf).select("model_id").distinct()
    return SK.register_models(spark, existing, MODEL_IDS + ("mpt 7b",))


@query("a16_run_metrics", with_views("""
SELECT regexp_replace(model_id, '[^A-Za-z0-9]+', '_', 'g') AS model_key, 'pre_training_memory_usage' AS name,
       min(memory_sentiment_usage) AS value
FROM sentiments GROUP BY model_id""", "sentiments"))
def q_run_metrics(spark, sf):
    """Per-run metric written as ``name: value MB`` text, parsed back."""
    m = X.sentiments(spark, sf).groupBy("model_id").agg(
        F.min("memory_sentiment_usage").alias("value")).select(
        "model_id", F.lit("pre_training_memory_usage").alias("name"), "value")
    path = fresh_path(spark, "run-metrics")
    SK.write_run_metrics(m, path)
    return FI.read_run_metrics(spark, path)



_SUMMARY_SCORES = ("rouge_1", "rouge_2", "rouge_l", "meteor", "bert_precision", "bert_recall", "bert_f1",
                   "memory_summary_usage", "time_summary_taken")


@query("a9_append_summaries", with_views("SELECT dialogue_id, model_id, generated_summary, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _SUMMARY_SCORES) + ", true AS has_key FROM all_scores", "all_scores"))
def q_append_summaries(spark, sf):
    """Scored summaries (all score columns) appended to the summaries
    table through the column check, read back."""
    scored = X.scored(spark, sf).drop("actual_summary")
    base = fresh_path(spark, "tables")
    SK.append_table(scored, "summaries", base)
    from parley.schemas import SUMMARIES
    t = spark.read.schema(SUMMARIES).parquet(f"{base}/summaries")
    return t.select(*KEY, "generated_summary", *[r6(c).alias(c) for c in _SUMMARY_SCORES],
                    F.col("summary_id").isNotNull().alias("has_key"))
