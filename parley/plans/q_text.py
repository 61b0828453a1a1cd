"""Queries: text preparation, chunking, prompts, generation and output
parsing (B-7, B-8, C-2, C-3, G-5, G-6, I-1..I-10, E-15, E-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as TX
from parley.functions.parse import extract_summary, length_bounds, strip_prompt
from parley.operators import chunking as CH
from parley.operators import generate as G
from parley.plans.oracle_views import VIEWS, _view, chunk_list, strip, with_views, words  # noqa: F401
from parley.plans.registry import query
from parley.schemas import SENTIMENT_PROMPT, SENTIMENT_PROMPT_ZEPHYR, SUMMARY_PROMPTS
from parley.sources import fixtures as X


def r6(c):
    return F.round(c, 6)


def sql_lit(s: str) -> str:
    """SQL text of a Python string (newlines as chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


_PROMPT_VALUES = ", ".join(
    f"('{m}', {sql_lit(t)}, {n}, '{v}')" for m, (t, n, v) in SUMMARY_PROMPTS.items())
_view("prompts", (), f"SELECT * FROM (VALUES {_PROMPT_VALUES}) t(model_id, template, max_new_tokens, parse_variant)")


@query("i1_normalise_text", with_views(r"""
SELECT dialogue_id,
       trim(regexp_replace(dialogue_text, '[ \t\n\r\f]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS norm_text,
       trim(regexp_replace(regexp_replace(lower(dialogue_text), '[^a-zA-Z0-9 \t\n\r\f]', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'),
            ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS strict_text
FROM dialogues""", "dialogues"))
def q_normalise(spark, sf):
    d = X.dialogues(spark, sf)
    return d.select("dialogue_id", TX.normalise_text("dialogue_text").alias("norm_text"),
                    TX.normalise_text("dialogue_text", strict=True).alias("strict_text"))


@query("i2_split_dialogue", with_views("""
SELECT dialogue_id, CAST(chunk_no AS BIGINT) AS chunk_no, chunk_text, length(chunk_text) > 1024 AS over_long
FROM chunks""", "chunks"))
def q_split(spark, sf):
    return CH.split_dialogue(X.dialogues(spark, sf))


_view("conv_chunks", ("dialogues_conv",), f"""
SELECT dialogue_id, unnest(range(0, len(c))) AS chunk_no, unnest(c) AS chunk_text
FROM (SELECT dialogue_id, {chunk_list('dialogue_text')} AS c FROM dialogues_conv)""")


@query("i2_split_conversations", with_views("""
SELECT dialogue_id, CAST(chunk_no AS BIGINT) AS chunk_no, chunk_text, length(chunk_text) > 1024 AS over_long
FROM conv_chunks""", "conv_chunks"))
def q_split_conv(spark, sf):
    """Conversations (role: text per turn) joined to dialogues, then split."""
    return CH.split_dialogue(X.dialogues_conv(spark, sf))


@query("c3_length_branch", with_views("""
SELECT dialogue_id, CASE WHEN length(dialogue_text) < 1024 THEN 'pass' ELSE 'split' END AS branch
FROM dialogues""", "dialogues"))
def q_branch(spark, sf):
    return CH.length_branch(X.dialogues(spark, sf)).select("dialogue_id", "branch")


@query("c2_word_count_filter", with_views(f"""
SELECT dialogue_id, CAST(len({words('dialogue_text')}) AS BIGINT) AS n_words FROM dialogues
WHERE len({words('dialogue_text')}) < 512""", "dialogues"))
def q_word_filter(spark, sf):
    d = X.dialogues(spark, sf).select("dialogue_id", TX.word_count("dialogue_text").cast("long").alias("n_words"))
    return d.where(F.col("n_words") < 512)


@query("b7_token_estimate", with_views("""
SELECT dialogue_id, length(dialogue_text) / 4.0 AS dialogue_tokens,
       length(actual_summary) / 4.0 AS summary_tokens FROM dialogues""", "dialogues"))
def q_tokens(spark, sf):
    d = X.dialogues(spark, sf)
    return d.select("dialogue_id", TX.token_estimate("dialogue_text").alias("dialogue_tokens"),
                    TX.token_estimate("actual_summary").alias("summary_tokens"))


@query("b8_text_length", with_views("""
SELECT dialogue_id, CAST(length(dialogue_text) AS BIGINT) AS text_length FROM dialogues""", "dialogues"))
def q_length(spark, sf):
    return X.dialogues(spark, sf).select("dialogue_id", F.length("dialogue_text").cast("long").alias("text_length"))


@query("i8_length_bounds", with_views(f"""
SELECT dialogue_id, greatest(30, CAST(floor(len({words('dialogue_text')}) * 0.5) AS INTEGER)) AS max_length,
       least(5, CAST(floor(len({words('dialogue_text')}) * 0.2) AS INTEGER)) AS min_length
FROM dialogues""", "dialogues"))
def q_bounds(spark, sf):
    d = X.dialogues(spark, sf)
    return d.select("dialogue_id", length_bounds("dialogue_text").alias("b")).select("dialogue_id", "b.*")


_view("chunk_prompts", ("chunks", "models", "prompts"), """
SELECT c.dialogue_id, c.chunk_no, m.model_id, c.chunk_text, p.parse_variant,
       replace(p.template, '{}', c.chunk_text) AS prompt
FROM chunks c CROSS JOIN models m JOIN prompts p ON p.model_id = m.model_id""")


@query("i3_render_prompt", with_views("""
SELECT dialogue_id, CAST(chunk_no AS BIGINT) AS chunk_no, model_id, prompt FROM chunk_prompts""",
                                      "chunk_prompts"))
def q_prompts(spark, sf):
    ch = X.per_model(CH.split_dialogue(X.dialogues(spark, sf)))
    return G.render_prompt(ch, text="chunk_text").select("dialogue_id", "chunk_no", "model_id", "prompt")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("i3_sentiment_prompts", with_views(f"""
SELECT d.dialogue_id, m.model_id,
       replace(CASE m.model_id WHEN 'zephyr 7b beta' THEN {_sql_text(SENTIMENT_PROMPT_ZEPHYR)} ELSE {_sql_text(SENTIMENT_PROMPT)} END,
               '{{}}', d.dialogue_text) AS prompt
FROM dialogues d CROSS JOIN models m""", "dialogues", "models"))
def q_sentiment_prompts(spark, sf):
    """Every model's sentiment prompt of every dialogue; one model has a
    template of its own."""
    d = X.per_model(X.dialogues(spark, sf).select("dialogue_id", "dialogue_text"))
    return G.sentiment_prompts(d).select("dialogue_id", "model_id", "prompt")


_view("raw_summaries", ("chunk_prompts",), f"""
SELECT dialogue_id, chunk_no, model_id, parse_variant,
       prompt || ' ' || array_to_string({words('chunk_text')}, ' ') || chr(10) || 'Note: end.' AS output
FROM chunk_prompts""")

_SUMMARY_CASE = f"""
CASE WHEN strpos(output, 'Summary:') = 0 THEN ''
     WHEN parse_variant = 'rest' THEN {strip("substring(output, strpos(output, 'Summary:') + 8)")}
     ELSE split_part({strip("substring(output, strpos(output, 'Summary:') + 8)")}, chr(10), 1) END"""


@query("i6_extract_summary", with_views(f"""
SELECT dialogue_id, CAST(chunk_no AS BIGINT) AS chunk_no, model_id, {_SUMMARY_CASE} AS summary
FROM raw_summaries""", "raw_summaries"))
def q_extract_summary(spark, sf):
    """Each model's parse variant on its raw output (prompt echo + answer
    + a trailing line)."""
    ch = X.per_model(CH.split_dialogue(X.dialogues(spark, sf)))
    pr = G.render_prompt(ch, text="chunk_text")
    raw = pr.withColumn("output", F.concat(F.col("prompt"), F.lit(" "), F.array_join(TX.words("chunk_text"), " "),
                                           F.lit("\nNote: end.")))
    s = F.when(F.col("parse_variant") == "rest", extract_summary("output", "rest")) \
         .otherwise(extract_summary("output", "first_line"))
    return raw.select("dialogue_id", "chunk_no", "model_id", s.alias("summary"))


@query("i6_extract_summary_fallback", with_views(f"""
SELECT dialogue_id, CASE WHEN strpos(output, 'Summary: ') > 0
                         THEN {strip("substring(output, strpos(output, 'Summary: ') + 9)")} ELSE output END AS summary
FROM (SELECT dialogue_id, CASE WHEN dialogue_id % 3 = 0 THEN dialogue_text
                               WHEN dialogue_id % 3 = 1 THEN dialogue_text || ' Summary:' || actual_summary
                               ELSE dialogue_text || ' Summary: ' || actual_summary || chr(10) END AS output FROM dialogues)""",
                                               "dialogues"))
def q_extract_fallback(spark, sf):
    """Fallback variant: the rest after ``Summary: ``, else the whole output."""
    d, k = X.dialogues(spark, sf), F.col("dialogue_id") % 3
    out = F.when(k == 0, F.col("dialogue_text")).when(k == 1, F.concat("dialogue_text", F.lit(" Summary:"), "actual_summary")) \
        .otherwise(F.concat("dialogue_text", F.lit(" Summary: "), "actual_summary", F.lit("\n")))
    return d.select("dialogue_id", extract_summary(out, "fallback").alias("summary"))


@query("i6_strip_prompt", with_views(f"""
SELECT dialogue_id, CAST(chunk_no AS BIGINT) AS chunk_no, model_id,
       {strip("' ' || array_to_string(" + words('chunk_text') + ", ' ') || chr(10) || 'Summary: end.'")} AS answer
FROM chunk_prompts""", "chunk_prompts"))
def q_strip_prompt(spark, sf):
    """Answers without the prompt that the output repeats: markers inside
    the dialogue or the prompt do not count."""
    ch = X.per_model(CH.split_dialogue(X.dialogues(spark, sf)))
    raw = G.render_prompt(ch, text="chunk_text").withColumn(
        "output", F.concat(F.col("prompt"), F.lit(" "), F.array_join(TX.words("chunk_text"), " "), F.lit("\nSummary: end.")))
    return raw.select("dialogue_id", "chunk_no", "model_id", TX.strip_ws(strip_prompt("output", "prompt")).alias("answer"))


@query("i6_extract_summary_service", with_views(r"""
SELECT dialogue_id, trim(regexp_extract(output, '(?s)Summarization:[ \t\n\r\f]*\n\n(.*)', 1),
                         ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS summary
FROM (SELECT dialogue_id, 'Summarization:' || chr(10) || chr(10) || actual_summary || chr(10) AS output
      FROM dialogues)""", "dialogues"))
def q_extract_service(spark, sf):
    """Service variant: DOTALL group after ``Summarization:`` + blank line."""
    d = X.dialogues(spark, sf).select(
        "dialogue_id", F.concat(F.lit("Summarization:\n\n"), F.col("actual_summary"), F.lit("\n")).alias("output"))
    return d.select("dialogue_id", extract_summary("output", "service").alias("summary"))


@query("e15_reassemble_chunks", with_views("""
SELECT dialogue_id, model_id, string_agg(coalesce(summary, ''), '' ORDER BY chunk_no) AS summary,
       round(sum(time_taken), 6) AS time_taken, round(sum(memory_usage), 6) AS memory_usage
FROM chunk_results GROUP BY dialogue_id, model_id""", "chunk_results"))
def q_reassemble(spark, sf):
    r = CH.reassemble(X.chunk_results(spark, sf), ["dialogue_id", "model_id"])
    return r.select("dialogue_id", "model_id", "summary", r6("time_taken").alias("time_taken"),
                    r6("memory_usage").alias("memory_usage"))


@query("e16_batch_means", with_views("""
SELECT r.model_id, r.batch_id, CAST(count(*) AS BIGINT) AS batch_size,
       round(sum(r.time_taken) / count(*), 6) AS time_per_dialogue,
       round((max(r.memory_usage) - any_value(o.offset)) / count(*), 6) AS memory_per_dialogue
FROM chunk_results r JOIN (SELECT model_id, min(memory_usage) AS offset FROM chunk_results GROUP BY model_id) o
  ON r.model_id = o.model_id
GROUP BY r.model_id, r.batch_id""", "chunk_results"))
def q_batch_means(spark, sf):
    res = X.chunk_results(spark, sf)
    off = res.groupBy("model_id").agg(F.min("memory_usage").alias("offset"))
    b = CH.batch_means(res, ["model_id"], offset=off)
    return b.select("model_id", "batch_id", "batch_size", r6("time_per_dialogue").alias("time_per_dialogue"),
                    r6("memory_per_dialogue").alias("memory_per_dialogue"))


@query("g5_first_per_key", with_views("""
SELECT dialogue_id, model_id, summary FROM chunk_results WHERE chunk_no = 0""", "chunk_results"))
def q_first_per_key(spark, sf):
    """Drop duplicates by key keeping the first by an explicit order."""
    from parley.operators.shaping import first_per_key
    r = X.chunk_results(spark, sf).select("dialogue_id", "model_id", "chunk_no", "summary")
    return first_per_key(r, ["dialogue_id", "model_id"], "chunk_no").select("dialogue_id", "model_id", "summary")


@query("g6_distinct_partials", with_views("""
SELECT dialogue_id, array_to_string(list_distinct_ordered, chr(10)) AS summary FROM (
  SELECT dialogue_id, list(summary ORDER BY first_no) AS list_distinct_ordered FROM (
    SELECT dialogue_id, summary, min(chunk_no) AS first_no FROM chunk_results
    WHERE model_id = 'falcon 7b' GROUP BY dialogue_id, summary)
  GROUP BY dialogue_id)""", "chunk_results"))
def q_distinct_partials(spark, sf):
    """Service path: equal partial summaries kept once, in chunk order,
    joined by newline."""
    r = X.chunk_results(spark, sf).where(F.col("model_id") == "falcon 7b")
    return CH.reassemble(r, ["dialogue_id"], sep="\n", sums=(), distinct=True)


_view("lead_summaries", ("chunks",), f"""
SELECT dialogue_id, chunk_no,
       array_to_string({words("chunk_text || chr(10) || 'Summary:'")}, ' ') AS summary
FROM chunks""")


@query("i4_generate", with_views("""
SELECT dialogue_id, CAST(chunk_no AS BIGINT) AS chunk_no, summary FROM lead_summaries""", "lead_summaries"))
def q_generate(spark, sf):
    """Batched generation (25 prompts per call) with a deterministic
    stand-in model, then the model's parse variant."""
    template, _, variant = SUMMARY_PROMPTS["falcon 7b"]
    ch = CH.split_dialogue(X.dialogues(spark, sf))
    pr = G.render_prompt(ch, text="chunk_text", template=template)
    g = G.generate(pr.select("dialogue_id", "chunk_no", "prompt"), G.LeadWords())
    return g.select("dialogue_id", "chunk_no", extract_summary("output", variant).alias("summary"))


@query("i9_summarise_long", with_views("""
SELECT dialogue_id, 'falcon 7b' AS model_id, string_agg(summary, '' ORDER BY chunk_no) AS summary
FROM lead_summaries GROUP BY dialogue_id""", "lead_summaries"))
def q_summarise_long(spark, sf):
    s = G.summarise_long(X.dialogues(spark, sf).select("dialogue_id", "dialogue_text"),
                         G.LeadWords(), "falcon 7b")
    return s.select("dialogue_id", "model_id", "summary")


@query("i5_teacher_label", with_views(f"""
SELECT d.dialogue_id, coalesce(t.label, d.actual_sentiment) AS actual_sentiment
FROM dialogues d LEFT JOIN (
  SELECT dialogue_id,
         CASE (length(dialogue_text) + {len(G.TEACHER_PROMPT) - 2}) % 3
              WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label
  FROM dialogues WHERE len({words('dialogue_text')}) < 512) t
ON d.dialogue_id = t.dialogue_id""", "dialogues"))
def q_teacher(spark, sf):
    """Teacher labels for dialogues under 512 words, written back over the
    existing labels with one join (upsert)."""
    from parley.sources.sinks import upsert_labels
    d = X.dialogues(spark, sf)
    lab = G.teacher_label(d.select("dialogue_id", "dialogue_text"), G.LengthTeacher())
    return upsert_labels(d, lab).select("dialogue_id", "actual_sentiment")


@query("i5_labels_in_parts", with_views(f"""
SELECT d.dialogue_id, coalesce(t.label, d.actual_sentiment) AS actual_sentiment, t.batch_id
FROM dialogues d LEFT JOIN (
  SELECT dialogue_id, CAST(ntile(13) OVER (ORDER BY dialogue_id) - 1 AS INTEGER) AS batch_id,
         CASE (length(dialogue_text) + {len(G.TEACHER_PROMPT) - 2}) % 3
              WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label
  FROM dialogues WHERE len({words('dialogue_text')}) < 512) t
ON d.dialogue_id = t.dialogue_id""", "dialogues"))
def q_labels_in_parts(spark, sf):
    """Teacher labels in 13 resumable parts, recombined and written back
    over the existing labels."""
    from parley.functions.text import word_count
    from parley.schemas import TEACHER_MAX_WORDS
    from parley.session import fresh_path
    from parley.sources.ranges import RangeRun
    from parley.sources.sinks import upsert_labels
    d = X.dialogues(spark, sf)
    fit = d.where(word_count("dialogue_text") < TEACHER_MAX_WORDS).select("dialogue_id", "dialogue_text")
    run = RangeRun(spark, fresh_path(spark, "labelled"))
    run.run(fit, "dialogue_id", lambda part: G.teacher_label(part, G.LengthTeacher()), 13)
    lab = run.result()
    out = upsert_labels(d.select("dialogue_id", "actual_sentiment"), lab)
    return out.join(lab.select("dialogue_id", "batch_id"), "dialogue_id", "left")


@query("i10_run_cost", with_views("""
SELECT model_id,
       round(arg_min(mem_before, dialogue_id), 6) AS first_mem_before,
       round(arg_max(mem_after, dialogue_id), 6) AS last_mem_after,
       round(arg_min(load_before, dialogue_id), 6) AS first_load_before,
       round(arg_max(load_after, dialogue_id), 6) AS last_load_after,
       round(sum(time_sentiment_taken), 6) AS elapsed,
       round(sum(mem_after - mem_before), 6) AS mem_delta_total,
       round(avg(load_after - load_before), 6) AS load_delta_mean
FROM (SELECT *, memory_sentiment_usage AS mem_before,
             memory_sentiment_usage + time_sentiment_taken * 10.0 AS mem_after,
             CAST(dialogue_id % 10 AS DOUBLE) / 10.0 AS load_before,
             CAST(dialogue_id % 7 AS DOUBLE) / 7.0 AS load_after FROM sentiments)
GROUP BY model_id""", "sentiments"))
def q_run_cost(spark, sf):
    s = X.sentiments(spark, sf).select(
        "*", F.col("memory_sentiment_usage").alias("mem_before"),
        (F.col("memory_sentiment_usage") + F.col("time_sentiment_taken") * F.lit(10.0)).alias("mem_after"),
        ((F.col("dialogue_id") % 10).cast("double") / F.lit(10.0)).alias("load_before"),
        ((F.col("dialogue_id") % 7).cast("double") / F.lit(7.0)).alias("load_after"),
        F.col("time_sentiment_taken").alias("time_taken"))
    r = G.run_cost(s)
    return r.select("model_id", *[r6(c).alias(c) for c in r.columns if c != "model_id"])

