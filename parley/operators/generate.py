"""Prompt rendering and batched generation through a user callable.

The language model is the user's: any object callable as
``generator(list_of_prompts) -> list_of_outputs``. If it has a ``load()``
method, that runs once per task (model weights are not shipped per row).
Generation runs in ``mapInPandas`` over Arrow batches re-cut to the job's
batch size; time and memory are measured per batch and divided by the
batch size, as the summary jobs did.
"""

from __future__ import annotations

import re
import resource
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import fill_template
from parley.schemas import (GENERATION_BATCH, SENTIMENT_PROMPT, SENTIMENT_PROMPTS, SUMMARY_PROMPTS,
                            TEACHER_MAX_WORDS)

# Teacher labelling prompt (fixed value).
TEACHER_PROMPT = "Classify the sentiment of this dialogue as positive, negative, or neutral: {}"

_WS = re.compile(r"[ \t\n\r\f]+")


def prompts_table(spark) -> DataFrame:
    """Registry of summary prompts: (model_id, template, max_new_tokens,
    parse_variant). Fixed size (one row per model)."""
    rows = [(m, t, n, v) for m, (t, n, v) in SUMMARY_PROMPTS.items()]
    return spark.createDataFrame(rows, "model_id string, template string, max_new_tokens int, parse_variant string")


def render_prompt(df: DataFrame, text: str = "dialogue_text", template: str | None = None,
                  prompts: DataFrame | None = None, out: str = "prompt") -> DataFrame:
    """I-3: one prompt per row. Either one template for all rows, or the
    per-model template: a literal map of the fixed registry (no join), or a
    join with the ``prompts`` given."""
    if template is not None:
        return df.withColumn(out, fill_template(template, text))
    if prompts is None:
        entry = F.create_map(*[x for m, (t, _, v) in SUMMARY_PROMPTS.items()
                               for x in (F.lit(m), F.struct(F.lit(t).alias("template"), F.lit(v).alias("parse_variant")))])
        j = (df.where(F.col("model_id").isin(*SUMMARY_PROMPTS)).withColumn("_p", F.element_at(entry, F.col("model_id")))
             .select(*df.columns, "_p.template", "_p.parse_variant"))
    else:
        j = df.join(prompts.select("model_id", "template", "parse_variant"), "model_id")
    return j.withColumn(out, fill_template(F.col("template"), text)).drop("template")


def _peak_mb() -> float:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024.0


def generate(df: DataFrame, generator, prompt: str = "prompt", out: str = "output",
             batch_size: int = GENERATION_BATCH, repartition: int | None = None,
             key: str | None = None) -> DataFrame:
    """I-4: add ``out``, ``time_taken`` and ``memory_usage`` per row.

    ``repartition`` spreads long texts by a hash of ``key`` (not by length
    range) so no task gets all the long dialogues.
    """
    if repartition:
        df = df.repartition(repartition, key) if key else df.repartition(repartition)
    schema = T.StructType(df.schema.fields + [
        T.StructField(out, T.StringType()), T.StructField("time_taken", T.DoubleType()),
        T.StructField("memory_usage", T.DoubleType())])

    def run(batches):
        if hasattr(generator, "load"):
            generator.load()
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size].copy()
                before = _peak_mb()
                t0 = time.perf_counter()
                outs = generator(list(part[prompt]))
                dt = time.perf_counter() - t0
                n = len(part)
                part[out] = list(outs)
                part["time_taken"] = dt / n
                part["memory_usage"] = max(_peak_mb() - before, 0.0) / n
                yield part

    return df.mapInPandas(run, schema)


# -- deterministic stand-ins for a model (for tests and reproducible runs) ----

class LeadWords:
    """Echoes the prompt, then the words after its first line (the dialogue
    part of a summary prompt): all, or the first ``n``."""

    deterministic = True

    def __init__(self, n: int | None = None):
        self.n = n

    def __call__(self, prompts: list[str]) -> list[str]:
        outs = []
        for p in prompts:
            body = p.split("\n", 1)[1] if "\n" in p else p
            ws = [w for w in _WS.split(body) if w]
            outs.append(p + " " + " ".join(ws[: self.n]))
        return outs


class LengthTeacher:
    """Label word chosen by the prompt length (negative/neutral/positive)."""

    deterministic = True
    labels = ("negative", "neutral", "positive")

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.labels[len(p) % 3] for p in prompts]


def summarise_long(dialogues: DataFrame, generator, model_id: str,
                   max_length: int = 1024, batch_size: int = GENERATION_BATCH) -> DataFrame:
    """I-9: chunk -> prompt -> generate -> parse -> re-join per dialogue."""
    from parley.functions.parse import extract_summary
    from parley.operators.chunking import reassemble, split_dialogue
    template, _, variant = SUMMARY_PROMPTS[model_id]
    ch = split_dialogue(dialogues, max_length=max_length)
    pr = render_prompt(ch, text="chunk_text", template=template)
    g = generate(pr, generator, batch_size=batch_size)
    parsed = g.select("dialogue_id", "chunk_no", extract_summary("output", variant).alias("summary"),
                      "time_taken", "memory_usage")
    return reassemble(parsed, ["dialogue_id"]).withColumn("model_id", F.lit(model_id))


def teacher_label(dialogues: DataFrame, generator, max_words: int = TEACHER_MAX_WORDS) -> DataFrame:
    """I-5: dialogues under the word limit are labelled by a teacher model;
    the raw output (variant v4) becomes the label; a label outside the
    domain is left for the constraint check."""
    from parley.functions.text import word_count
    fit = dialogues.where(word_count("dialogue_text") < max_words)
    pr = render_prompt(fit, template=TEACHER_PROMPT)
    g = generate(pr, generator)
    return g.select("dialogue_id", F.col("output").alias("actual_sentiment"))


def run_cost(df: DataFrame, run: str = "model_id", order: str = "dialogue_id") -> DataFrame:
    """I-10: per-row deltas of load / memory readings, then per run the
    first and last reading (by ``order``) and the elapsed total."""
    rows = df.withColumns({
        "load_delta": F.col("load_after") - F.col("load_before"),
        "mem_delta": F.col("mem_after") - F.col("mem_before")})
    return rows.groupBy(run).agg(
        F.min_by("mem_before", order).alias("first_mem_before"),
        F.max_by("mem_after", order).alias("last_mem_after"),
        F.min_by("load_before", order).alias("first_load_before"),
        F.max_by("load_after", order).alias("last_load_after"),
        F.sum("time_taken").alias("elapsed"),
        F.sum("mem_delta").alias("mem_delta_total"),
        F.avg("load_delta").alias("load_delta_mean"))


def sentiment_prompts(df: DataFrame, text: str = "dialogue_text", out: str = "prompt") -> DataFrame:
    """One sentiment prompt per row, by the template of its ``model_id``:
    a literal map of the models that have their own, else the common one."""
    own = F.create_map(*[F.lit(x) for pair in SENTIMENT_PROMPTS.items() for x in pair])
    return df.withColumn(out, fill_template(F.coalesce(F.element_at(own, F.col("model_id")), F.lit(SENTIMENT_PROMPT)), text))
