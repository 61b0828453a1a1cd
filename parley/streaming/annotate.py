"""K-1: annotate arriving dialogues with {sentiment, summary}.

The request handler of the service becomes a Structured Streaming query:

    readStream (file source) -> dedupe by dialogue_id within a watermark
    -> prompts + chunk array per row -> mapInPandas (model calls, batched)
    -> native parsing -> foreachBatch sink (idempotent per batch id)

``annotate_requests`` is the same between JSON bodies: requests are parsed
first, the model's replies are JSON too, and each request gets one response
body. A request or reply that cannot be used gives an error, never a lost
row or a failed job.

Chunks of a long dialogue stay inside the row (an array), so re-joining
the chunk summaries needs no streaming aggregation; the only state is the
dedupe key set, bounded by the watermark.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.chunk import chunk_array
from parley.functions.parse import extract_summary, extract_sentiment
from parley.functions.payload import reply_text, request_text
from parley.functions.text import fill_template
from parley.schemas import GENERATION_BATCH, MAX_DIALOGUE_CHARS, SENTIMENT_PROMPT

_WS = re.compile(r"[ \t\n\r\f]+")


class ServiceEcho:
    """Deterministic stand-in for the hosted model: a sentiment prompt gets
    ``Sentiment: <len(prompt) % 3 - 1>`` after the echoed prompt; any other
    input gets ``Summarization:`` + blank line + its words."""

    deterministic = True

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            if p.endswith("Sentiment:"):
                out.append(f"{p} {len(p) % 3 - 1}")
            else:
                ws = [w for w in _WS.split(p) if w]
                out.append("Summarization:\n\n" + " ".join(ws))
        return out


class JsonEcho:
    """``ServiceEcho`` as the hosted model answers: JSON arrays. To stand for
    a service that fails at times, sentiment prompts of some lengths get a
    cut, empty or incomplete reply."""

    deterministic = True

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p, text in zip(prompts, ServiceEcho()(prompts)):
            reply = json.dumps([{"generated_text": text}])
            fault = len(p) % 7 if p.endswith("Sentiment:") else 6
            out.append({0: reply[:-3], 1: "[]", 2: '[{"score": 1}]'}.get(fault, reply))
        return out


def _answers(generator, pdf: pd.DataFrame) -> tuple[list[str], list[list[str]]]:
    """Outputs for the prompts and for the chunks of each row, asked in batches."""
    prompts = list(pdf["sentiment_prompt"])
    chunks = [list(c) for c in pdf["chunks"]]
    ask = prompts + [c for cs in chunks for c in cs]
    outs = [o for s in range(0, len(ask), GENERATION_BATCH) for o in generator(ask[s:s + GENERATION_BATCH])]
    sent, rest = outs[: len(prompts)], outs[len(prompts):]
    grouped, i = [], 0
    for cs in chunks:
        grouped.append(rest[i:i + len(cs)])
        i += len(cs)
    return sent, grouped


def _generate_rows(generator):
    def run(batches):
        if hasattr(generator, "load"):
            generator.load()
        for pdf in batches:
            sent, grouped = _answers(generator, pdf)
            yield pd.DataFrame({"dialogue_id": pdf["dialogue_id"], "sentiment_output": sent,
                                "chunk_outputs": grouped})
    return run


_OUT = T.StructType([T.StructField("dialogue_id", T.LongType()),
                     T.StructField("sentiment_output", T.StringType()),
                     T.StructField("chunk_outputs", T.ArrayType(T.StringType()))])


def annotate(df: DataFrame, generator, text: str = "dialogue_text", key: str = "dialogue_id",
             max_length: int = MAX_DIALOGUE_CHARS, distinct_parts: bool = False) -> DataFrame:
    """Batch or streaming: (key, sentiment, summary) per dialogue."""
    prep = df.select(F.col(key).cast("long").alias("dialogue_id"),
                     fill_template(SENTIMENT_PROMPT, text).alias("sentiment_prompt"),
                     chunk_array(text, max_length).alias("chunks"))
    gen = prep.mapInPandas(_generate_rows(generator), _OUT)
    return gen.select(F.col("dialogue_id").alias(key),
                      extract_sentiment("sentiment_output", "v2").alias("sentiment"),
                      _summary(F.col("chunk_outputs"), distinct_parts).alias("summary"))


def _summary(outputs: Column, distinct_parts: bool = False) -> Column:
    parts = F.transform(outputs, lambda o: extract_summary(o, "service"))
    return F.array_join(F.array_distinct(parts) if distinct_parts else parts, "\n")


def annotate_requests(df: DataFrame, generator, body: str = "body", key: str = "dialogue_id",
                      max_length: int = MAX_DIALOGUE_CHARS) -> DataFrame:
    """Batch or streaming: (key, sentiment, summary, error, response) per
    request body; ``generator`` answers with JSON bodies.

    ``error`` is ``request: <reason>`` (no model call is made; the generator
    gets no row of it), ``sentiment: <reason>`` or ``summary: <reason>`` (the
    first chunk's reply that cannot be used), else NULL. What could be had is
    kept: a summary stands beside a failed sentiment. ``response`` is the
    JSON answer, with the fields that there are."""
    asked = df.select(F.col(key).cast("long").alias("dialogue_id"), request_text(body).alias("q"))
    prep = asked.select("dialogue_id", F.col("q.error").alias("request_error"),
                        fill_template(SENTIMENT_PROMPT, F.col("q.text")).alias("sentiment_prompt"),
                        chunk_array(F.col("q.text"), max_length).alias("chunks"))

    def answer(batches):
        if hasattr(generator, "load"):
            generator.load()
        for pdf in batches:
            good = pdf["request_error"].isna()
            sent, grouped = (iter(x) for x in _answers(generator, pdf[good]))
            yield pd.DataFrame({"dialogue_id": pdf["dialogue_id"], "request_error": pdf["request_error"],
                                "sentiment_output": [next(sent) if g else None for g in good],
                                "chunk_outputs": [next(grouped) if g else None for g in good]})

    schema = T.StructType([_OUT[0], T.StructField("request_error", T.StringType()), *_OUT.fields[1:]])
    gen = prep.mapInPandas(answer, schema)
    gen = gen.withColumns({"s": reply_text("sentiment_output"), "c": F.transform("chunk_outputs", reply_text)})
    bad = F.get(F.filter(F.transform("c", lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0))
    reason = lambda part, e: F.when(e.isNotNull(), F.concat(F.lit(f"{part}: "), e))
    sentiment = F.when(F.col("s.error").isNull() & F.col("request_error").isNull(), extract_sentiment(F.col("s.text"), "v2"))
    summary = F.when(bad.isNull() & F.col("request_error").isNull(), _summary(F.transform("c", lambda x: x["text"])))
    error = F.when(F.col("request_error").isNotNull(), reason("request", F.col("request_error"))) \
        .otherwise(F.coalesce(reason("sentiment", F.col("s.error")), reason("summary", bad)))
    out = gen.select(F.col("dialogue_id").alias(key), sentiment.alias("sentiment"), summary.alias("summary"), error.alias("error"))
    return out.withColumn("response", F.to_json(F.struct("sentiment", "summary", "error")))


def annotate_stream(stream: DataFrame, generator, out_path: str, checkpoint: str,
                    text: str = "dialogue_text", key: str = "dialogue_id",
                    watermark: str = "1 hour", available_now: bool = True, json_bodies: bool = False):
    """Start the streaming annotation; returns the ``StreamingQuery``.
    ``json_bodies``: ``text`` holds request bodies (``annotate_requests``).

    Each micro-batch is written to ``out_path/batch_id=<n>`` with overwrite,
    so a batch replayed after a failure replaces its own output
    (exactly-once files with the checkpointed offsets).
    """
    arrived = stream.withColumn("arrival_ts", F.current_timestamp()) \
                    .withWatermark("arrival_ts", watermark) \
                    .dropDuplicatesWithinWatermark([key])
    ann = annotate_requests(arrived, generator, body=text, key=key) if json_bodies else \
        annotate(arrived, generator, text=text, key=key)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = ann.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
