"""Queries: the service path (K-1), on a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.plans.oracle_views import _view, with_views, words
from parley.plans.registry import query
from parley.schemas import SENTIMENT_PROMPT
from parley.session import fresh_path, read_table
from parley.functions.payload import reply_text, request_text
from parley.streaming.annotate import JsonEcho, ServiceEcho, annotate, annotate_requests, annotate_stream

_ORACLE = with_views(f"""
SELECT c.dialogue_id,
       CASE ((length(d.dialogue_text) + {len(SENTIMENT_PROMPT) - 2}) % 3) - 1
            WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' ELSE 'positive' END AS sentiment,
       c.summary
FROM (SELECT dialogue_id, string_agg(array_to_string({words('chunk_text')}, ' '), chr(10) ORDER BY chunk_no)
               AS summary
      FROM chunks GROUP BY dialogue_id) c
JOIN dialogues d ON c.dialogue_id = d.dialogue_id""", "chunks", "dialogues")


@query("k1_annotate_stream", _ORACLE)
def q_annotate_stream(spark, sf):
    """Documents arrive through a file stream (available-now trigger),
    are deduplicated on id within a watermark, annotated, and written
    per micro-batch; the written table is the result."""
    schema = read_table(spark, sf, "documents").schema
    stream = (spark.readStream.schema(schema)            # the table is one file or a folder of files
              .option("maxFilesPerTrigger", 1).parquet(f"{sf}/documents[.]parquet"))
    out, ckpt = fresh_path(spark, "annotated"), fresh_path(spark, "annotate-ckpt")
    q = annotate_stream(stream, ServiceEcho(), out, ckpt, text="text", key="doc_id")
    q.awaitTermination()
    res = spark.read.parquet(out)
    return res.select(F.col("doc_id").alias("dialogue_id"), "sentiment", "summary")


@query("k1_annotate_batch", _ORACLE)
def q_annotate_batch(spark, sf):
    """The same operator on a batch frame (stream result = batch result)."""
    from parley.sources import fixtures as X
    d = X.dialogues(spark, sf).select("dialogue_id", "dialogue_text")
    return annotate(d, ServiceEcho())


# -- JSON bodies -------------------------------------------------------------------------

def request_bodies(docs):
    """A request body per document: whole ones, with other fields, cut off,
    empty, NULL, without the field, with a null field, an array, two values."""
    one = F.to_json(F.struct(F.col("text").alias("response")))
    kind = F.pmod("doc_id", F.lit(20))
    body = (F.when(kind == 0, F.left(one, F.length(one) - 2)).when(kind == 1, F.lit("  ")).when(kind == 2, F.lit(None).cast("string"))
            .when(kind == 3, F.to_json(F.struct("text"))).when(kind == 4, F.lit('{"response": null}'))
            .when(kind == 5, F.concat(F.lit("["), one, F.lit("]"))).when(kind == 6, F.concat(one, F.lit(", "), one))
            .when(kind == 7, F.to_json(F.struct("lang", F.struct("n_chars").alias("meta"), F.col("text").alias("response"))))
            .when(kind == 8, F.to_json(F.struct(F.col("n_chars").alias("response")))).otherwise(one))
    return docs.select(F.col("doc_id").alias("dialogue_id"), body.alias("body"))


_view("requests", (), """
SELECT doc_id AS dialogue_id,
       CASE WHEN doc_id % 20 = 8 THEN n_chars::VARCHAR WHEN doc_id % 20 >= 7 THEN text END AS text,
       CASE doc_id % 20 WHEN 0 THEN 'malformed' WHEN 1 THEN 'empty' WHEN 2 THEN 'empty' WHEN 3 THEN 'missing_field'
         WHEN 4 THEN 'missing_field' WHEN 5 THEN 'wrong_type' WHEN 6 THEN 'malformed' END AS error
FROM documents""")


@query("h10_request_fields", with_views("SELECT * FROM requests", "requests"))
def q_request_fields(spark, sf):
    """The dialogue of each JSON request, or why there is none."""
    got = request_bodies(read_table(spark, sf, "documents")).select("dialogue_id", request_text("body").alias("q"))
    return got.select("dialogue_id", "q.text", "q.error")


@query("h10_reply_fields", """
SELECT doc_id AS dialogue_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '' END AS text,
       CASE doc_id % 6 WHEN 3 THEN 'no_reply' WHEN 4 THEN 'missing_field' WHEN 5 THEN 'wrong_type' END AS error
FROM documents""")
def q_reply_fields(spark, sf):
    """The generated text of each JSON reply, or why there is none: whole
    ones, two elements, an empty text, no element, no field, an object."""
    item = F.struct(F.col("text").alias("generated_text"))
    kind = F.pmod("doc_id", F.lit(6))
    body = (F.when(kind == 0, F.to_json(F.array(item)))
            .when(kind == 1, F.to_json(F.array(item, F.struct(F.lit("other").alias("generated_text")))))
            .when(kind == 2, F.lit('[{"generated_text": ""}]')).when(kind == 3, F.lit("[]"))
            .when(kind == 4, F.to_json(F.array(F.struct("text")))).otherwise(F.to_json(item)))
    got = read_table(spark, sf, "documents").select(F.col("doc_id").alias("dialogue_id"), reply_text(body).alias("r"))
    return got.select("dialogue_id", "r.text", "r.error")


# A dialogue sent as a number is that number's digits: one chunk of itself.
_PROMPT = f"(length(r.text) + {len(SENTIMENT_PROMPT) - 2})"
_REQUESTS = with_views(f"""
SELECT r.dialogue_id,
       CASE WHEN r.error IS NULL AND {_PROMPT} % 7 > 2 THEN
         CASE ({_PROMPT} % 3) - 1 WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' ELSE 'positive' END END AS sentiment,
       CASE WHEN r.dialogue_id % 20 = 8 THEN r.text WHEN r.error IS NULL THEN c.summary END AS summary,
       CASE WHEN r.error IS NOT NULL THEN 'request: ' || r.error
            ELSE CASE {_PROMPT} % 7 WHEN 0 THEN 'sentiment: malformed' WHEN 1 THEN 'sentiment: no_reply'
                   WHEN 2 THEN 'sentiment: missing_field' END END AS error
FROM requests r JOIN (
  SELECT dialogue_id, string_agg(array_to_string({words('chunk_text')}, ' '), chr(10) ORDER BY chunk_no) AS summary
  FROM chunks GROUP BY dialogue_id) c ON r.dialogue_id = c.dialogue_id""", "chunks", "requests")


@query("k1_requests_batch", _REQUESTS)
def q_requests_batch(spark, sf):
    """JSON requests in, a response for every one."""
    got = annotate_requests(request_bodies(read_table(spark, sf, "documents")), JsonEcho())
    return got.drop("response")


@query("k1_requests_stream", _REQUESTS)
def q_requests_stream(spark, sf):
    """The same on a file stream of request bodies."""
    bodies, out, ckpt = (fresh_path(spark, x) for x in ("requests", "answered", "answered-ckpt"))
    request_bodies(read_table(spark, sf, "documents")).write.parquet(bodies)
    stream = spark.readStream.schema("dialogue_id long, body string").option("maxFilesPerTrigger", 4).parquet(bodies)
    annotate_stream(stream, JsonEcho(), out, ckpt, text="body", json_bodies=True).awaitTermination()
    return spark.read.parquet(out).select("dialogue_id", "sentiment", "summary", "error")
