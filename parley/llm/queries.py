"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (langid, merkle, mixing, ngram_join, packing, pii, ring, runs, spotsigs, suffix_dedup, token_rollup, topk,
                        warc)
from parley.llm.registry import ORACLES, QUERIES, query
from parley.session import fresh_path, read_table

#: Path of the token vocabulary; None: that of the installed package.
TOKENIZER: str | None = None


def tokenizer() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_topk", oracle="""
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op2_spotsigs")
def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(read_table(spark, sf_dir, "documents"))


@query("op3_pack")
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer(), with_ids=False).drop("ids")


@query("op4_mix")
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


_WARC = """
WITH base AS (
  SELECT page_id AS p, url, md5(coalesce(html, '')) AS digest,
         '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' AS tag,
         'day-' || (page_id % 97) AS d, (page_id * 7919) % 100003 * 1000 AS t0
  FROM pages),
recs AS (
  SELECT p * 3 AS record_id, url, t0 AS ts, 200 AS status, tag AS etag, d AS last_modified, digest,
         'max-age=' || (p % 13) AS cc, 's' || (p % 13) AS server, tag AS htag, 'text/html' AS ct FROM base
  UNION ALL
  SELECT p * 3 + 1, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x#top',
         t0 + CASE WHEN p % 11 = 0 THEN -500 ELSE 500 END, 304,
         CASE WHEN p % 5 = 0 THEN NULL WHEN p % 7 = 0 THEN '"changed"' ELSE 'W/' || tag END,
         CASE WHEN p % 10 = 0 THEN NULL WHEN p % 15 = 0 THEN 'day-x' ELSE d END, NULL,
         'max-age=' || (p % 17), NULL,
         CASE WHEN p % 5 = 0 THEN '-' WHEN p % 7 = 0 THEN '"changed"' ELSE 'W/' || tag END, NULL FROM base
  UNION ALL
  SELECT p * 3 + 2, upper(regexp_extract(url, '^[a-z]+://[^/]*', 0)), t0 + 700, 304, tag, NULL, NULL,
         'max-age=' || (p % 19), NULL, tag, NULL FROM base),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS s FROM recs),
k AS (
  SELECT *, regexp_replace(lower(regexp_extract(s, '^[^:/?]+://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', '') AS host,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(s, '\\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|gclid|fbclid|sessionid|utm_[a-z]+)(=|$)'))), '&') AS q
  FROM u),
c AS (
  SELECT *, CASE WHEN host <> '' THEN lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || host
    || regexp_replace(regexp_extract(s, '^[^:/?]+://[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url_key FROM k),
j AS (
  SELECT a.*, b.record_id AS r_id, b.etag AS r_etag, b.last_modified AS r_mod, b.digest AS r_digest, b.server AS r_server,
         b.ct AS r_ct,
         row_number() OVER (PARTITION BY a.record_id ORDER BY b.ts DESC, b.record_id DESC) AS n
  FROM c a LEFT JOIN c b ON b.status <> 304 AND b.url_key = a.url_key AND b.ts < a.ts WHERE a.status = 304),
o AS (
  SELECT *, CASE WHEN r_id IS NULL THEN 'no_earlier'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', '')
      THEN 'resolved' ELSE 'etag_mismatch' END
    WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = r_mod THEN 'resolved' ELSE 'modified_mismatch' END
    ELSE 'no_validator' END AS outcome FROM j WHERE n = 1)
SELECT record_id, url_key, ts, outcome,
       CASE WHEN outcome = 'resolved' THEN r_id END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN r_digest END AS payload_digest,
       CASE WHEN outcome = 'resolved' THEN 'cache-control=' || cc || ';content-type=' || r_ct || ';etag=' || htag
         || ';server=' || r_server END AS headers
FROM o
"""


@query("op5_warc_revisits", oracle=_WARC)
def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve(warc.captures(read_table(spark, sf_dir, "pages")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("headers")),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return got.withColumn("headers", flat)


@query("op6_ngram_join")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read_table(spark, sf_dir, "documents"), 4, 85).drop("set_name")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page; the model is fitted on documents
    with a language."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit_text_model(docs)
    rows = (langid.from_documents(docs).withColumn("kind", F.lit("document"))
            .unionByName(langid.from_pages(read_table(spark, sf_dir, "pages")).withColumn("kind", F.lit("page"))))
    got = langid.identify(rows, model, ("kind",))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("row_id"))
    return got.select(of("document").alias("doc_id"), of("page").alias("page_id"), "lang",
                      F.round("posterior", 4).alias("posterior"), "text_lang", "rejected")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), 50, with_text=False)


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count base spans; ``n_added`` those of the method."""
    got = pii.spans(read_table(spark, sf_dir, "documents"))
    kinds = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.substring_index(x, ":", 1))
    got = got.withColumn("k", kinds)
    n = lambda kind: F.size(F.filter("k", lambda x: x == kind)).cast("long").alias(f"n_{kind}")
    every = F.size(F.filter(F.split("spans", ","), lambda x: x != ""))
    return got.select("doc_id", *[n(k) for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans",
                      (every - F.size("k")).cast("long").alias("n_added"))


_ROLLUP = """
WITH c AS (
  SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words,
         (coalesce(octet_length(encode(text)), 0) + 3) // 4 AS quads FROM documents),
t AS (SELECT doc_id, source, lang, 'words-1' AS tokenizer, words AS tokens FROM c
      UNION ALL SELECT doc_id, source, lang, 'quads-1', quads FROM c)
SELECT source, lang, tokenizer,
       count(*) FILTER (WHERE doc_id % 7 <> 3)::BIGINT AS docs,
       coalesce(sum(CASE WHEN doc_id % 5 = 1 THEN tokens + 2 ELSE tokens END) FILTER (WHERE doc_id % 7 <> 3), 0)::BIGINT AS tokens
FROM t GROUP BY ALL
"""


@query("op10_token_rollup", oracle=_ROLLUP)
def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two token versions of every document, loaded in two
    batches, then revised (a fifth of the documents gains two tokens) and
    partly deleted (a seventh). A batch is committed again after the next,
    and the first two are compacted: totals do not change."""
    text = F.col("text")
    words = F.coalesce(F.regexp_count(text, F.lit(mixing.WORD)), F.lit(0)).cast("long")
    quads = F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")
    version = F.inline(F.array(F.struct(F.lit("words-1").alias("tokenizer"), words.alias("tokens")),
                               F.struct(F.lit("quads-1").alias("tokenizer"), quads.alias("tokens"))))
    path = fresh_path(spark, "counts")
    read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", version).write.parquet(path)
    counts = spark.read.parquet(path)
    no = F.lit(None).cast("long")
    change = lambda op, rows, old, new: rows.select(*token_rollup.KEYS, F.lit(op).alias("op"),
                                                    old.alias("old_tokens"), new.alias("new_tokens"))
    n = F.col("tokens")
    half = lambda k: change("insert", counts.where(F.pmod("doc_id", F.lit(2)) == k), no, n)
    revised = F.pmod("doc_id", F.lit(5)) == 1
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    rollup.commit("load-0", half(0))
    rollup.commit("load-1", half(1))
    rollup.commit("load-0", half(0))                    # replayed
    rollup.compact()
    rollup.commit("load-1", half(1))                    # replayed after folding
    rollup.commit("revise", change("revise", counts.where(revised), n, n + 2))
    now = F.when(revised, n + 2).otherwise(n)
    gone = change("delete", counts.where(F.pmod("doc_id", F.lit(7)) == 3), now, no)
    rollup.commit("delete", gone)
    rollup.commit("delete", gone)                       # replayed
    return rollup.totals()


@query("op11_ring_shards")
def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards whose row counts are at most one apart (law ``rows``)."""
    got = ring.assign(read_table(spark, sf_dir, "documents"), 40)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read_table(spark, sf_dir, "documents"))


_MERKLE = """
WITH RECURSIVE
v AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, text,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS known,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
u AS (
  SELECT doc_id, s, crc, array_to_string(list_transform(known, lambda x:
           CASE WHEN x IS NULL THEN '-' ELSE octet_length(encode(x)) || ':' || x END), '') AS head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
         coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-') AS less FROM v),
d AS (
  SELECT doc_id, s, sha256(head || body) AS leaf, CASE WHEN crc % 2 = 0 THEN sha256(head || less) ELSE sha256(head || body) END
    AS claimed FROM u),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY s) AS n, row_number() OVER () AS rid FROM d),
nodes AS (
  SELECT s, 0 AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT s, lvl + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY s, lvl, idx // 3),
subroots AS (SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, idx, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 3),
every AS (SELECT s, lvl, idx, n, h FROM nodes UNION ALL SELECT 'top', lvl, idx, n, h FROM tops),
sib AS (
  SELECT a.s, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM every a JOIN every b ON a.s = b.s AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1
  GROUP BY a.s, a.lvl, a.idx),
up AS (
  SELECT rid, s, 0 AS lvl, idx, claimed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT rid, s, lvl + 1, idx // 3, sha256(l || h || r), proof || l || r FROM up JOIN sib USING (s, lvl, idx)),
mid AS (SELECT rid, s, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM up GROUP BY rid, s),
over AS (
  SELECT m.rid, 'top' AS s, 0 AS lvl, t.idx, m.h, m.proof FROM mid m JOIN subroots t ON m.s = t.s
  UNION ALL
  SELECT rid, s, lvl + 1, idx // 3, sha256(l || h || r), proof || l || r FROM over JOIN sib USING (s, lvl, idx)),
fin AS (SELECT rid, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM over GROUP BY rid)
SELECT a.doc_id, a.leaf, t.h AS subroot, o.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM leaves a JOIN subroots t ON a.s = t.s JOIN fin f ON a.rid = f.rid JOIN (SELECT h FROM tops WHERE n = 1) o ON true
"""


@query("op13_merkle_manifest", oracle=_MERKLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = merkle.verified(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


__all__ = ["ORACLES", "QUERIES"]
