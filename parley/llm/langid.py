"""Language identification by Bayesian fusion of evidence.

For each text, log P(text | language) comes from a naive Bayes model on
byte trigrams. To it are added log P(declared language | language),
log P(address suffix | language) and a prior of the host, smoothed to its
registered domain and that to the whole corpus. These three are counted
over all rows by grouped aggregation of the text model's verdicts (partial
sums map-side; a hot host is one row of the result). A row's own verdict
is taken out of its host's counts. A class ``und`` with an even trigram
distribution stands for what is no known language.

Texts are read once, by a pass that writes a row of likelihoods per text;
joins then carry ids and small arrays only.

Edge cases: null, empty and letterless texts get language ``und`` and are
rejected, one or two letters are judged by the prior; a null host, suffix or declaration adds no evidence; repeated
rows are judged each; ties go to the first language in sorted order; an
empty table gives no rows; with no labelled row every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.session import stored

#: Labelled rows the text model is fitted on, in order of a hash of the id.
FIT_ROWS = 4000
FEATURES = 1 << 15
#: Bytes of text scored at once: a trigram takes some hundred bytes meanwhile.
PIECE_BYTES = 1 << 18
#: Trigrams of one text count as at most so many independent ones.
EFFECTIVE = 60.0
SMOOTH_HOST = 20.0
SMOOTH_DOMAIN = 50.0
SMOOTH_EVIDENCE = 5.0
UND = "und"
UND_PRIOR = 0.01
ACCEPT = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
#: Letters, and one sign for everything else.
_CLASS = np.where(_LETTER, tv.LOWER, 32).astype(np.uint32)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every byte trigram that lies in one row and
    begins with a letter."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _CLASS[data]
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    f = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    at = np.flatnonzero(c[:-2] != 32)
    row = np.searchsorted(off, at, "right") - 1
    inside = at + 2 < off[row + 1]
    return f[at[inside]].astype(np.int64), row[inside]


class TextModel:
    """log P(trigram | language) for sorted ``langs``, ``und`` last."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @classmethod
    def fit(cls, texts: list[str] | pa.ChunkedArray, labels: list[str]) -> TextModel:
        langs = sorted(set(labels) - {UND})
        counts = np.full((len(langs) + 1, FEATURES), 0.5)
        col = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        for i, lang in enumerate(langs):
            for _, _, data, off in tv.pieces(col.filter(pa.array([x == lang for x in labels], pa.bool_())), PIECE_BYTES):
                counts[i] += np.bincount(trigrams(data, off)[0], minlength=FEATURES)
        counts[-1] = 1.0
        return cls([*langs, UND], np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32).copy())

    def log_likelihood(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows x languages, trigrams of each row, letters of each row)."""
        out = np.zeros((len(col), len(self.langs)))
        n = np.zeros(len(col), np.int64)
        letters = np.zeros(len(col), np.int64)
        for lo, hi, data, off in tv.pieces(col, PIECE_BYTES):
            sums = np.r_[0, np.cumsum(_LETTER[data])]
            letters[lo:hi] = sums[off[1:]] - sums[off[:-1]]
            f, row = trigrams(data, off)
            if not len(f):
                continue
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rows = lo + row[first]
            out[rows] = np.add.reduceat(self.table[f], first, axis=0, dtype=np.float64)
            n[rows] = np.diff(np.r_[first, len(f)])
        return out * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None], n, letters


def fit_text_model(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> TextModel:
    """Fit on at most FIT_ROWS labelled rows: ids are chosen first (two
    numbers a row), then only their texts are read. The last id chosen
    tells the others, so the plan holds no list of them."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    at, own = F.xxhash64(id_col), F.col(id_col)
    last = rows.select(at.alias("at"), own.alias("id")).orderBy("at", "id").limit(FIT_ROWS).collect()[-1:]
    if not last:
        return TextModel.fit([], [])
    chosen = at < F.lit(last[0]["at"])
    if last[0]["id"] is not None:           # null ids come first and are not chosen
        chosen = chosen | ((at == F.lit(last[0]["at"])) & (own <= F.lit(last[0]["id"])))
    got = rows.where(own.isNotNull() & chosen).select(text, lang).limit(2 * FIT_ROWS).toArrow()
    model = TextModel.fit(got.column(0), got.column(1).to_pylist())
    del got
    tv.release()
    return model


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    t = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.regexp_replace(t, "<[^>]*>|&[A-Za-z]+;|&#[0-9]+;", " ")


def declared_language(html: Column) -> Column:
    """Language of the root element, two letters; null without one."""
    d = F.lower(F.regexp_extract(html, "(?i)<html[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2})", 1))
    return F.when(d != "", d)


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (last two labels) and suffix (last label)."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return host, F.regexp_extract(host, "([^.]+\\.[^.]+)$", 0), F.regexp_extract(host, "([^.]+)$", 0)


def identify(rows: DataFrame, model: TextModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows (row_id, text, host, domain, suffix, declared, kept columns)
    -> row_id, kept columns, lang, posterior, text_lang, trigrams,
    rejected."""
    langs, k = model.langs, len(model.langs)
    cols = ["row_id", "host", "domain", "suffix", "declared", *keep]

    def score(batches):
        for b in batches:
            ll, n, letters = model.log_likelihood(b.column(b.num_columns - 1))
            best = ll.argmax(1)
            best[n == 0] = k - 1
            arrays = [b.column(i) for i in range(b.num_columns - 1)]
            arrays += [pa.array(ll.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(letters, pa.int64()),
                       pa.array([langs[i] for i in best], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*cols, "ll", "trigrams", "letters", "text_lang"])

    chosen = rows.select(*cols, F.col("text").cast("string").alias("text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    got = stored(chosen.mapInArrow(tv.tidy(score), f"{ddl}, ll array<double>, trigrams long, letters long, text_lang string"),
                 "likelihoods")

    def counts(*by: str) -> DataFrame:
        """n_<lang> for each value of ``by``: verdicts of rows with text."""
        return got.where("trigrams > 0").groupBy(*by).agg(F.array(*[
            F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)) for x in langs]).alias("n"))

    total = counts().first()["n"]
    total = [x or 0.0 for x in total]
    world = [(x + 1.0) / (sum(total) + k) for x in total]
    world[-1] = min(world[-1], UND_PRIOR)
    base = F.array(*[F.lit(x / sum(world)) for x in world])

    def smoothed(n: Column, below: Column, strength: float) -> Column:
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, below, lambda x, p: (x + strength * p) / (size + strength))

    zero = F.array(*[F.lit(0.0)] * k)
    own = F.array(*[F.when((F.col("trigrams") > 0) & (F.col("text_lang") == x), 1.0).otherwise(0.0) for x in langs])
    less = lambda c: F.zip_with(F.coalesce(c, zero), F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def evidence(col: str) -> DataFrame:
        """log P(value | language), smoothed over values by its share."""
        t = counts(col).where(F.col(col).isNotNull())
        logs = F.array(*[F.log((F.col("n")[i] + SMOOTH_EVIDENCE * F.lit(0.05)) / F.lit(total[i] + SMOOTH_EVIDENCE))
                         for i in range(k)])
        return t.select(F.col(col), logs.alias(f"e_{col}"))

    def with_table(x: DataFrame, table: DataFrame, col: str) -> DataFrame:
        """Left join on ``col``; rows without a value are spread evenly."""
        spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("row_id", "ll"), F.lit(1024)).cast("string"))
        table = table.where(F.col(col).isNotNull()).withColumnRenamed(col, "at")
        return x.withColumn("at", F.coalesce(col, spread)).join(table, "at", "left").drop("at")

    x = got.withColumn("own", own)
    x = with_table(x, counts("host").withColumnRenamed("n", "n_host"), "host")
    x = with_table(x, counts("domain").withColumnRenamed("n", "n_domain"), "domain")
    x = with_table(with_table(x, evidence("declared"), "declared"), evidence("suffix"), "suffix")
    of_domain = F.when(F.col("n_domain").isNotNull(), smoothed(less(F.col("n_domain")), base, SMOOTH_DOMAIN)).otherwise(base)
    x = x.withColumn("p_domain", of_domain)
    x = x.withColumn("p_host", F.when(F.col("n_host").isNotNull(),
                                      smoothed(less(F.col("n_host")), F.col("p_domain"), SMOOTH_HOST))
                     .otherwise(F.col("p_domain")))
    log_post = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("ll", i) + F.log(
        F.greatest(F.get("p_host", i), F.lit(1e-9))) + F.coalesce(F.get("e_declared", i), F.lit(0.0))
        + F.coalesce(F.get("e_suffix", i), F.lit(0.0)))
    x = x.withColumn("lp", log_post).withColumn("top", F.array_max("lp"))
    norm = F.aggregate("lp", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    names = F.array(*[F.lit(x) for x in langs])
    some = F.col("letters") > 0
    return (x.withColumn("lang_", F.when(some, F.element_at(names, F.array_position("lp", F.col("top")).cast("int")))
                         .otherwise(UND))
            .withColumn("posterior", F.when(some, F.lit(1.0) / norm).otherwise(0.0))
            .select("row_id", *keep, F.col("lang_").alias("lang"), "posterior", "text_lang", "trigrams",
                    ((F.col("lang_") == UND) | (F.col("posterior") < ACCEPT)).alias("rejected")))


def from_documents(docs: DataFrame) -> DataFrame:
    """Rows of a ``documents`` table: the source is the host."""
    no = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("host"), no.alias("domain"), no.alias("suffix"),
                       no.alias("declared"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Rows of a ``pages`` table."""
    host, domain, suffix = address(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("row_id"), visible_text(F.col("html")).alias("text"),
                        host.alias("host"), domain.alias("domain"), suffix.alias("suffix"),
                        declared_language(F.col("html")).alias("declared"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, lang and whatever else) without the
    rows whose language is not told. The rejected rows' keys are written
    first, so Spark knows their size when it plans the join."""
    def key(*parts):                        # 128 bits of the columns as ``from_documents`` has them
        return {"key_a": F.xxhash64(F.lit(1), *parts), "key_b": F.xxhash64(F.lit(2), *parts)}

    rows = from_documents(docs).withColumns(key("row_id", "host", "text"))
    found = identify(rows, fit_text_model(docs), ("key_a", "key_b")).where("rejected")
    rejected = stored(found.select("key_a", "key_b").distinct(), "rejected")
    own = key(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return docs.join(rejected, (own["key_a"] == rejected["key_a"]) & (own["key_b"] == rejected["key_b"]), "left_anti")
