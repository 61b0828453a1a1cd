"""Chunker and parsers: expected values and properties."""

import random
import re

from pyspark.sql import functions as F

from parley.functions.chunk import chunk_array
from parley.functions.parse import extract_sentiment, extract_summary, length_bounds
from parley.functions.text import normalise_text, rouge_words, words

LIMIT = 1024
EXPECTED = {
    "": [""],
    "a" * 1024: ["a" * 1024],
    "a" * 1025: ["", "a" * 1025],
    "y" * 5000: ["", "y" * 5000],
    "x" * 1100 + "\nshort line\nother": ["", "x" * 1100, "short line\nother"],
    "first\n" + "z" * 2000 + "\nlast": ["first", "z" * 2000, "last"],
    "a\n" * 511 + "bb": ["a\n" * 511 + "bb"],
    "a\n" * 511 + "bcd": [("a\n" * 511).strip(), "bcd"],
}


def test_chunker_expected_chunks(spark):
    df = spark.createDataFrame(list(EXPECTED.items()), "t string, want array<string>")
    for r in df.select("t", "want", chunk_array("t").alias("got")).collect():
        assert list(r.got) == list(r.want), r.t[:20]


def check_chunks(text, chunks):
    """Lines stay whole and in order; a chunk of several lines is under the
    limit; the line after a chunk would not have fitted."""
    if len(text) <= LIMIT:
        assert chunks == [text]
        return
    assert "\n".join(c for i, c in enumerate(chunks) if c or i) == text
    for c in chunks:
        assert len(c) < LIMIT or "\n" not in c
    for a, b in zip(chunks, chunks[1:]):
        assert len(a) + bool(a) + len(b.split("\n")[0]) >= LIMIT


def test_chunker_properties(spark):
    rnd = random.Random(7)
    texts = ["\n".join("".join(rnd.choice("abcde") for _ in range(rnd.choice([1, 30, 200, 400, 1500])))
                       for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chunk_array("t").alias("c")).collect():
        check_chunks(r.t, list(r.c))


def test_chunker_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", chunk_array("text").alias("c")).collect()
    assert rows
    ws = re.compile(r"[ \t\n\r\f]+")
    for r in rows:      # chunks restore the text but for stripped white space
        assert ws.sub("", "".join(r.c)) == ws.sub("", r.text)
        assert all(len(c) < LIMIT or "\n" not in c for c in r.c) or len(r.text) <= LIMIT


def test_sentiment_v1_expected_labels(spark):
    cases = {
        "Sentiment: -1": "negative",
        "Sentiment:\n1": "positive",
        "sentiment: 10": "neutral",
        "Sentiment: 2 it is positive or negative": "negative",
        "Sentiment: maybe\nneutral": "neutral",
        "no label at all": "neutral",
        "Sentiment: 1.5": "positive",
        "Sentiment:-1 x": "negative",
        "x sentiment: 0": "neutral",
    }
    df = spark.createDataFrame(list(cases.items()), "out string, want string")
    for r in df.select("out", "want", extract_sentiment("out", "v1").alias("got")).collect():
        assert r.got == r.want, r.out


def test_sentiment_variants(spark):
    df = spark.createDataFrame([("a Sentiment: -1",), ("Sentiment: 7",), ("nothing",),
                                ("$#$#$#prompt$#$#$# positive ",)], "out string")
    r = df.select(extract_sentiment("out", "v2").alias("v2"),
                  extract_sentiment("out", "v3").alias("v3")).collect()
    assert [x.v2 for x in r] == ["negative", None, "neutral", "neutral"]
    assert r[3].v3 == "positive"


def test_summary_variants(spark):
    df = spark.createDataFrame([("P\nSummary: one\ntwo ",), ("no marker",),
                                ("Summarization:\n\nThe summary.\n",)], "o string")
    r = df.select(extract_summary("o", "rest").alias("rest"), extract_summary("o", "first_line").alias("fl"),
                  extract_summary("o", "fallback").alias("fb"), extract_summary("o", "service").alias("sv")).collect()
    assert (r[0].rest, r[0].fl, r[0].fb) == ("one\ntwo", "one", "one\ntwo ".strip())
    assert (r[1].rest, r[1].fl, r[1].fb) == ("", "", "no marker")
    assert r[2].sv == "The summary."


def test_words_and_bounds(spark):
    df = spark.createDataFrame([("  a  b\tc\n",), ("",)], "t string")
    r = df.select(words("t").alias("w"), length_bounds("t").alias("b"), normalise_text("t").alias("n")).collect()
    assert list(r[0].w) == ["a", "b", "c"] and list(r[1].w) == []
    assert (r[0].b.max_length, r[0].b.min_length) == (30, 0)
    assert r[0].n == "a b c"


def test_rouge_words(spark):
    want = {"a. b": ["a", "b"], "a. . b": ["a", "", "b"], "end. ": ["end", ""], "  . x": ["", "x"], "": [], "...": [],
            "x.\n.y z": ["x", "", "y", "z"], "one two. three": ["one", "two", "three"]}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: list(r.w) for r in df.select("t", rouge_words(F.col("t")).alias("w")).collect()} == want


def test_strip_prompt_and_sentiment_prompts(spark):
    from parley.functions.parse import extract_summary, strip_prompt
    from parley.operators.generate import sentiment_prompts
    from parley.schemas import SENTIMENT_PROMPT, SENTIMENT_PROMPT_ZEPHYR
    rows = [("say Summary: no\nSummary:", "say Summary: no\nSummary: yes"), ("p", "q"), ("p", None), ("", "x"), ("long prompt", "long")]
    df = spark.createDataFrame(rows, "prompt string, output string")
    assert [r[0] for r in df.select(strip_prompt("output", "prompt")).collect()] == [" yes", "q", None, "x", "long"]
    assert df.select(extract_summary("output", "rest").alias("s")).first().s == "no\nSummary: yes"     # the dialogue's marker
    d = spark.createDataFrame([("mistral 7b", "100 % {}"), ("zephyr 7b beta", "t"), ("other", "t")], "model_id string, dialogue_text string")
    got = [r.prompt for r in sentiment_prompts(d).collect()]
    assert got == [SENTIMENT_PROMPT.replace("{}", "100 % {}"), SENTIMENT_PROMPT_ZEPHYR.replace("{}", "t"), SENTIMENT_PROMPT.replace("{}", "t")]
