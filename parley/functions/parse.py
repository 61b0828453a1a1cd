"""Parsing of raw model output (Column -> Column), all native regex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import _c, strip_ws, words

# Patterns of the output parsers (fixed values).
SENTIMENT_CODE_RE = "sentiment:[ \\t\\n\\r\\f]*(1|0|-1)\\b"
SENTIMENT_WORD_RE = "(?s)sentiment:.*(positive|neutral|negative)"
SENTIMENT_DIGIT_RE = "Sentiment: (-?\\d)"
SENTIMENT_SENTINEL = "$#$#$#"
SERVICE_SUMMARY_RE = "(?s)Summarization:[ \\t\\n\\r\\f]*\\n\\n(.*)"
SUMMARY_MARKER = "Summary:"


def code_to_label(code) -> Column:
    """-1/0/1 (as int or string) -> label; anything else -> NULL."""
    code = _c(code).cast("int")
    return (F.when(code == -1, "negative").when(code == 0, "neutral")
            .when(code == 1, "positive"))


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, pattern, 0) != ""


def extract_sentiment(c, variant: str = "v1") -> Column:
    """Label from raw output.

    v1: lower case; first ``sentiment:`` followed by -1/0/1 as a word, else
        the *last* label word after the first ``sentiment:``, else neutral.
    v2: case-sensitive ``Sentiment: <digit>`` (default 0) mapped to a label;
        a digit outside -1..1 gives NULL (see ``sentiment_code`` for it).
    v3: text after the last ``$#$#$#`` sentinel, stripped.
    v4: the raw output unchanged.
    """
    c = _c(c)
    if variant == "v1":
        low = F.lower(c)
        code = F.regexp_extract(low, SENTIMENT_CODE_RE, 1)
        word = F.regexp_extract(low, SENTIMENT_WORD_RE, 1)
        return (F.when(code != "", code_to_label(code))
                .when(word != "", word)
                .otherwise(F.lit("neutral")))
    if variant == "v2":
        return code_to_label(sentiment_code(c))
    if variant == "v3":
        return strip_ws(F.element_at(F.split(c, "\\$#\\$#\\$#", -1), -1))
    if variant == "v4":
        return c
    raise ValueError(f"unknown sentiment variant {variant!r}")


def sentiment_code(c) -> Column:
    """Digit after ``Sentiment: `` as int, 0 when absent (variant v2)."""
    d = F.regexp_extract(_c(c), SENTIMENT_DIGIT_RE, 1)
    return F.when(d == "", F.lit(0)).otherwise(d.cast("int"))


def extract_summary(c, variant: str = "first_line") -> Column:
    """Summary from raw output: text after the first ``Summary:``.

    rest:       the whole rest, stripped; '' without marker
    first_line: first line of the stripped rest; '' without marker
    fallback:   rest after ``Summary: `` stripped, else the whole output
    service:    DOTALL group after ``Summarization:`` + blank line, stripped
    """
    c = _c(c)
    pos = F.locate(SUMMARY_MARKER, c)
    rest = strip_ws(F.substring(c, pos + len(SUMMARY_MARKER), 1 << 30))
    if variant == "rest":
        return F.when(pos > 0, rest).otherwise(F.lit(""))
    if variant == "first_line":
        return F.when(pos > 0, F.split_part(rest, F.lit("\n"), F.lit(1))).otherwise(F.lit(""))
    if variant == "fallback":
        pos2 = F.locate("Summary: ", c)
        return F.when(pos2 > 0, strip_ws(F.substring(c, pos2 + 9, 1 << 30))).otherwise(c)
    if variant == "service":
        return strip_ws(F.regexp_extract(c, SERVICE_SUMMARY_RE, 1))
    raise ValueError(f"unknown summary variant {variant!r}")


def strip_prompt(c, prompt) -> Column:
    """Raw output without the prompt that it repeats at its start, so that
    a marker inside the dialogue is not taken for the answer's; unchanged
    where it does not start with the prompt."""
    c, prompt = _c(c), _c(prompt)
    return F.when(c.startswith(prompt), F.substring(c, F.length(prompt) + 1, F.lit(1 << 30))).otherwise(c)


def length_bounds(c) -> Column:
    """Struct(max_length, min_length) of the pre-study summariser:
    max = max(30, int(0.5 * words)), min = min(5, int(0.2 * words))."""
    n = F.size(words(c))
    return F.struct(
        F.greatest(F.lit(30), F.floor(n * F.lit(0.5)).cast("int")).alias("max_length"),
        F.least(F.lit(5), F.floor(n * F.lit(0.2)).cast("int")).alias("min_length"),
    )
