"""Native text expressions (Column -> Column). All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.schemas import WS_CHARS, WS_CLASS

WS_RUN = WS_CLASS + "+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()`` on ASCII whitespace."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def words(c) -> Column:
    """Whitespace word list, like Python ``str.split()``: no empty edge
    tokens (Spark ``split`` alone keeps them)."""
    return F.filter(F.split(_c(c), WS_RUN), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def space_words(c) -> Column:
    """Python ``str.split(' ')``: single-space separator, empties kept."""
    return F.split(_c(c), " ", -1)


def word_slice(c, start, length) -> Column:
    """Words ``start .. start+length-1`` (1-based) joined by one space."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.array_join(F.slice(words(c), start, length), " ")


def first_words(c, n: int) -> Column:
    return word_slice(c, 1, n)


def token_estimate(c) -> Column:
    """Characters / 4 as the token estimate of the corpus profile."""
    return F.length(_c(c)) / F.lit(4.0)


def normalise_text(c, strict: bool = False) -> Column:
    """Duplicate key of a text.

    Default is the behaviour the profile actually had: whitespace runs
    collapse to one space, then strip (case and punctuation are kept,
    because each cleaning step restarted from the raw text). ``strict``
    gives the documented intent: lower case, only ASCII letters, digits
    and whitespace kept.
    """
    c = _c(c)
    if strict:
        c = F.regexp_replace(F.lower(c), "[^a-zA-Z0-9 \\t\\n\\r\\f]", "")
    return strip_ws(F.regexp_replace(c, WS_RUN, " "))


def fill_template(template, text) -> Column:
    """Put ``text`` where ``{}`` is in ``template`` (no %-formatting, so
    texts with '%' or braces are safe)."""
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(template, F.lit("{}"), _c(text))


# Word of the set-based ROUGE, or a whole whitespace-only piece between two
# dots (or a dot and an end of the text); the latter becomes an empty word.
ROUGE_TOKEN_RE = "[^. \\t\\n\\r\\f]+|(?:^|(?<=\\.))[ \\t\\n\\r\\f]+(?=\\.|\\z)"


def rouge_words(c) -> Column:
    """Word list of the set-based ROUGE: text cut at '.', empty pieces
    dropped, each piece's whitespace collapsed; a piece of only whitespace
    contributes one empty word. Computed in one regex pass: the tokens are
    the runs of characters other than '.' and whitespace, plus each
    whitespace-only piece (trimmed to '')."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(ROUGE_TOKEN_RE), 0),
                       lambda x: F.btrim(x, F.lit(WS_CHARS)))


def ngrams(arr: Column, n: int) -> Column:
    """n-grams of a word array as strings joined by one space.

    Built from n shifted slices zipped pairwise, so the array is read a
    fixed number of times (a lambda indexing ``arr`` per element would
    re-evaluate the array expression for every element)."""
    if n == 1:
        return arr
    m = F.greatest(F.size(arr) - n + 1, F.lit(0))
    g = F.slice(arr, 1, m)
    for k in range(1, n):
        g = F.zip_with(g, F.slice(arr, k + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return g


def score_tokens(c) -> Column:
    """Tokens of the clipped-count ROUGE: lower case, every character
    outside [a-z0-9] is a separator."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "), " "),
                    lambda w: w != "")


# Word / punctuation tokens of METEOR (lower case).
METEOR_TOKEN_RE = "[^ \\t\\n\\r\\f.,;:!?()\"]+|[.,;:!?()\"]"


def meteor_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(METEOR_TOKEN_RE), 0)
