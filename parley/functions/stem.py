"""Porter's suffix stemmer (M. F. Porter, "An algorithm for suffix
stripping", 1980) with the usual extensions, over token arrays.

A word is seen as runs of consonants and vowels, ``[C](VC)^m[V]``; most
suffixes only go if what is left has a large enough measure m. ``y`` is a
vowel after a consonant; whatever is not a letter is a consonant.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from parley.functions.arrow import as_word

# The published suffix tables, in their order; of each table
# the first suffix that a word ends in counts.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
          "ous", "ive", "ize")
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
             "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def shape(word: str) -> str:
    """``v`` for each vowel, ``c`` for each consonant."""
    out = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(word: str) -> int:
    return shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _swap(word: str, table, least: int) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[:len(word) - len(suffix)]
            return stem + new if measure(stem) >= least else word
    return word


def _plurals(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past_forms(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    stem = next((word[:-len(end)] for end in ("ed", "ing") if word.endswith(end) and "v" in shape(word[:-len(end)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and _short_end(stem) else stem


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]):
        word = word[:-2]
    if word.endswith("logi"):
        return word[:-1] if measure(word[:-3]) else word
    return _swap(word, STEP_2, 1)


def _last_suffix(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[:len(word) - len(suffix)]
            fits = measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if fits else word
    return word


def porter(word: str) -> str:
    """Stem of a lower-case word; words of one or two signs stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    word = _past_forms(_plurals(word))
    if word.endswith("y") and len(word) > 2 and shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _last_suffix(_swap(_double_suffix(word), STEP_3, 1))
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


#: Words whose stems a Python worker keeps; beyond it starts anew.
CACHE_WORDS = 500_000
_known: dict[str, str] = {}


def _stems(words, longer_than: int) -> list[str]:
    out = []
    for w in words:
        if len(w) <= longer_than:
            out.append(w)
            continue
        s = _known.get(w)
        if s is None:
            if len(_known) >= CACHE_WORDS:
                _known.clear()
            s = _known[w] = porter(w)
        out.append(s)
    return out


class PorterStems:
    """Stems of token arrays, in Arrow batches; shorter tokens stay."""

    def __init__(self, longer_than: int = 0):
        self.longer_than = longer_than
        self.known: dict[bytes, bytes] = {}

    def of_words(self, words) -> list[str]:
        return _stems(words, self.longer_than)

    def of_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """The same on a text's tokens as bytes."""
        out = []
        for t in tokens:
            s = self.known.get(t)
            if s is None:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                word = as_word(t)
                s = self.known[t] = (word if len(word) <= self.longer_than else porter(word)).encode()
            out.append(s)
        return out

    def on_tokens(self, tokens: Column) -> Column:
        longer_than = self.longer_than

        @pandas_udf(T.ArrayType(T.StringType()))
        def stems(col: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else _stems(x, longer_than) for x in col], dtype=object)
        return stems(tokens)


class FinalS:
    """A small stem rule, on a column or on a text's tokens as bytes: drops
    one final ``s``."""

    def __call__(self, token: Column) -> Column:
        return F.regexp_replace(token, "s\\z", "")

    def of_tokens(self, tokens: list[bytes]) -> list[bytes]:
        return [t[:-1] if t.endswith(b"s") else t for t in tokens]


def porter_column(word: Column) -> Column:
    """Stem of one word column (a vocabulary, for example)."""
    return F.get(PorterStems().on_tokens(F.array(word)), F.lit(0))
