"""Personal data in whole texts, disguised forms included.

Base spans come from four patterns on the text as it is. The method then
runs transducers over the text: homoglyphs (full-width and look-alike
letters and digits) become ASCII, "at" and "dot" disguises become signs, spelled digits
become digits, each by itself where its neighbours, disguised or not, make
an address or a number. Every normalised character carries the
source span it came from, so an identifier found in the normalised text
maps back to exact source offsets. Added spans are those that lie in no
base span of their kind; one may reach beyond a base span.

Offsets count code points, ends exclusive. Edge cases: null and empty
texts have no spans; every row is judged by itself, so repeated rows and
ties need no rule; matches that fail their test are dropped and what they
covered is not tried again. Every scan is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textvec as tv

KINDS = ("email", "ip", "card", "phone")

_AT_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits can only follow a failed start before it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails, from each @ backwards: whichever
    start a scan from the left takes, the part after the @ decides."""
    end, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > end and t[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(t, at + 1)):
            yield s, m.end()
            end = m.end()
        at = t.find("@", max(at + 1, end))


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def identifiers(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", s, e) for s, e in emails(t)]
    if not _DIGIT.search(t):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(t)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(t)
            if 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in t:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- transducers ---------------------------------------------------------

#: Characters that look like an ASCII one.
HOMOGLYPHS = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    # Greek
    "ο": "o", "Ο": "O", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v",
    # signs
    "\u2024": ".", "\u3002": ".", "\ufe52": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2013": "-",
    "\u2212": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
} | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_HOMO = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "]")
#: Invisible characters that split an identifier.
_HIDDEN = re.compile("[\\u200b\\u200c\\u200d\\u2060\\ufeff\\u00ad]")

#: Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
               "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_W = "(?:" + "|".join(DIGIT_WORDS) + ")"
#: Four digit words or more in a row, perhaps with "plus" or "dot" between.
_SPELLED = re.compile(rf"\b(?:plus[ ,-]+)?{_W}(?:[ ,-]+(?:(?:dot|point)[ ,-]+)?{_W}){{3,}}\b", re.I)
#: The first pair of whatever _SPELLED matches, "dot" between or not.
_SPELLED_HINT = re.compile(rf"\b{_W}[ ,-]+(?:(?:dot|point)[ ,-]+)?{_W}\b", re.I)
_ATOM = re.compile(rf"\b(plus|dot|point|{_W})\b", re.I)

#: Digit words and digits mixed, signs spelled or not; one word at least
#: must be spelled.
_PART = rf"(?:{_W}\b|[0-9]++)"
_MIXED = re.compile(rf"(?:\bplus[ ,-]++|\+[ ]?)?\b{_PART}(?:(?:\.|[ ,()-]++(?:(?:dot|point)[ ,-]++)?){_PART})+\b", re.I)
_MIXED_HINT = re.compile(rf"\b(?:plus|dot|point|{_W})\b", re.I)
_MIXED_ATOM = re.compile(rf"(\b(?:plus|dot|point|{_W})\b)|[0-9]+|[+.]", re.I)

#: Endings that an address with a bare "at" must have, and
#: those a real "@" takes first: country codes and common others.
ENDINGS = frozenset("""com org net edu gov mil int info biz name pro aero coop museum mobi travel jobs cat tel asia post arpa
dev app xyz online site website shop store blog cloud tech email page agency digital network systems solutions
ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bl bm bn bo bq br bs bt bw by bz
ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg eh er es et eu fi fj fk fm fo fr
ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it
je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mf mg mh mk ml mm mn mo mp mq
mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs
ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz
ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split())
#: Endings that are words too: no ending after a word that no host is named.
_WORDS_TOO = frozenset("am as by do is me my no so to us".split())
_NO_HOST = frozenset("a an the this that these those each every my your his her its our their".split())
#: "name [at] host [dot] tld": bracketed signs anywhere.
_BRACKET = re.compile(r"[ \t]{0,3}(?:\[ ?(at|dot) ?\]|\( ?(at|dot) ?\)|\{ ?(at|dot) ?\}|<(at|dot)>)[ \t]{0,3}", re.I)
#: Bare words and real signs mixed, from each at sign forwards and backwards.
_AT = re.compile(r"@|\s{1,3}at\s{1,3}", re.I)
_DOT = r"\s{1,3}dot\s{1,3}"
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)+", re.I)
_FIRST = re.compile(r"[A-Za-z0-9-]+")
_LABEL = re.compile(rf"(\.|{_DOT})([A-Za-z0-9-]+)", re.I)
_DOT_WORD = re.compile(_DOT, re.I)
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]++(?:\s{1,3}tod\s{1,3}[A-Za-z0-9._%+-]++)*", re.I)


class Mapped:
    """A text with the source span of every character."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[tuple[int, int, int, int]] = []    # start, end here -> source start, end

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self._back(s, False), self._back(e, True)

    def _back(self, pos: int, end: bool) -> int:
        """Source offset of an offset here; inside an edit, its source
        start, or its source end if the offset ends a span."""
        i = bisect_left(self.edits, (pos, -1, -1, -1)) if end else bisect_right(self.edits, (pos, len(self.text) + 1, 0, 0))
        if not i:
            return pos
        a, b, x, y = self.edits[i - 1]
        if pos < b or (end and pos == b and a < b):
            return y if end else x
        return pos + y - b


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> Mapped:
    """Apply (start, end, new) edits, left to right; overlaps lose."""
    out, made, at, n = [], [], 0, 0
    for s, e, new in sorted(edits):
        if s < at:
            continue
        out.append(text[at:s])
        n += s - at
        out.append(new)
        made.append((n, n + len(new), s, e))
        n += len(new)
        at = e
    out.append(text[at:])
    m = Mapped("".join(out))
    m.edits = made
    return m


def _homoglyph_edits(t: str) -> list[tuple[int, int, str]]:
    if t.isascii():
        return []
    return ([(m.start(), m.end(), HOMOGLYPHS[m[0]]) for m in _HOMO.finditer(t)]
            + [(m.start(), m.end(), "") for m in _HIDDEN.finditer(t)])


def _spelled_edits(t: str) -> list[tuple[int, int, str]]:
    edits = []
    if _SPELLED_HINT.search(t):
        for m in _SPELLED.finditer(t):
            atoms = list(_ATOM.finditer(t, m.start(), m.end()))
            last = None
            for a in atoms:
                w = a[0].lower()
                new = "+" if w == "plus" else "." if w in ("dot", "point") else DIGIT_WORDS[w]
                edits.append((a.start() if last is None else last, a.end(), new))
                last = a.end()
    return edits


def _mixed_edits(t: str) -> list[tuple[int, int, str]]:
    """Digits told one by one are joined; other gaps become one sign."""
    edits = []
    if not _MIXED_HINT.search(t):
        return edits
    for m in _MIXED.finditer(t):
        atoms = list(_MIXED_ATOM.finditer(t, m.start(), m.end()))
        if not any(a[1] for a in atoms):
            continue
        end, was = m.start(), "sign"                    # what ends there
        for a in atoms:
            w = a[0].lower()
            new = {"plus": "+", "dot": ".", "point": "."}.get(w) or DIGIT_WORDS.get(w, w)
            kind = "sign" if new in "+." else "word" if a[1] else "digit" if len(w) == 1 else "digits"
            gap = t[end:a.start()]
            if "sign" in (was, kind) or {was, kind} in ({"word"}, {"word", "digit"}):
                sep = ""
            else:
                sep = gap if gap in " -" else " "
            if sep + new != gap + a[0]:
                edits.append((end, a.end(), sep + new))
            end, was = a.end(), kind
    return edits


def _host_end(t: str, host: re.Match, real: bool) -> int:
    """Where the host after an at sign ends; 0 if it is none."""
    end, label = 0, _FIRST.match(t, host.start())[0]
    first = last = label
    dotted = False                                      # a real dot
    for x in _LABEL.finditer(t, host.start() + len(label), host.end()):
        word = x[2].split("-")[0]
        known = word.lower() in ENDINGS
        if not real:
            known &= not (word.lower() in _WORDS_TOO and last.lower() in _NO_HOST)
            known &= not (x[1] == "." and word.istitle() and not last.istitle())    # the next sentence
        if known:
            end = x.end()
        dotted |= x[1] == "."
        last = x[2]
    if real and not end and not dotted and last.isalpha() and len(last) > 1 and not _AT.match(t, host.end()):
        end = host.end()
    return 0 if not real and first.lower() == "www" else end


def _bare_edits(t: str) -> list[tuple[int, int, str]]:
    """Every stretch between two at signs is looked at once each way."""
    edits, after = [], 0
    for a in _AT.finditer(t):
        before, after = after, a.end()
        real = a[0] == "@"
        if not (h := _HOST.match(t, after)):
            continue
        end = _host_end(t, h, real)
        if not end and real and (d := _DOMAIN.match(t, after)):
            end = d.end()                               # its name may be disguised
        if not end or not (m := _LOCAL_BACK.match(t[before:a.start()][::-1])):
            continue
        if not real:
            edits.append((a.start(), a.end(), "@"))
        for lo, hi in ((a.start() - m.end(), a.start()), (after, end)):
            edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(t, lo, hi)]
    return edits


def added_spans(t: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers of the normalised text that lie in no base span of
    their kind, in source offsets. Digit words are read by themselves and
    together with digits."""
    chain = [Mapped(t)]
    for edit in (_homoglyph_edits, lambda x: [
            (m.start(), m.end(), "@" if (m[1] or m[2] or m[3] or m[4]).lower() == "at" else ".") for m in _BRACKET.finditer(x)]):
        if edits := edit(chain[-1].text):
            chain.append(rewrite(chain[-1].text, edits))
    now = chain[-1].text
    bare, mixed = _bare_edits(now), _mixed_edits(now)
    spelled = _spelled_edits(now) if mixed else []      # needs words that the mixed form takes too
    ways = [bare + spelled] + ([bare + mixed] if mixed and mixed != spelled else [])
    if len(chain) == 1 and not any(ways):
        return []
    found = set()
    for edits in ways:
        last = rewrite(now, edits) if edits else Mapped(now)
        for kind, s, e in identifiers(last.text):
            for m in (last, *reversed(chain)):
                s, e = m.source(s, e)
            if e > s:
                found.add((kind, s, e))
    out = []
    for k in KINDS:
        taken = _outermost([(s, e) for kind, s, e in base if kind == k])
        out += [(k, s, e) for s, e in _outermost([(s, e) for kind, s, e in found if kind == k]) if not _within(taken, s, e)]
    return out


def _outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other, by start (and so by end)."""
    out, reach = [], -1
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if e > reach:
            out.append((s, e))
            reach = e
    return out


def _within(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    i = bisect_right(taken, (s, 1 << 62)) - 1
    return i >= 0 and e <= taken[i][1]


def find(t: str | None) -> tuple[list, list]:
    """(base spans, added spans)."""
    if not t:
        return [], []
    base = identifiers(t)
    return base, added_spans(t, base)


def digest(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (all) as "kind:start:end" lists joined by
    commas, by kind, then start. One pass, no shuffle."""
    def run(batches):
        for b in batches:
            base, every = [], []
            for text in b.column(1):
                got, more = find(text.as_py())
                base.append(digest(got))
                every.append(digest(got + more) if more else base[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.string()), pa.array(every, pa.string())],
                                             ["doc_id", "base", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
               .mapInArrow(tv.tidy(run), "doc_id long, base string, spans string")


def masker():
    """Column function: the text with every span replaced by <KIND>;
    null stays null."""
    from pyspark.sql.functions import pandas_udf

    def one(t: str | None) -> str | None:
        if not t:
            return t
        base, more = find(t)
        out, at = [], 0
        for s, e, kind in sorted((s, e, k) for k, s, e in base + more):
            if s < at:          # covered in part by the span before: widen
                at = max(at, e)
                continue
            out.append(t[at:s])
            out.append(f"<{kind.upper()}>")
            at = e
        return "".join(out) + t[at:]

    @pandas_udf("string")
    def mask(col: pd.Series) -> pd.Series:
        return col.map(one, na_action="ignore").astype(object)
    return mask


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text column."""
    clean: Column = masker()(F.col(text))
    return docs.withColumn(text, clean)
