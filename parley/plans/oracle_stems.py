"""DuckDB text of the suffix stemmer (mirror of ``parley.functions.stem``),
one CTE per step over the vocabulary. The measure conditions are patterns:
a vowel run starts with aeiou, or with y after a consonant."""

from __future__ import annotations

from parley.functions.stem import IRREGULAR, STEP_2, STEP_3, STEP_4
from parley.plans.oracle_views import _view

_S = "(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])[aeiou]*"
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"


def _like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _vowel(x: str) -> str:
    return _like(x, f"^{_S}")


def _m0(x: str) -> str:
    return _like(x, f"^{_S}{_C}")


def _m_is_1(x: str) -> str:
    return _like(x, f"^{_S}{_C}(?:{_V})?$")


def _m1(x: str) -> str:
    return _like(x, f"^{_S}{_C}{_V}{_C}")


def _short_end(x: str) -> str:
    return f"({_like(x, '(?:[^aeiouy]|^y|[aeiou]y)[aeiouy][^aeiouwxy]$')} OR {_like(x, '^[aeiou][^aeiou]$')})"


def _cut(x: str, k: int) -> str:
    return f"left({x}, length({x}) - {k})"


def _table(x: str, table) -> str:
    """First suffix that fits decides."""
    cases = " ".join(f"WHEN {x} LIKE '%{a}' THEN CASE WHEN {_m0(_cut(x, len(a)))} THEN {_cut(x, len(a))} || '{b}' ELSE {x} END"
                     for a, b in table)
    return f"CASE {cases} ELSE {x} END"


_view("vocabulary", ("meteor_lists", "clip_tokens"), """
SELECT DISTINCT w FROM (SELECT unnest(ht) AS w FROM meteor_lists UNION ALL SELECT unnest(rt) FROM meteor_lists
                        UNION ALL SELECT unnest(ht) FROM clip_tokens UNION ALL SELECT unnest(rt) FROM clip_tokens)""")
_view("stem_1a", ("vocabulary",), f"""
SELECT w, CASE WHEN w LIKE '%ies' THEN CASE WHEN length(w) = 4 THEN {_cut('w', 1)} ELSE {_cut('w', 2)} END
               WHEN w LIKE '%sses' THEN {_cut('w', 2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_cut('w', 1)} ELSE w END AS x
FROM vocabulary""")
_view("stem_1b", ("stem_1a",), f"""
SELECT w, CASE WHEN f IS NULL THEN x
               WHEN {_like('f', '(at|bl|iz)$')} THEN f || 'e'
               WHEN length(f) > 1 AND right(f, 1) = substr(f, length(f) - 1, 1) AND {_like('f', '[^aeiouy]$')}
                 THEN CASE WHEN right(f, 1) IN ('l', 's', 'z') THEN f ELSE {_cut('f', 1)} END
               WHEN {_m_is_1('f')} AND {_short_end('f')} THEN f || 'e' ELSE f END AS x
FROM (SELECT w, CASE WHEN x LIKE '%ied' THEN CASE WHEN length(x) = 4 THEN {_cut('x', 1)} ELSE {_cut('x', 2)} END
                     WHEN x LIKE '%eed' AND {_m0(_cut('x', 3))} THEN {_cut('x', 1)} ELSE x END AS x,
             CASE WHEN x LIKE '%ied' OR x LIKE '%eed' THEN NULL
                  WHEN x LIKE '%ed' AND {_vowel(_cut('x', 2))} THEN {_cut('x', 2)}
                  WHEN x LIKE '%ing' AND {_vowel(_cut('x', 3))} THEN {_cut('x', 3)} END AS f
      FROM stem_1a)""")
_view("stem_1c", ("stem_1b",), f"""
SELECT w, CASE WHEN length(x) > 2 AND {_like('x', '(?:[^aeiouy]|[aeiou]y)y$')} THEN {_cut('x', 1)} || 'i' ELSE x END AS x
FROM stem_1b""")
_view("stem_2", ("stem_1c",), f"""
SELECT w, CASE WHEN x LIKE '%logi' THEN CASE WHEN {_m0(_cut('x', 3))} THEN {_cut('x', 1)} ELSE x END
               ELSE {_table('x', STEP_2)} END AS x
FROM (SELECT w, CASE WHEN x LIKE '%alli' AND {_m0(_cut('x', 4))} THEN {_cut('x', 2)} ELSE x END AS x FROM stem_1c)""")
_view("stem_3", ("stem_2",), f"SELECT w, {_table('x', STEP_3)} AS x FROM stem_2")
_LAST = " ".join(f"WHEN x LIKE '%{a}' THEN CASE WHEN {_m1(_cut('x', len(a)))}"
                 + (f" AND {_like(_cut('x', 3), '[st]$')}" if a == "ion" else "")
                 + f" THEN {_cut('x', len(a))} ELSE x END" for a in STEP_4)
_view("stem_4", ("stem_3",), f"SELECT w, CASE {_LAST} ELSE x END AS x FROM stem_3")
_view("stem_5", ("stem_4",), f"""
SELECT w, CASE WHEN x LIKE '%ll' AND {_m1(_cut('x', 1))} THEN {_cut('x', 1)} ELSE x END AS x
FROM (SELECT w, CASE WHEN x LIKE '%e' AND ({_m1(_cut('x', 1))}
                          OR ({_m_is_1(_cut('x', 1))} AND NOT {_short_end(_cut('x', 1))})) THEN {_cut('x', 1)} ELSE x END AS x
      FROM stem_4)""")
_IRREGULAR = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
_view("stems", ("stem_5",), f"""
SELECT w, CASE WHEN w IN ({", ".join(f"'{a}'" for a in IRREGULAR)}) THEN CASE w {_IRREGULAR} END
               WHEN length(w) < 3 THEN w ELSE x END AS stem FROM stem_5""")


def stemmed(source: str, h: str, r: str, longer_than: int) -> str:
    """dialogue_id, model_id, hs, rs: the token lists with stems."""
    side = lambda c: f"""
      SELECT dialogue_id, model_id, '{c}' AS side, unnest(range(0, len({c}))) AS pos, unnest({c}) AS w FROM {source}"""  # noqa: E731
    lists = ", ".join(f"coalesce(list(s ORDER BY pos) FILTER (WHERE side = '{c}'), []) AS {n}" for c, n in ((h, "hs"), (r, "rs")))
    return f"""
SELECT p.*, l.hs, l.rs FROM {source} p LEFT JOIN (
  SELECT dialogue_id, model_id, {lists}
  FROM (SELECT t.*, CASE WHEN length(t.w) > {longer_than} THEN v.stem ELSE t.w END AS s
        FROM ({side(h)} UNION ALL {side(r)}) t JOIN stems v ON t.w = v.w)
  GROUP BY dialogue_id, model_id) l ON p.dialogue_id = l.dialogue_id AND p.model_id = l.model_id"""
