"""DuckDB SQL of the derived tables, mirroring ``parley.sources.fixtures``.

``with_views(sql, ...)`` prefixes a query with the CTEs it needs (and their
dependencies), so every oracle string is one self-contained statement over
the driver's pre-registered tables.
"""

from __future__ import annotations

from parley.schemas import MODEL_IDS

WS_RE = r"'[ \t\n\r\f]+'"
WS_TRIM = "(' ' || chr(9) || chr(10) || chr(13) || chr(12))"
NL = "chr(10)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {WS_RE}), lambda w: w <> '')"


def rouge_words(x: str) -> str:
    return (f"flatten(list_transform(list_filter(string_split({x}, '.'), lambda s: length(s) > 0), "
            f"lambda s: CASE WHEN len({words('s')}) = 0 THEN [''] ELSE {words('s')} END))")


def strip(x: str) -> str:
    return f"trim({x}, {WS_TRIM})"


def label_word(x: str) -> str:
    return f"CASE {x} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END"


def cost_time(n: str, mno: str) -> str:
    return f"sqrt(CAST({n} % 97 AS DOUBLE) + 0.5::DOUBLE) * 0.01 * {mno}"


def cost_memory(n: str, mno: str, did: str) -> str:
    base = f"(CAST({n} % 53 AS DOUBLE) * 10.0 + {mno})"
    return f"CASE WHEN {did} % 101 = 0 THEN {base} * 50.0 ELSE {base} END"


def sentiment_v1(x: str) -> str:
    code = rf"regexp_extract(lower({x}), 'sentiment:[ \t\n\r\f]*(1|0|-1)\b', 1)"
    word = f"regexp_extract(lower({x}), '(?s)sentiment:.*(positive|neutral|negative)', 1)"
    return (f"CASE WHEN {code} <> '' THEN (CASE {code} WHEN '-1' THEN 'negative' WHEN '0' THEN 'neutral' "
            f"ELSE 'positive' END) WHEN {word} <> '' THEN {word} ELSE 'neutral' END")


def ngrams(w: str, n: int) -> str:
    if n == 1:
        return w
    pairs = f"list_zip({w}[:-2], {w}[2:])"
    if n != 2:
        raise ValueError("orders 1 and 2 only")
    return f"CASE WHEN len({w}) < 2 THEN []::VARCHAR[] ELSE list_transform({pairs}, lambda g: g[1] || ' ' || g[2]) END"


def f_score(p: str, r: str) -> str:
    return f"2.0 * (({p}) * ({r}) / (({p}) + ({r}) + 1e-8))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"


_MODELS_VALUES = ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(MODEL_IDS))

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_view("models", (), f"SELECT * FROM (VALUES {_MODELS_VALUES}) t(model_no, model_id)")

_view("dialogues", (), f"""
SELECT d.doc_id AS dialogue_id,
       CASE d.doc_id % 10 WHEN 8 THEN 'test' WHEN 9 THEN 'valid' ELSE 'training' END AS dataset,
       d.source AS topic, d.text AS dialogue_text,
       array_to_string({words('d.text')}, ' ') AS actual_summary,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
            WHEN l.quality = 0 THEN 'neutral' END AS actual_sentiment,
       d.n_chars, d.lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

_view("dialogues_conv", (), f"""
SELECT conv_id AS dialogue_id,
       string_agg(role || ': ' || text, {NL} ORDER BY turn) AS dialogue_text
FROM conversations GROUP BY conv_id""")

_view("raw_outputs", ("dialogues", "models"), f"""
SELECT d.dialogue_id, m.model_id, m.model_no, d.n_chars,
       d.dialogue_text || {NL} || {NL} ||
       CASE (d.dialogue_id * 31 + d.n_chars * 7 + m.model_no) % 9
         WHEN 0 THEN 'Sentiment: -1' WHEN 1 THEN 'Sentiment: 0' WHEN 2 THEN 'Sentiment: 1'
         WHEN 3 THEN 'Sentiment:' || {NL} || '1'
         WHEN 4 THEN 'Sentiment: ' || {label_word('d.dialogue_id % 3')}
         WHEN 5 THEN 'Sentiment: ' || {label_word('d.dialogue_id % 3')} || ' or '
                     || {label_word('(d.dialogue_id + m.model_no) % 3')}
         WHEN 6 THEN 'Sentiment: 2 it is ' || {label_word('d.dialogue_id % 3')}
         WHEN 7 THEN 'No label given.'
         ELSE 'Sentiment: 10' END AS raw_output
FROM dialogues d CROSS JOIN models m""")

_view("sentiments", ("raw_outputs",), f"""
SELECT dialogue_id, model_id,
       {sentiment_v1('raw_output')} AS generated_sentiment,
       {cost_memory('n_chars', 'model_no', 'dialogue_id')} AS memory_sentiment_usage,
       {cost_time('n_chars', 'model_no')} AS time_sentiment_taken
FROM raw_outputs""")

_view("summary_pairs", ("dialogues", "models"), f"""
SELECT dialogue_id, model_id, actual_summary,
       CASE (dialogue_id + model_no) % 41 WHEN 0 THEN NULL WHEN 1 THEN ''
         ELSE array_to_string(w[cut + 1 :] || w[: cut], ' ') END AS generated_summary,
       {cost_memory('n_chars', 'model_no', 'dialogue_id')} AS memory_summary_usage,
       {cost_time('n_chars', 'model_no')} AS time_summary_taken
FROM (SELECT *, CAST(floor(len(w) * model_no / 10) AS BIGINT) AS cut
      FROM (SELECT d.dialogue_id, d.n_chars, d.actual_summary, m.model_id, m.model_no,
                   [CASE WHEN (i - 1 + d.dialogue_id) % (m.model_no + 3) = 1 THEN x || 's' ELSE x END
                    FOR x, i IN d.w IF (i - 1 + d.dialogue_id) % (m.model_no + 3) <> 0] AS w
            FROM (SELECT *, {words('dialogue_text')} AS w FROM dialogues) d CROSS JOIN models m))""")

_view("summary_words", ("summary_pairs",), f"""
SELECT *, {rouge_words('generated_summary')} AS hw, {rouge_words('actual_summary')} AS rw
FROM summary_pairs""")


def _rouge_n_sql(n: int) -> str:
    return (f"CASE WHEN generated_summary IS NULL OR actual_summary IS NULL OR len(hw) = 0 OR len(rw) = 0 "
            f"THEN NULL ELSE {f_score(ratio(f'o{n}', f'h{n}'), ratio(f'o{n}', f'r{n}'))} END")


# LCS in words of LIMB bits: for each token of the generated text, a mask of
# its places in the reference; v + (v & mask) carries over the limbs.
LIMB = 120

_SUM = "(v[j] + (v[j] & m[j]) + s.c)"
_FULL = f"((1::HUGEINT << {LIMB}) - 1)"


def lcs_views(source: str, masks: str, lengths: str) -> None:
    """LCS lengths of hw and rw of ``source`` (rw is the same for all models)."""
    _view(masks, (source,), f"""
SELECT n.dialogue_id, n.w, list(coalesce(b.mask, 0::HUGEINT) ORDER BY n.limb) AS mask
FROM (SELECT dialogue_id, w, unnest(range(0, (any_value(n) + {LIMB - 1}) // {LIMB})) AS limb
      FROM (SELECT dialogue_id, len(rw) AS n, unnest(rw) AS w FROM {source} WHERE model_id = '{MODEL_IDS[0]}')
      GROUP BY dialogue_id, w) n
LEFT JOIN (SELECT dialogue_id, w, p // {LIMB} AS limb, bit_or(1::HUGEINT << CAST(p % {LIMB} AS INTEGER)) AS mask
           FROM (SELECT dialogue_id, unnest(rw) AS w, unnest(range(0, len(rw))) AS p FROM {source}
                 WHERE model_id = '{MODEL_IDS[0]}')
           GROUP BY ALL) b
ON n.dialogue_id = b.dialogue_id AND n.w = b.w AND n.limb = b.limb
GROUP BY n.dialogue_id, n.w""")

    _view(lengths, (source, masks), f"""
SELECT dialogue_id, model_id,
       n - CAST(list_sum(list_transform(range(1, len(v) + 1), lambda j:
           bit_count(v[j] & CASE WHEN j * {LIMB} <= n THEN {_FULL}
                                 ELSE (1::HUGEINT << CAST(n - (j - 1) * {LIMB} AS INTEGER)) - 1 END))) AS BIGINT) AS lcs
FROM (SELECT dialogue_id, model_id, n, list_reduce(ms, lambda v, m:
        list_reduce(range(1, len(m) + 1), lambda s, j:
          {{'c': {_SUM} >> {LIMB}, 'o': list_append(s.o, ({_SUM} & {_FULL}) | (v[j] - (v[j] & m[j])))}},
          {{'c': 0::HUGEINT, 'o': []::HUGEINT[]}}).o,
        list_transform(range(0, (n + {LIMB - 1}) // {LIMB}), lambda q: {_FULL})) AS v
      FROM (SELECT h.dialogue_id, h.model_id, any_value(h.n) AS n, list(k.mask ORDER BY h.p) AS ms
            FROM (SELECT dialogue_id, model_id, len(rw) AS n, unnest(hw) AS w, unnest(range(0, len(hw))) AS p
                  FROM {source}) h
            JOIN {masks} k ON h.dialogue_id = k.dialogue_id AND h.w = k.w
            GROUP BY h.dialogue_id, h.model_id))""")


lcs_views("summary_words", "ref_masks", "lcs_lengths")

_view("rouge_n", ("summary_words",), f"""
SELECT *, {_rouge_n_sql(1)} AS rouge_1, {_rouge_n_sql(2)} AS rouge_2
FROM (SELECT *, len(g1) AS h1, len(q1) AS r1, len(g1) + len(q1) - len(list_distinct(g1 || q1)) AS o1,
             len(g2) AS h2, len(q2) AS r2, len(g2) + len(q2) - len(list_distinct(g2 || q2)) AS o2
      FROM (SELECT *, list_distinct(hw) AS g1, list_distinct(rw) AS q1,
                   list_distinct({ngrams('hw', 2)}) AS g2, list_distinct({ngrams('rw', 2)}) AS q2
            FROM summary_words))""")

_view("summaries", ("rouge_n", "lcs_lengths"), f"""
SELECT s.dialogue_id, s.model_id, actual_summary, generated_summary,
       memory_summary_usage, time_summary_taken, rouge_1, rouge_2,
       CASE WHEN generated_summary IS NULL OR actual_summary IS NULL OR len(hw) = 0 OR len(rw) = 0
            THEN NULL ELSE {f_score(ratio('coalesce(l.lcs, 0)', 'len(hw)'), ratio('coalesce(l.lcs, 0)', 'len(rw)'))}
       END AS rouge_l
FROM rouge_n s LEFT JOIN lcs_lengths l ON s.dialogue_id = l.dialogue_id AND s.model_id = l.model_id""")


def chunk_list(text: str, limit: int = 1024) -> str:
    fold = (f"list_reduce(string_split({text}, {NL}), lambda acc, p: "
            f"CASE WHEN length(acc.cur) + length(p) < {limit} "
            f"THEN {{'done': acc.done, 'cur': acc.cur || p || {NL}}} "
            f"ELSE {{'done': list_append(acc.done, {strip('acc.cur')}), 'cur': p || {NL}}} END, "
            f"{{'done': []::VARCHAR[], 'cur': ''}})")
    return (f"CASE WHEN length({text}) <= {limit} THEN [{text}] "
            f"ELSE list_append(({fold}).done, {strip(f'({fold}).cur')}) END")


_view("chunk_lists", ("dialogues",), f"""
SELECT dialogue_id, {chunk_list('dialogue_text')} AS c FROM dialogues""")

_view("chunks", ("chunk_lists",), """
SELECT dialogue_id, unnest(range(0, len(c))) AS chunk_no, unnest(c) AS chunk_text FROM chunk_lists""")

_view("chunk_results", ("chunks", "models"), f"""
SELECT c.dialogue_id, m.model_id, c.chunk_no,
       array_to_string({words('c.chunk_text')}, ' ') AS summary,
       CAST(floor(c.dialogue_id / 25) AS BIGINT) AS batch_id,
       {cost_time('length(c.chunk_text)', 'm.model_no')} AS time_taken,
       {cost_memory('length(c.chunk_text)', 'm.model_no', 'c.dialogue_id')} AS memory_usage
FROM chunks c CROSS JOIN models m""")

_view("token_vectors", (), """
SELECT CAST(label AS BIGINT) AS pair_id,
       CASE vec_id % 2 WHEN 0 THEN 'cand' ELSE 'ref' END AS side,
       vec_id AS token_no, embedding AS vector
FROM embeddings""")


def with_views(sql: str, *names: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"


def kde_sql(src: str, keys: list[str], value: str, points: int = 200, cut: float = 3.0) -> str:
    """Gaussian KDE per group (mirror of ``stats.kde``)."""
    k = ", ".join(keys)
    ks = ", ".join(f"s.{x}" for x in keys)
    on = " AND ".join(f"s.{x} = v.{x}" for x in keys)
    z = "((s.g0 + r.i * s.step - v.x) / s.h)"
    return f"""
SELECT {ks}, CAST(r.i AS BIGINT) AS point, round(s.g0 + r.i * s.step, 6) AS x,
       round(sum(v.w * exp(-0.5::DOUBLE * {z} * {z}))
             / (any_value(s.n) * any_value(s.h) * sqrt(2.0::DOUBLE * pi())), 6) AS density
FROM (SELECT {k}, n, h, mn - {cut}::DOUBLE * h AS g0,
             ((mx + {cut}::DOUBLE * h) - (mn - {cut}::DOUBLE * h)) / {points - 1}.0::DOUBLE AS step
      FROM (SELECT {k}, count(*) AS n, stddev_samp({value}) * pow(CAST(count(*) AS DOUBLE), -0.2::DOUBLE) AS h,
                   min({value}) AS mn, max({value}) AS mx
            FROM {src} WHERE {value} IS NOT NULL GROUP BY {k}
            HAVING count(*) >= 2 AND stddev_samp({value}) > 0)) s
JOIN (SELECT {k}, {value} AS x, count(*) AS w FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL) v ON {on}
CROSS JOIN range(0, {points}) r(i)
GROUP BY {ks}, r.i, s.g0, s.step"""
