"""DuckDB CTEs of the classification metrics (mirror of
``parley.operators.classification``)."""

from __future__ import annotations

from parley.plans.oracle_views import _view
from parley.schemas import LABELS

_LABEL_VALUES = ", ".join(f"('{x}')" for x in LABELS)

_view("aligned", ("dialogues", "sentiments"), """
SELECT d.dialogue_id, s.model_id, d.actual_sentiment AS actual, s.generated_sentiment AS predicted
FROM dialogues d JOIN sentiments s ON d.dialogue_id = s.dialogue_id
WHERE d.actual_sentiment IS NOT NULL""")

_view("cells", ("aligned",), f"""
SELECT coalesce(g.model_id, c.model_id) AS model_id, coalesce(g.actual, c.actual) AS actual,
       coalesce(g.predicted, c.predicted) AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT m.model_id, a.l AS actual, p.l AS predicted
      FROM (SELECT DISTINCT model_id FROM aligned) m
      CROSS JOIN (VALUES {_LABEL_VALUES}) a(l) CROSS JOIN (VALUES {_LABEL_VALUES}) p(l)) g
FULL OUTER JOIN (SELECT model_id, actual, predicted, count(*) AS n FROM aligned GROUP BY ALL) c
  ON g.model_id = c.model_id AND g.actual = c.actual AND g.predicted = c.predicted""")

_view("class_stats", ("cells",), """
SELECT model_id, label, tp, support, predicted,
       CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
       CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
       CASE WHEN support + predicted = 0 THEN 0.0
            ELSE (2.0::DOUBLE * tp) / (support + predicted) END AS f1
FROM (SELECT model_id, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support,
             CAST(sum(pred) AS BIGINT) AS predicted
      FROM (SELECT model_id, actual AS label, n AS support,
                   CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, 0 AS pred FROM cells
            UNION ALL
            SELECT model_id, predicted AS label, 0 AS support, 0 AS tp, n AS pred FROM cells)
      WHERE label IS NOT NULL GROUP BY model_id, label)""")

_view("model_metrics", ("cells", "class_stats"), """
SELECT a.model_id, a.n, CAST(a.correct AS DOUBLE) / a.n AS accuracy,
       CASE WHEN f.sup = 0 THEN 0.0 ELSE f.wf / f.sup END AS weighted_f1, f.macro_f1
FROM (SELECT model_id, CAST(sum(n) AS BIGINT) AS n,
             sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS correct
      FROM cells GROUP BY model_id) a
JOIN (SELECT model_id, sum(support * f1) AS wf, sum(support) AS sup,
             avg(CASE WHEN support + predicted > 0 THEN f1 END) AS macro_f1
      FROM class_stats GROUP BY model_id) f ON a.model_id = f.model_id""")
