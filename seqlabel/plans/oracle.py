"""DuckDB forms of the stand-in views, for the oracle SQL of each query.

The oracle SQL strings are independent re-statements of the same results in
plain SQL; they are only run by the correctness check, never by the library.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..constants import COMPARTMENTS, NUM_RUNS

SEQ_V = """seq_v AS (
  SELECT d.doc_id AS id, upper(regexp_replace(d.text,'[^A-Za-z]','','g')) AS sequence, d.lang, d.source,
    (d.lang='en')::INT AS en, (d.lang='de')::INT AS de, (d.lang='es')::INT AS es, (d.lang='fr')::INT AS fr,
    l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)"""

REF_V = """ref_v AS (
  SELECT item_id AS id, upper(regexp_replace(text,'[^A-Za-z]','','g')) AS sequence FROM benchmark)"""

PRED_V = f"""pred_v AS (
  SELECT r.run::INT AS run, vec_id AS id,
    list_transform(list_slice(embedding, r.run*10+1, r.run*10+10), lambda x: x::DOUBLE*10) AS logits,
    list_transform(range(10), lambda j: (label=j OR (vec_id%3=0 AND (label+1)%10=j))::INT) AS targets
  FROM embeddings, range({NUM_RUNS}) r(run))"""

POS_V = """pos_v AS (
  SELECT vec_id // 16 AS key, vec_id % 16 AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS vec,
    vec_id % 16 < 4 + (vec_id // 16) % 13 AS mask FROM embeddings)"""

SERIES_V = """series_v AS (SELECT user_id AS key, ts, event_id, value FROM events)"""


def labels_values(labels: Sequence[str] = COMPARTMENTS, name: str = "lab") -> str:
    """``lab(label_idx, label)`` as a VALUES table built from the label list."""
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) t(label_idx, label))"


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


# Long form of pred_v: one row per (run, id, label) with probability and both label decisions.
PRED_CELLS = """cells AS (
  SELECT p.run, p.id, l.label_idx, l.label, p.targets[l.label_idx+1] AS y, p.logits[l.label_idx+1] AS z,
    1/(1+exp(-p.logits[l.label_idx+1])) AS p
  FROM pred_v p, lab l),
cells2 AS (
  SELECT *, (p >= 0.5 AND NOT isnan(p))::INT AS yhat,
    (CASE WHEN isnan(p) THEN 0 WHEN p = 0.5 THEN 0 ELSE round(p) END)::INT AS yrnd,
    greatest(z, 0) - z*y + ln(1 + exp(-abs(z))) AS bce
  FROM cells)"""

CONFUSION_BY = """conf AS (
  SELECT {by} label_idx, label,
    count_if(y=1 AND yhat=1) AS tp, count_if(y=0 AND yhat=1) AS fp,
    count_if(y=1 AND yhat=0) AS fn, count_if(y=0 AND yhat=0) AS tn,
    count(y) AS n, count_if(y IS NULL) AS n_null, count_if(y = yrnd) AS n_eq_round, sum(bce) AS bce_sum
  FROM {src} GROUP BY {by} label_idx, label)"""

REPORT = """rep AS (
  SELECT {by} label_idx, label, tp, fp, fn, tn,
    coalesce(tp::DOUBLE/nullif(tp+fp,0), 0) AS precision,
    coalesce(tp::DOUBLE/nullif(tp+fn,0), 0) AS recall,
    coalesce(2.0*tp/nullif(2*tp+fp+fn,0), 0) AS f1,
    (tp+fn)::BIGINT AS support,
    coalesce((tp::DOUBLE*tn - fp::DOUBLE*fn)/nullif(sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)),0), 0) AS mcc
  FROM conf)"""


def md5_rank(src: str, seed: int, id_col: str = "id", partition: str = "", name: str = "rk",
             extra_cols: str = "*") -> str:
    """Oracle for the bucketed global rank: row_number over md5('seed:id')."""
    part = f"PARTITION BY {partition} " if partition else ""
    return (f"{name} AS (SELECT {extra_cols}, row_number() OVER ({part}ORDER BY md5('{seed}:' || {id_col}), {id_col}) AS rank "
            f"FROM {src})")
