"""DuckDB SQL fragments for the oracle side of the query catalog.

The bridge views are inlined as CTEs so each oracle runs on the raw driver tables.
"""

from __future__ import annotations

from aspectra.functions.aspects import re2_pattern
from aspectra.schema import label_rows


def norm(c: str) -> str:
    """strip (whitespace) + lower, as X4."""
    return rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


def md5key(id_expr: str, seed) -> str:
    return f"md5(CAST({id_expr} AS VARCHAR) || '|' || CAST({seed} AS VARCHAR))"


def rx(text: str, tokens: list[str]) -> str:
    pat = re2_pattern(tokens).replace("'", "''")
    return f"coalesce(regexp_matches({text}, '{pat}'), false)"


B_REVIEWS = """b_reviews AS (
  SELECT doc_id AS review_id, text AS review_text, lang,
         CAST(doc_id % 5 + 1 AS INTEGER) AS review_score
  FROM documents)"""

B_SHEET = """b_sheet AS (
  SELECT o_orderkey AS review_id,
    CASE o_orderstatus WHEN 'F' THEN 'Positivo' WHEN 'P' THEN 'Negativo' END AS logistica_sentimento,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Positivo' WHEN '2' THEN ' negativo '
         WHEN '3' THEN 'Neutro' END AS produto_sentimento,
    CASE WHEN o_totalprice > 450000 THEN 'Positivo' WHEN o_totalprice < 30000 THEN 'Negativo' END
      AS atendimento_sentimento,
    CASE month(o_orderdate) WHEN 1 THEN 'Positivo' WHEN 7 THEN 'Negativo' END AS preco_sentimento,
    CASE WHEN o_orderkey % 17 = 0 THEN ' Sim' WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'Não' END
      AS to_remove
  FROM orders)"""

B_SCORES = """b_scores AS (
  SELECT o_orderkey AS review_id, CAST(o_custkey % 5 + 1 AS INTEGER) AS review_score FROM orders)"""

SENT = ("logistica_sentimento", "produto_sentimento", "atendimento_sentimento", "preco_sentimento")


def _bits(prefix: str = "") -> str:
    out = []
    for k, c in enumerate(SENT):
        out.append(f"CASE WHEN {norm(prefix + c)} = 'positivo' THEN 1.0 ELSE 0.0 END AS y{2 * k}")
        out.append(f"CASE WHEN {norm(prefix + c)} = 'negativo' THEN 1.0 ELSE 0.0 END AS y{2 * k + 1}")
    return ",\n    ".join(out)


# encoded sheet after P1: review_id, the 4 sentiments, y0..y7
ENC = f"""enc AS (
  SELECT review_id, {', '.join(SENT)}, to_remove,
    {_bits()}
  FROM b_sheet WHERE {norm('to_remove')} IS DISTINCT FROM 'sim')"""

# long form of the encoded sheet: (review_id, label_idx, y_true)
ENC_LONG = """enc_long AS (
  SELECT review_id, i AS label_idx,
         CASE i WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3
                WHEN 4 THEN y4 WHEN 5 THEN y5 WHEN 6 THEN y6 ELSE y7 END AS y_true
  FROM enc, range(8) r(i))"""

LABEL_VALUES = ", ".join(f"({i}, '{label}', '{aspect}', '{polarity}', {'NULL' if threshold is None else threshold})"
                         for i, label, aspect, polarity, threshold in label_rows())
LABEL_DIM = f"""label_dim AS (
  SELECT label_idx, label, aspect, polarity, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES {LABEL_VALUES})
    t(label_idx, label, aspect, polarity, threshold))"""

# logit i of a vector: its components d (from 0) with d mod 8 = i
LOGITS = "[" + ", ".join(f"coalesce(list_sum([CAST(x AS DOUBLE) FOR x, d IN embedding IF (d - 1) % 8 = {i}]), 0.0) * 4.0 - 1.7"
                         for i in range(8)) + "]"
B_PROBS = f"""b_probs AS (
  SELECT vec_id AS review_id, list_transform({LOGITS}, lambda x: 1.0 / (1.0 + exp(-x))) AS probs FROM embeddings)"""

B_EPOCHS = """b_epochs AS (
  SELECT run, CAST(dense_rank() OVER (PARTITION BY run ORDER BY day) AS INTEGER) AS epoch, f1_macro
  FROM (SELECT event_type AS run, CAST(ts AS DATE) AS day, round(avg(value) / 100.0, 6) AS f1_macro
        FROM events GROUP BY 1, 2))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
