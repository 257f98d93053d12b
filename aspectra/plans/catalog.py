"""Query catalog: one registered query per operator, each with its DuckDB oracle.

Every query reads whole driver tables through the bridge views.  Arrays are
flattened and doubles rounded to 6 places before results leave a query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions.text import normalise_label
from aspectra.operators import clean, reports, weights
from aspectra.plans import bridge
from aspectra.plans.registry import labels_str, r6, register
from aspectra.plans.sqlbits import (B_REVIEWS, B_SHEET, ENC, ENC_LONG, LABEL_DIM, SENT, norm, with_)

Y_STR = "concat_ws(',', " + ", ".join(f"CAST(CAST(y{i} AS INTEGER) AS VARCHAR)" for i in range(8)) + ")"

# ---------------------------------------------------------------------------
# P: projections and filters
# ---------------------------------------------------------------------------


@register("drop_removed", with_(B_SHEET) + f"""
SELECT review_id, to_remove FROM b_sheet WHERE {norm('to_remove')} IS DISTINCT FROM 'sim'""")
def q_drop_removed(spark, sf):
    return clean.drop_removed(bridge.b_sheet(spark, sf)).select("review_id", "to_remove")


@register("require_text", with_(B_REVIEWS) + """
SELECT review_id FROM b_reviews WHERE review_text IS NOT NULL""")
def q_require_text(spark, sf):
    return clean.require_text(bridge.b_reviews(spark, sf)).select("review_id")


@register("min_text_length", with_(B_REVIEWS) + """
SELECT review_id, CAST(length(review_text) AS INTEGER) AS text_len FROM b_reviews
WHERE review_text IS NOT NULL AND length(review_text) >= 20""")
def q_min_text_length(spark, sf):
    df = clean.min_text_length(clean.require_text(bridge.b_reviews(spark, sf)))
    return df.select("review_id", F.length("review_text").alias("text_len"))


@register("drop_unlabelled", with_(B_SHEET, ENC) + f"""
SELECT review_id FROM enc WHERE NOT ({' AND '.join(c + ' IS NULL' for c in SENT)})""")
def q_drop_unlabelled(spark, sf):
    return clean.drop_unlabelled(clean.drop_removed(bridge.b_sheet(spark, sf))).select("review_id")


@register("score_band_filter", with_(B_REVIEWS) + """
SELECT review_id, review_score,
       CASE WHEN review_score IN (1, 2) THEN 'neg' ELSE 'pos' END AS band
FROM b_reviews WHERE review_score IN (1, 2, 4, 5)""")
def q_score_band_filter(spark, sf):
    # both bands in one scan: the band expression routes each row (3 and missing fall in neither)
    r = bridge.b_reviews(spark, sf)
    return (r.select("review_id", "review_score", clean.score_band("review_score").alias("band"))
            .filter(F.col("band").isNotNull()))


@register("score_equals", with_(B_REVIEWS) + """
SELECT review_score, CAST(count(*) AS BIGINT) AS n, CAST(sum(review_id) AS BIGINT) AS id_sum
FROM b_reviews GROUP BY review_score""")
def q_score_equals(spark, sf):
    """P6 for every score 1..5 in one scan: rows are routed to their score by a grouped aggregate."""
    r = bridge.b_reviews(spark, sf)
    return (clean.score_in(r, range(1, 6)).groupBy("review_score")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("review_id").cast("bigint").alias("id_sum")))


@register("fill_missing_score", with_(B_SHEET, "b_scores AS (SELECT o_orderkey AS review_id, "
                                      "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 5 + 1 AS INTEGER) END "
                                      "AS review_score FROM orders)") + """
SELECT review_score, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CAST(coalesce(review_score, 3) AS INTEGER) AS review_score FROM b_scores) GROUP BY 1""")
def q_fill_missing_score(spark, sf):
    o = bridge.table(spark, sf, "orders")
    s = o.select(F.col("o_orderkey").alias("review_id"),
                 F.when(F.col("o_custkey") % 7 == 0, F.lit(None).cast("int"))
                  .otherwise((F.col("o_custkey") % 5 + 1).cast("int")).alias("review_score"))
    return reports.score_histogram(clean.fill_missing_score(s))


@register("fill_missing_label", with_(B_SHEET) + """
SELECT review_id, coalesce(logistica_sentimento, '(vazio)') AS logistica_sentimento,
       coalesce(produto_sentimento, '(vazio)') AS produto_sentimento,
       coalesce(atendimento_sentimento, '') AS atendimento_sentimento,
       coalesce(preco_sentimento, '') AS preco_sentimento FROM b_sheet""")
def q_fill_missing_label(spark, sf):
    s = bridge.b_sheet(spark, sf).drop("to_remove")
    s = clean.fill_missing_label(s, cols=["logistica_sentimento", "produto_sentimento"], display=True)
    return clean.fill_missing_label(s, cols=["atendimento_sentimento", "preco_sentimento"], display=False)


@register("null_text_to_empty", with_(B_REVIEWS) + """
SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(length(coalesce(review_text, '')) AS INTEGER) AS text_len,
       md5(coalesce(review_text, '')) AS text_md5 FROM b_reviews""")
def q_null_text_to_empty(spark, sf):
    df = clean.null_text_to_empty_cols(bridge.b_reviews(spark, sf))
    return df.select("review_id", F.length("review_text").alias("text_len"), F.md5("review_text").alias("text_md5"))


@register("rename_text", with_(B_REVIEWS) + """
SELECT review_id, md5(review_text) AS text_md5 FROM b_reviews""")
def q_rename_text(spark, sf):
    df = clean.rename_text(bridge.b_reviews(spark, sf), "text")
    return df.select("review_id", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------------------
# X4/X5 and the label reports
# ---------------------------------------------------------------------------


@register("normalise_label", with_(B_SHEET) + "SELECT review_id, " + ", ".join(
    f"{norm(c)} AS {c}" for c in SENT + ("to_remove",)) + " FROM b_sheet")
def q_normalise_label(spark, sf):
    s = bridge.b_sheet(spark, sf)
    return s.select("review_id", *[normalise_label(c).alias(c) for c in SENT + ("to_remove",)])


@register("encode_labels", with_(B_SHEET, ENC) + f"SELECT review_id, {Y_STR} AS labels FROM enc")
def q_encode_labels(spark, sf):
    return bridge.encoded_sheet(spark, sf).select("review_id", labels_str("labels").alias("labels"))


CLASS_COUNTS_BODY = """
SELECT d.label_idx, d.label, CAST(coalesce(sum(e.y_true), 0) AS BIGINT) AS n
FROM label_dim d LEFT JOIN enc_long e ON e.label_idx = d.label_idx
GROUP BY d.label_idx, d.label"""
CLASS_COUNTS_SQL = with_(B_SHEET, ENC, ENC_LONG, LABEL_DIM) + CLASS_COUNTS_BODY


@register("class_counts", CLASS_COUNTS_SQL)
def q_class_counts(spark, sf):
    return reports.class_counts(bridge.encoded_sheet(spark, sf)).select("label_idx", "label", "n")


@register("class_share", with_(B_SHEET, ENC, ENC_LONG, LABEL_DIM) + """
SELECT label_idx, label, n, round(pct, 6) AS pct, repeat('█', CAST(floor(pct) AS INTEGER)) AS bar FROM (
  SELECT d.label_idx, d.label, CAST(coalesce(sum(e.y_true), 0) AS BIGINT) AS n,
         coalesce(sum(e.y_true), 0) * 100.0 / (SELECT count(*) FROM enc) AS pct
  FROM label_dim d LEFT JOIN enc_long e ON e.label_idx = d.label_idx GROUP BY d.label_idx, d.label)""")
def q_class_share(spark, sf):
    c = reports.class_counts(bridge.encoded_sheet(spark, sf))
    return c.select("label_idx", "label", "n", r6("pct").alias("pct"), "bar")


@register("total_labels", with_(B_SHEET, ENC) + """
SELECT CAST(sum(y0 + y1 + y2 + y3 + y4 + y5 + y6 + y7) AS BIGINT) AS total_labels FROM enc""")
def q_total_labels(spark, sf):
    return reports.total_labels(bridge.encoded_sheet(spark, sf))


@register("imbalance_report", with_(B_SHEET, ENC, ENC_LONG, LABEL_DIM) + """
, c AS (""" + CLASS_COUNTS_BODY + """)
SELECT max_count, min_positive, round(ratio, 6) AS ratio, tier, advice, n_zero_classes FROM (
  SELECT max_count, min_positive, n_zero_classes, max_count * 1.0 / min_positive AS ratio,
    CASE WHEN min_positive IS NULL THEN 'alert' WHEN max_count * 1.0 / min_positive > 10 THEN 'severe'
         WHEN max_count * 1.0 / min_positive > 5 THEN 'moderate' ELSE 'ok' END AS tier,
    CASE WHEN min_positive IS NULL THEN 'classes with 0 examples'
         WHEN max_count * 1.0 / min_positive > 10 THEN 'class weights + focal loss'
         WHEN max_count * 1.0 / min_positive > 5 THEN 'class weights' ELSE '' END AS advice
  FROM (SELECT max(n) AS max_count, min(CASE WHEN n > 0 THEN n END) AS min_positive,
               CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS n_zero_classes FROM c))""")
def q_imbalance_report(spark, sf):
    c = reports.class_counts(bridge.encoded_sheet(spark, sf))
    return reports.imbalance_report(c).withColumn("ratio", r6("ratio"))


@register("unlabelled_count", with_(B_SHEET, ENC) + f"""
SELECT CAST(count(*) FILTER (WHERE {' AND '.join(c + ' IS NULL' for c in SENT)}) AS BIGINT) AS unlabelled FROM enc""")
def q_unlabelled_count(spark, sf):
    return reports.unlabelled_count(clean.drop_removed(bridge.b_sheet(spark, sf)))


@register("flag_value_counts", with_(B_SHEET) + f"""
SELECT {norm('to_remove')} AS value, CAST(count(*) AS BIGINT) AS n FROM b_sheet
WHERE to_remove IS NOT NULL GROUP BY 1""")
def q_flag_value_counts(spark, sf):
    return reports.flag_value_counts(bridge.b_sheet(spark, sf))


@register("sentiment_distribution", with_(B_SHEET, ENC) + """
SELECT sentiment_column, value, n, round(pct, 6) AS pct, repeat('█', CAST(floor(pct / 2) AS INTEGER)) AS bar FROM (
  SELECT sentiment_column, value, CAST(count(*) AS BIGINT) AS n,
         count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY sentiment_column) AS pct
  FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS sentiment_column, regexp_replace(coalesce({c}, '(vazio)'), '^\\s+|\\s+$', '', 'g') AS value FROM enc"
    for c in SENT) + ") GROUP BY 1, 2)")
def q_sentiment_distribution(spark, sf):
    s = clean.drop_removed(bridge.b_sheet(spark, sf))
    return reports.sentiment_distribution(s).withColumn("pct", r6("pct"))


@register("class_weights", with_(B_SHEET, ENC, ENC_LONG, LABEL_DIM) + f"""
, tr AS (SELECT * FROM enc WHERE NOT ({' AND '.join(c + ' IS NULL' for c in SENT)}))
, tl AS (SELECT e.* FROM enc_long e SEMI JOIN tr ON e.review_id = tr.review_id)
, c AS (SELECT d.label_idx, d.label, coalesce(sum(tl.y_true), 0) AS n
        FROM label_dim d LEFT JOIN tl ON tl.label_idx = d.label_idx GROUP BY 1, 2)
, w AS (SELECT label_idx, label, n, sqrt((SELECT count(*) FROM tr) / (n + 1.0)) AS raw FROM c)
SELECT label_idx, label, CAST(n AS BIGINT) AS n, round(raw / min(raw) OVER (), 6) AS weight FROM w""")
def q_class_weights(spark, sf):
    tr = clean.drop_unlabelled(bridge.encoded_sheet(spark, sf))
    w = weights.class_weights(tr)
    return w.select("label_idx", "label", "n", r6("weight").alias("weight"))


@register("funnel_counts", with_(B_REVIEWS) + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(review_text) AS BIGINT) AS with_text,
       CAST(count(*) FILTER (WHERE length(review_text) >= 20) AS BIGINT) AS min_length FROM b_reviews""")
def q_funnel_counts(spark, sf):
    return reports.funnel_counts(bridge.b_reviews(spark, sf))


@register("score_histogram", with_(B_REVIEWS) + """
SELECT review_score, CAST(count(*) AS BIGINT) AS n FROM b_reviews GROUP BY 1""")
def q_score_histogram(spark, sf):
    return reports.score_histogram(bridge.b_reviews(spark, sf))


@register("category_count", with_(B_SHEET) + "SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(" + " + ".join(
    f"CASE WHEN {norm(c)} IN ('positivo', 'negativo', 'neutro') THEN 1 ELSE 0 END" for c in SENT)
    + " AS INTEGER) AS n_categories FROM b_sheet")
def q_category_count(spark, sf):
    return reports.category_count(reports.label_state(bridge.b_sheet(spark, sf)))


@register("fixed_label_order", with_(B_SHEET, ENC, ENC_LONG, LABEL_DIM) + """
SELECT label_idx, label, n, CAST(row_number() OVER (ORDER BY label_idx) - 1 AS INTEGER) AS position
FROM (""" + CLASS_COUNTS_BODY + """) WHERE n > 0""")
def q_fixed_label_order(spark, sf):
    c = reports.class_counts(bridge.encoded_sheet(spark, sf))
    return reports.present_labels(c).select("label_idx", "label", "n", "position")


@register("project_training", """
SELECT d.doc_id AS review_id, d.text,
       CAST(l.quality AS VARCHAR) || ',' || CAST(l.toxic AS VARCHAR) AS labels
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_project_training(spark, sf):
    d = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    lab = bridge.table(spark, sf, "labels").select(
        F.col("doc_id").alias("review_id"), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("labels"))
    p = clean.project_training(d.join(lab, "review_id"))
    return p.select("review_id", "text", labels_str("labels").alias("labels"))
