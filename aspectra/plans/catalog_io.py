"""Catalog: sources, sinks, joins and label-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions.labels import (LABEL_STATE_TYPE, category_key, label_polarity, label_variant,
                                       restore_sentiment, variant_field)
from aspectra.functions.text import display_name, format_percent
from aspectra.operators import clean, joins, reports
from aspectra.plans import bridge
from aspectra.plans.registry import labels_str, r6, register
from aspectra.plans.sqlbits import B_REVIEWS, B_SHEET, ENC, LABEL_DIM, norm, with_
from aspectra.session import scratch_path
from aspectra.sources import io

SENT = ("logistica_sentimento", "produto_sentimento", "atendimento_sentimento", "preco_sentimento")

EXPORT = """WITH ex AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS review_id, coalesce(d.text, '') AS review_text, '' AS logistica_sentimento,
         coalesce(CASE l.quality WHEN 1 THEN 'Positivo' WHEN 0 THEN 'Negativo' END, '') AS produto_sentimento,
         coalesce(CASE WHEN l.toxic = 1 THEN 'Negativo' END, '') AS atendimento_sentimento, '' AS preco_sentimento,
         CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'Sim' ELSE 'Não' END AS to_remove
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def _export(spark, sf):
    return joins.export_join(bridge.b_reviews(spark, sf), bridge.b_label_state(spark, sf))


@register("export_join", EXPORT + "SELECT * FROM ex")
def q_export_join(spark, sf):
    return _export(spark, sf)


@register("export_labels_csv", EXPORT + """
SELECT review_id, review_id || ',"' || replace(review_text, '"', '""') || '",' || logistica_sentimento || ','
       || produto_sentimento || ',' || atendimento_sentimento || ',' || preco_sentimento || ',' || to_remove AS line
FROM ex""")
def q_export_csv(spark, sf):
    e = _export(spark, sf)
    return e.select("review_id", io.export_line().alias("line"))


@register("export_labels_json", EXPORT + """
SELECT review_id, CAST(to_json(struct_pack(review_id := review_id, review_text := review_text,
    logistica_sentimento := logistica_sentimento, produto_sentimento := produto_sentimento,
    atendimento_sentimento := atendimento_sentimento, preco_sentimento := preco_sentimento,
    to_remove := to_remove)) AS VARCHAR) AS json FROM ex""")
def q_export_json(spark, sf):
    e = _export(spark, sf)
    return e.select("review_id", io.export_json(e).alias("json"))


@register("read_label_sheet", EXPORT + """
SELECT review_id, md5(review_text) AS text_md5, nullif(logistica_sentimento, '') AS logistica_sentimento,
       nullif(produto_sentimento, '') AS produto_sentimento, nullif(atendimento_sentimento, '') AS atendimento_sentimento,
       nullif(preco_sentimento, '') AS preco_sentimento, to_remove FROM ex""")
def q_read_label_sheet(spark, sf):
    """S1/S6 round trip: export the sheet as CSV, read it back with the multi-line reader."""
    path = scratch_path(spark, "export-csv")
    io.write_export_csv(_export(spark, sf), path)
    df = io.read_label_sheet(spark, path, io.SHEET_SCHEMA)
    return df.select("review_id", F.md5("review_text").alias("text_md5"), *SENT, "to_remove")


@register("read_reviews", with_(B_REVIEWS) + """
SELECT review_id, review_score, CAST(length(review_text) AS INTEGER) AS text_len FROM b_reviews""")
def q_read_reviews(spark, sf):
    d = io.read_reviews(spark, f"{sf}/documents.parquet", fmt="parquet")
    return d.select(F.col("doc_id").alias("review_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("review_score"),
                    F.length("text").alias("text_len"))


@register("source_fallback", "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM documents")
def q_source_fallback(spark, sf):
    d = io.read_reviews(spark, [f"{sf}/no_such_reviews.parquet", f"{sf}/documents.parquet"], fmt="parquet")
    return d.agg(F.count(F.lit(1)).alias("n_rows"))


@register("normalize_columns", with_(B_REVIEWS) + """
SELECT review_id, md5(review_text) AS text_md5, '0,0,0,0,0,0,0,0' AS labels FROM b_reviews""")
def q_normalize_columns(spark, sf):
    from aspectra.functions.labels import encode_labels

    raw = bridge.b_reviews(spark, sf).withColumnRenamed("review_text", "review_comment_message")
    n = clean.normalize_columns(raw)
    return n.select("review_id", F.md5("review_text").alias("text_md5"),
                    labels_str(encode_labels(n.columns)).alias("labels"))


def _m7_sql():
    from aspectra.plans.catalog_metrics import M7_COLS, METRICS_CTES, PREDS_M7, _metric_select

    return PREDS_M7 + METRICS_CTES + _metric_select(M7_COLS)


def _sheet_csv_sql():
    from aspectra.plans.catalog_sampling import _sheet_sql

    # an empty field and an empty quoted field both read back as null (the CSV convention of the sheet)
    empty_ok = ["aspectos_detectados", *SENT]
    cols = ", ".join(f"nullif({c}, '') AS {c}" for c in empty_ok)
    return _sheet_sql() + f"SELECT * EXCLUDE ({', '.join(empty_ok)}), {cols} FROM sheet"


@register("write_metrics", _m7_sql())
def q_write_metrics(spark, sf):
    """Model comparison written as CSV and read back."""
    from aspectra.plans.catalog_metrics import _m7, _m7_out

    path = scratch_path(spark, "metrics-csv")
    io.write_metrics(_m7_out(_m7(spark, sf).metrics), path)
    schema = "model string, f1_micro double, f1_macro double, f1_weighted double, exact_match double"
    return spark.read.option("header", True).schema(schema).csv(path)


@register("write_sheet_csv", _sheet_csv_sql())
def q_write_sheet_csv(spark, sf):
    """Labelling sheet written as CSV and read back with the multi-line reader."""
    from aspectra.plans.catalog_sampling import _sample

    path = scratch_path(spark, "sheet-csv")
    io.write_sheet_csv(_sample(spark, sf).sheet, path)
    cols = [("review_id", "long"), ("review_score", "int"), ("review_text", "string"),
            ("aspectos_detectados", "string"), *[(c, "string") for c in SENT], ("to_remove", "string"),
            ("row_index", "int")]
    return io.read_label_sheet(spark, path, ", ".join(f"{n} {t}" for n, t in cols))


@register("labelling_feed", with_(B_REVIEWS) + """
SELECT id, index, CAST(to_json(struct_pack(id := id, text := text, index := index)) AS VARCHAR) AS json FROM (
  SELECT CAST(review_id AS VARCHAR) AS id, coalesce(review_text, '') AS text,
         row_number() OVER (ORDER BY review_id) - 1 AS index FROM b_reviews)""")
def q_labelling_feed(spark, sf):
    return io.labelling_feed(bridge.b_reviews(spark, sf))


@register("row_index", with_(B_REVIEWS) + """
SELECT review_id, row_number() OVER (ORDER BY review_id) - 1 AS index FROM b_reviews""")
def q_row_index(spark, sf):
    r = bridge.b_reviews(spark, sf).select("review_id")
    return io.row_index(r, ["review_id"], "index")


@register("row_index_file_order", "SELECT doc_id AS review_id, row_number() OVER () - 1 AS index FROM documents")
def q_row_index_file_order(spark, sf):
    """W15 as the feed reads its source: positions in file order, without a sort."""
    return io.file_row_index(bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id")))


@register("attach_scores", with_(B_REVIEWS) + """
SELECT l.doc_id AS review_id, l.quality, l.toxic, s.review_score
FROM labels l LEFT JOIN (SELECT DISTINCT review_id, review_score FROM b_reviews) s ON s.review_id = l.doc_id""")
def q_attach_scores(spark, sf):
    lab = bridge.table(spark, sf, "labels").withColumnRenamed("doc_id", "review_id")
    scores = bridge.b_reviews(spark, sf).select("review_id", "review_score")
    return joins.attach_scores(lab, scores).select("review_id", "quality", "toxic", "review_score")


@register("labelled_progress", """
SELECT CAST(n AS BIGINT) AS labelled, CAST(t AS BIGINT) AS total, least(n * 100.0 / t, 100.0) AS pct FROM (
  SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS n,
         (SELECT count(*) FROM documents) AS t)""")
def q_labelled_progress(spark, sf):
    lab = bridge.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    docs = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"))
    return joins.labelled_progress(lab, docs).withColumn("pct", r6("pct"))


# ---------------------------------------------------------------------------
# display and label-state helpers
# ---------------------------------------------------------------------------


@register("display_name", with_(B_SHEET, ENC) + """
SELECT sentiment_column, upper(replace(sentiment_column, '_sentimento', '')) AS display, value,
       CAST(count(*) AS BIGINT) AS n FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS sentiment_column, regexp_replace(coalesce({c}, '(vazio)'), '^\\s+|\\s+$', '', 'g') AS value FROM enc"
    for c in SENT) + ") GROUP BY 1, 3")
def q_display_name(spark, sf):
    d = reports.sentiment_distribution(clean.drop_removed(bridge.b_sheet(spark, sf)))
    return d.select("sentiment_column", display_name("sentiment_column").alias("display"), "value", "n")


CLASS_SHARE_SQL = with_(B_SHEET, ENC) + """
, c AS (SELECT i AS label_idx, sum(CASE i WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3 WHEN 4 THEN y4
               WHEN 5 THEN y5 WHEN 6 THEN y6 ELSE y7 END) * 100.0 / count(*) AS pct FROM enc, range(8) r(i) GROUP BY i)
"""


@register("bar_text", CLASS_SHARE_SQL + """
SELECT CAST(label_idx AS INTEGER) AS label_idx, repeat('█', CAST(floor(pct) AS INTEGER)) AS bar,
       repeat('█', CAST(floor(pct / 2) AS INTEGER)) AS half_bar FROM c""")
def q_bar_text(spark, sf):
    from aspectra.functions.text import bar_text

    c = reports.class_counts(bridge.encoded_sheet(spark, sf))
    return c.select(F.col("label_idx").cast("int").alias("label_idx"), bar_text("pct", 1.0).alias("bar"),
                    bar_text("pct", 2.0).alias("half_bar"))


@register("format_percent", CLASS_SHARE_SQL + """
SELECT CAST(label_idx AS INTEGER) AS label_idx, printf('%.1f%%', pct) AS pct_text FROM c""")
def q_format_percent(spark, sf):
    c = reports.class_counts(bridge.encoded_sheet(spark, sf))
    return c.select(F.col("label_idx").cast("int").alias("label_idx"), format_percent(F.col("pct") / 100.0).alias("pct_text"))


@register("label_polarity", """
WITH """ + LABEL_DIM + """
SELECT CASE WHEN d.label LIKE '%\\_Pos' ESCAPE '\\' THEN 'Pos' ELSE 'Neg' END AS polarity, CAST(count(*) AS BIGINT) AS n
FROM embeddings e JOIN label_dim d ON d.label_idx = e.label % 8 GROUP BY 1""")
def q_label_polarity(spark, sf):
    from aspectra.schema import label_dimension

    e = bridge.table(spark, sf, "embeddings").select((F.col("label") % 8).alias("label_idx"))
    j = e.join(F.broadcast(label_dimension(spark).select("label_idx", "label")), "label_idx")
    return j.groupBy(label_polarity("label").alias("polarity")).agg(F.count(F.lit(1)).alias("n"))


@register("parse_label_json", """
SELECT CAST(count(*) AS BIGINT) AS n_parsed, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k
FROM events""")
def q_parse_label_json(spark, sf):
    ev = bridge.table(spark, sf, "events")
    m = F.from_json("props", "map<string,bigint>")
    return ev.agg(F.count_if(m.isNotNull()).alias("n_parsed"), F.sum(F.element_at(m, F.lit("k"))).cast("bigint").alias("sum_k"))


@register("label_state_json", with_(B_SHEET) + """
SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(""" + " + ".join(
    f"CASE WHEN {norm(c)} IN ('positivo', 'negativo', 'neutro') THEN 1 ELSE 0 END" for c in SENT) + """ AS INTEGER) AS n_categories,
       coalesce(""" + norm("to_remove") + """ = 'sim', false) AS to_remove FROM b_sheet""")
def q_label_state_json(spark, sf):
    """X20 round trip: label state -> JSON -> parsed back."""
    st = reports.label_state(bridge.b_sheet(spark, sf))
    js = st.select("review_id", F.to_json("state").alias("json"))
    back = js.select("review_id", F.from_json("json", LABEL_STATE_TYPE).alias("s"))
    return back.select("review_id", F.size(F.map_keys("s.categories")).alias("n_categories"),
                       F.col("s.toRemove").alias("to_remove"))


_VARIANT_EXTRA = "CAST(review_id % 7 AS INTEGER)"


@register("label_state_variant", with_(B_SHEET) + f"""
SELECT CAST(review_id AS VARCHAR) AS review_id, {_VARIANT_EXTRA} AS annotator,
       CASE WHEN review_id % 5 = 0 THEN 'Positivo' END AS entrega,
       CASE WHEN {norm(SENT[1])} IN ('positivo', 'negativo', 'neutro')
            THEN upper(substr({norm(SENT[1])}, 1, 1)) || substr({norm(SENT[1])}, 2) END AS produto,
       coalesce({norm("to_remove")} = 'sim', false) AS to_remove FROM b_sheet""")
def q_label_state_variant(spark, sf):
    """X20 with keys that no schema names: the stored JSON kept as VARIANT, written, read and asked by path."""
    sheet = bridge.b_sheet(spark, sf)
    st = reports.label_state(sheet.select("*"))
    extra = F.struct((F.col("review_id").cast("long") % 7).cast("int").alias("annotator"),
                     F.when(F.col("review_id").cast("long") % 5 == 0, F.struct(F.lit("Positivo").alias("Entrega"))).alias("new"))
    js = st.select("review_id", F.to_json(F.struct(F.col("state.categories").alias("categories"), F.col("state.toRemove").alias("toRemove"),
                                                   extra.alias("more"))).alias("json"))
    path = scratch_path(spark, "label-variant")
    js.select("review_id", label_variant("json").alias("state")).write.parquet(path)
    v = spark.read.parquet(path)
    return v.select("review_id", variant_field("state", "$.more.annotator", "int").alias("annotator"),
                    variant_field("state", "$.more.new.Entrega", "string").alias("entrega"),
                    variant_field("state", "$.categories.Produto", "string").alias("produto"),
                    variant_field("state", "$.toRemove", "boolean").alias("to_remove"))


@register("category_map_lookup", with_(B_SHEET) + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT CAST(review_id AS VARCHAR) AS review_id, '{name}' AS category, '{key}' AS aspect,
        {norm(c)} AS sentiment FROM b_sheet WHERE {norm(c)} IN ('positivo', 'negativo', 'neutro')"""
    for key, name, c in (("logistica", "Logística", SENT[0]), ("produto", "Produto", SENT[1]),
                         ("atendimento", "Atendimento", SENT[2]), ("preco", "Preço", SENT[3]))) + ")")
def q_category_map_lookup(spark, sf):
    st = reports.label_state(bridge.b_sheet(spark, sf))
    e = st.select("review_id", F.explode("state.categories").alias("category", "stored"))
    return e.select("review_id", "category", category_key("category").alias("aspect"),
                    restore_sentiment("stored").alias("sentiment"))
