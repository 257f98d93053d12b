"""Catalog: operators on rows that reach all their behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions.aspects import aspect_flag, detect_aspects, detect_aspects_narrow
from aspectra.functions.labels import encode_labels
from aspectra.functions.text import percent_cell, text_length
from aspectra.operators import clean, joins, reports, sampling
from aspectra.operators.predictors import CentroidPredictor, polarity_centroids
from aspectra.plans import bridge
from aspectra.plans.catalog_io import CLASS_SHARE_SQL
from aspectra.plans.catalog_sampling import SAMPLE, _sample
from aspectra.plans.catalog_scoring import EVEN, LEX, _m2_sql
from aspectra.plans.registry import labels_str, register
from aspectra.plans.sqlbits import B_REVIEWS, B_SHEET, md5key, norm, rx, with_
from aspectra.schema import ASPECTS, NARROW_DEFAULT, NARROW_LEXICON

_NARROW = "list_filter([" + ", ".join(f"CASE WHEN {rx('review_text', NARROW_LEXICON[a])} THEN '{a}' END"
                                      for a in NARROW_LEXICON) + "], lambda x: x IS NOT NULL)"


@register("detect_aspects_workflow", with_(B_REVIEWS) + f"""
SELECT review_id, array_to_string(CASE WHEN len(a) = 0 THEN ['produto'] ELSE a END, ',') AS aspects
FROM (SELECT review_id, {_NARROW} AS a FROM b_reviews)""")
def q_detect_workflow(spark, sf):
    """X2 with the workflow's own narrow lexicon and default."""
    r = bridge.b_reviews(spark, sf)
    return r.select("review_id", F.array_join(detect_aspects_narrow("review_text", NARROW_LEXICON), ",").alias("aspects"))


@register("aspect_flag_columns", with_(B_REVIEWS) + "SELECT review_id, CAST(length(review_text) AS INTEGER) AS text_len, " + ", ".join(
    f"{rx('review_text', LEX[a])} AS tem_{a}" for a in ASPECTS) + " FROM b_reviews")
def q_aspect_flag_columns(spark, sf):
    """X3 and X6 as the sampling step attaches them."""
    r = bridge.b_reviews(spark, sf).withColumn("aspects", detect_aspects("review_text", LEX))
    return r.select("review_id", text_length("review_text").alias("text_len"), *[aspect_flag("aspects", a).alias(f"tem_{a}") for a in ASPECTS])


@register("train_test_split_exact", with_(B_REVIEWS) + f"""
SELECT review_id, CASE WHEN row_number() OVER (ORDER BY {md5key('review_id', 42)}, review_id)
                            <= ceil((SELECT count(*) FROM b_reviews) * 0.15) THEN 'test' ELSE 'train' END AS split FROM b_reviews""")
def q_split_exact(spark, sf):
    """W7 with the exact size: ids are unique here, so exactly ``ceil(n * 0.15)`` rows are held out."""
    train, test = sampling.train_test_split(bridge.b_reviews(spark, sf).select("review_id"), 0.15, exact=True)
    return train.withColumn("split", F.lit("train")).union(test.withColumn("split", F.lit("test")))


@register("score_band_negative", with_(B_REVIEWS) + "SELECT review_id, review_score FROM b_reviews WHERE review_score IN (1, 2)")
def q_band_negative(spark, sf):
    """P5: one band."""
    return clean.score_band_filter(bridge.b_reviews(spark, sf).select("review_id", "review_score"), "neg")


@register("score_equals_five", with_(B_REVIEWS) + "SELECT review_id, review_score FROM b_reviews WHERE review_score = 5")
def q_score_five(spark, sf):
    """One score."""
    return clean.score_equals(bridge.b_reviews(spark, sf).select("review_id", "review_score"), 5)


@register("percent_cells", CLASS_SHARE_SQL + """
SELECT CAST(label_idx AS INTEGER) AS label_idx, lpad(printf('%.1f%%', pct), 8, ' ') AS cell FROM c""")
def q_percent_cells(spark, sf):
    """X18 in the report's columns of fixed width."""
    c = reports.class_counts(bridge.encoded_sheet(spark, sf))
    return c.select(F.col("label_idx").cast("int").alias("label_idx"), percent_cell(F.col("pct") / 100.0, 8).alias("cell"))


@register("dedupe_repeated_ids", SAMPLE + """
SELECT review_id, CAST(step AS INTEGER) AS step, review_score FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY step, band NULLS FIRST, review_score, rk) AS nth FROM (
    SELECT * FROM allr UNION ALL SELECT review_id, review_score % 5 + 1, band, 6 - step, rk FROM allr)) WHERE nth = 1""")
def q_dedupe_repeated(spark, sf):
    """W4 where every id comes twice, with another score and from another step: the first step's row stays."""
    s = _sample(spark, sf)
    once = sampling.concat_samples([s.quota, s.fill]).select("review_id", "review_score", "band", "sample_rank", "step")
    again = once.withColumn("review_score", (F.col("review_score") % 5 + 1).cast("int")).withColumn("step", F.lit(6) - F.col("step"))
    out = sampling.dedupe_by_id(once.unionByName(again))
    return out.select("review_id", F.col("step").cast("int").alias("step"), F.col("review_score").cast("int").alias("review_score"))


@register("attach_scores_fanout", with_(B_REVIEWS) + """
SELECT l.doc_id AS review_id, l.quality, s.review_score FROM labels l LEFT JOIN (
  SELECT review_id, review_score FROM b_reviews WHERE review_id % 4 <> 0 UNION
  SELECT review_id, review_score % 5 + 1 FROM b_reviews WHERE review_id % 3 = 0) s ON s.review_id = l.doc_id""")
def q_attach_fanout(spark, sf):
    """J1 where ids have two scores (a row for each), the same score twice (one row) or none (null)."""
    lab = bridge.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), "quality")
    r = bridge.b_reviews(spark, sf).select("review_id", "review_score")
    some = r.filter("review_id % 4 <> 0")
    other = r.filter("review_id % 3 = 0").withColumn("review_score", (F.col("review_score") % 5 + 1).cast("int"))
    return joins.attach_scores(lab, some.union(some).union(other))


@register("safe_predict_vectors", _m2_sql().rsplit("SELECT review_id", 1)[0] + """
SELECT review_id, CASE WHEN bad THEN '0,0,0,0,0,0,0,0' ELSE y_pred END AS y_pred, bad AS failed FROM (
  SELECT *, review_id % 7 = 0 OR review_id % 11 = 0 AS bad FROM (SELECT review_id, """ + _m2_sql().rsplit("SELECT review_id, ", 1)[1].replace(
    ", failed FROM m", " FROM m))"))
def q_safe_vectors(spark, sf):
    """Short vectors and missing ones give zeros and ``failed``."""
    emb = bridge.table(spark, sf, "embeddings")
    docs = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), detect_aspects("text", LEX, default=NARROW_DEFAULT).alias("aspects"))
    broken = emb.withColumn("embedding", F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(
        F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    p = CentroidPredictor(polarity_centroids(emb, F.expr(EVEN)), lexicon=LEX, aspects="aspects").transform(broken.join(docs, "vec_id", "left"))
    return p.select(F.col("vec_id").alias("review_id"), labels_str("y_pred").alias("y_pred"), "failed")


def _half_sheet_sql() -> str:
    bit = lambda c, word: f"CASE WHEN {norm(c)} = '{word}' THEN '1' ELSE '0' END"
    bits = [bit(c, w) for c in ("logistica_sentimento", "produto_sentimento") for w in ("positivo", "negativo")]
    return (with_(B_SHEET) + "SELECT review_id, md5(CAST(review_id AS VARCHAR)) AS text_md5, concat_ws(',', "
            + ", ".join(bits) + ", '0', '0', '0', '0') AS labels FROM b_sheet")


@register("normalize_half_sheet", _half_sheet_sql())
def q_normalize_half(spark, sf):
    """S8 with two of the four sentiment columns and the text under its alias: the absent ones count as empty."""
    half = bridge.b_sheet(spark, sf).select("review_id", "logistica_sentimento", "produto_sentimento",
                                            F.col("review_id").cast("string").alias("review_comment_message"))
    n = clean.normalize_columns(half)
    return n.select("review_id", F.md5("review_text").alias("text_md5"), labels_str(encode_labels(n.columns)).alias("labels"))
