"""Catalog: aspect detection and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions.aspects import aspect_hits, detect_aspects
from aspectra.functions.scoring import (apply_thresholds, computed, cosine_similarity, polarity_from_diff,
                                        resolve_conflicts, score_polarity)
from aspectra.functions.text import join_aspects, truncate_chars
from aspectra.operators import reports
from aspectra.operators.joins import label_dim_join
from aspectra.operators.predictors import (CentroidPredictor, ScoreRegexPredictor, ThresholdScorer,
                                           attach_one_row, class_centroids, polarity_centroids)
from aspectra.plans import bridge
from aspectra.plans.registry import labels_str, r6, register
from aspectra.plans.sqlbits import B_PROBS, B_REVIEWS, LABEL_DIM, rx, with_
from aspectra.schema import ASPECTS, DRIVER_LEXICON, NARROW_DEFAULT

LEX = DRIVER_LEXICON


def _flags_sql(text: str = "review_text") -> str:
    return ", ".join(f"{rx(text, LEX[a])} AS tem_{a}" for a in ASPECTS)


def _aspects_sql(sep: str, default: str | None = None) -> str:
    """Joined aspect names from tem_* flags, in lexicon order."""
    parts = "list_filter([" + ", ".join(f"CASE WHEN tem_{a} THEN '{a}' END" for a in ASPECTS) + "], lambda x: x IS NOT NULL)"
    if default:
        parts = f"CASE WHEN len({parts}) = 0 THEN ['{default}'] ELSE {parts} END"
    return f"array_to_string({parts}, '{sep}')"


FLAGS_CTE = f", fl AS (SELECT review_id, review_text, review_score, {_flags_sql()} FROM b_reviews)\n"
FLAGS = with_(B_REVIEWS) + FLAGS_CTE

# ---------------------------------------------------------------------------
# aspects
# ---------------------------------------------------------------------------


@register("detect_aspects_wide", FLAGS + f"SELECT review_id, {_aspects_sql(',')} AS aspects FROM fl")
def q_detect_wide(spark, sf):
    r = bridge.b_reviews(spark, sf)
    return r.select("review_id", F.array_join(detect_aspects("review_text", LEX), ",").alias("aspects"))


@register("detect_aspects_narrow", FLAGS + f"SELECT review_id, {_aspects_sql(',', 'produto')} AS aspects FROM fl")
def q_detect_narrow(spark, sf):
    r = bridge.b_reviews(spark, sf)
    return r.select("review_id", F.array_join(detect_aspects("review_text", LEX, default=("produto",)), ",")
                    .alias("aspects"))


@register("aspect_flags", FLAGS + "SELECT review_id, " + ", ".join(f"tem_{a}" for a in ASPECTS)
          + ", CAST(" + " + ".join(f"CAST(tem_{a} AS INTEGER)" for a in ASPECTS) + " AS INTEGER) AS num_aspectos FROM fl")
def q_aspect_flags(spark, sf):
    r = bridge.b_reviews(spark, sf).withColumn("aspects", detect_aspects("review_text", LEX))
    return r.select("review_id", *[F.array_contains("aspects", a).alias(f"tem_{a}") for a in ASPECTS],
                    F.size("aspects").alias("num_aspectos"))


@register("join_aspects", FLAGS + f"SELECT review_id, {_aspects_sql(', ')} AS aspectos_detectados FROM fl")
def q_join_aspects(spark, sf):
    r = bridge.b_reviews(spark, sf)
    return r.select("review_id", join_aspects(detect_aspects("review_text", LEX)).alias("aspectos_detectados"))


@register("aspect_coverage", FLAGS + "SELECT aspect_idx, aspect, n, round(n * 100.0 / total, 6) AS pct FROM ("
          + " UNION ALL ".join(f"SELECT {i} AS aspect_idx, '{a}' AS aspect, CAST(count(*) FILTER (WHERE tem_{a}) AS BIGINT) AS n, "
                               f"count(*) AS total FROM fl" for i, a in enumerate(ASPECTS)) + ")")
def q_aspect_coverage(spark, sf):
    c = reports.aspect_coverage(bridge.b_reviews(spark, sf), LEX)
    return c.select(F.col("aspect_idx").cast("int").alias("aspect_idx"), "aspect", "n", r6("pct").alias("pct"))


@register("aspect_presence", FLAGS + "SELECT CAST(count(*) FILTER (WHERE " + " OR ".join(f"tem_{a}" for a in ASPECTS)
          + ") AS BIGINT) AS with_aspect, CAST(count(*) FILTER (WHERE NOT (" + " OR ".join(f"tem_{a}" for a in ASPECTS)
          + ")) AS BIGINT) AS without_aspect FROM fl")
def q_aspect_presence(spark, sf):
    r = bridge.b_reviews(spark, sf).withColumn("aspects", detect_aspects("review_text", LEX))
    return reports.aspect_presence(r)


@register("text_length", with_(B_REVIEWS) + "SELECT review_id, CAST(length(review_text) AS INTEGER) AS text_len FROM b_reviews")
def q_text_length(spark, sf):
    return bridge.b_reviews(spark, sf).select("review_id", F.length("review_text").alias("text_len"))


@register("truncate_chars", with_(B_REVIEWS) + """
SELECT review_id, CAST(length(substring(review_text, 1, 512)) AS INTEGER) AS n_chars,
       md5(substring(review_text, 1, 512)) AS head_md5 FROM b_reviews""")
def q_truncate_chars(spark, sf):
    r = bridge.b_reviews(spark, sf).withColumn("head", truncate_chars("review_text", 512))
    return r.select("review_id", F.length("head").alias("n_chars"), F.md5("head").alias("head_md5"))


@register("score_polarity", with_(B_REVIEWS) + """
SELECT review_id, CASE WHEN coalesce(review_score, 3) >= 4 THEN 'Pos' ELSE 'Neg' END AS polarity FROM b_reviews""")
def q_score_polarity(spark, sf):
    return bridge.b_reviews(spark, sf).select("review_id", score_polarity("review_score").alias("polarity"))


def _x15_sql() -> str:
    bits = []
    for a in ASPECTS:
        has = f"(tem_{a} OR (NOT ({' OR '.join(f'tem_{b}' for b in ASPECTS)}) AND '{a}' = 'produto'))"
        bits.append(f"CASE WHEN {has} AND coalesce(review_score, 3) >= 4 THEN '1' ELSE '0' END")
        bits.append(f"CASE WHEN {has} AND coalesce(review_score, 3) < 4 THEN '1' ELSE '0' END")
    return "concat_ws(',', " + ", ".join(bits) + ")"


@register("baseline_score_regex", FLAGS + f"SELECT review_id, {_x15_sql()} AS y_pred FROM fl")
def q_baseline_score_regex(spark, sf):
    r = bridge.b_reviews(spark, sf)
    p = ScoreRegexPredictor(text="review_text", lexicon=LEX).transform(r)
    return p.select("review_id", labels_str("y_pred").alias("y_pred"))


# ---------------------------------------------------------------------------
# thresholds, conflicts, ranking (on b_probs)
# ---------------------------------------------------------------------------

PLONG_CTES = """
, pl AS (SELECT p.review_id, d.label_idx, d.label, p.probs[d.label_idx + 1] AS p,
                coalesce(d.threshold, 0.5) AS threshold
         FROM b_probs p, label_dim d)
, b AS (SELECT *, CASE WHEN p > threshold THEN 1 ELSE 0 END AS bit FROM pl)
, rs AS (SELECT *, CASE
           WHEN nb = 2 AND label_idx % 2 = 0 AND NOT (ppos > pneg) THEN 0
           WHEN nb = 2 AND label_idx % 2 = 1 AND ppos > pneg THEN 0 ELSE bit END AS rbit
         FROM (SELECT *, sum(bit) OVER w AS nb,
                      max(CASE WHEN label_idx % 2 = 0 THEN p END) OVER w AS ppos,
                      max(CASE WHEN label_idx % 2 = 1 THEN p END) OVER w AS pneg
               FROM b WINDOW w AS (PARTITION BY review_id, label_idx // 2)))
, ranked AS (SELECT review_id, label_idx, label, p,
                    row_number() OVER (PARTITION BY review_id ORDER BY p DESC, label_idx) AS rk
             FROM rs WHERE rbit = 1)
, nodet AS (SELECT review_id FROM b_probs EXCEPT SELECT review_id FROM ranked)
, top3 AS (SELECT * FROM (SELECT pl.*, row_number() OVER (PARTITION BY pl.review_id ORDER BY p DESC, label_idx) AS rk
                          FROM pl SEMI JOIN nodet ON pl.review_id = nodet.review_id) WHERE rk <= 3)
"""
PLONG = with_(B_PROBS, LABEL_DIM) + PLONG_CTES


def _scored(spark, sf, resolve=True):
    return ThresholdScorer("probs", resolve=resolve).transform(bridge.b_probs(spark, sf))


@register("sigmoid", with_(B_PROBS) + "SELECT review_id, " + ", ".join(
    f"round(probs[{i + 1}], 6) AS p{i}" for i in range(8)) + " FROM b_probs")
def q_sigmoid(spark, sf):
    p = bridge.b_probs(spark, sf)
    return p.select("review_id", *[r6(F.get("probs", i)).alias(f"p{i}") for i in range(8)])


@register("apply_thresholds", PLONG + """
SELECT review_id, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY label_idx) AS bits,
       CAST(sum(bit) AS INTEGER) AS n_bits FROM b GROUP BY review_id""")
def q_apply_thresholds(spark, sf):
    p = computed(bridge.b_probs(spark, sf), bits=apply_thresholds("probs"))
    return p.select("review_id", labels_str("bits").alias("bits"),
                    sum((F.get("bits", i) for i in range(8)), F.lit(0.0)).cast("int").alias("n_bits"))


@register("resolve_conflict", PLONG + """
SELECT review_id, string_agg(CAST(rbit AS VARCHAR), ',' ORDER BY label_idx) AS bits FROM rs GROUP BY review_id""")
def q_resolve_conflict(spark, sf):
    p = computed(bridge.b_probs(spark, sf), bits=apply_thresholds("probs"))
    return p.select("review_id", labels_str(resolve_conflicts("bits", "probs")).alias("bits"))


@register("rank_detected_labels", PLONG + """
SELECT review_id, CAST(rk AS INTEGER) AS rank, label, round(p, 6) AS score FROM ranked""")
def q_rank_detected(spark, sf):
    s = _scored(spark, sf)
    e = s.select("review_id", F.posexplode("detected").alias("pos", "d"))
    return e.select("review_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("d.label").alias("label"),
                    r6("d.score").alias("score"))


@register("top3_fallback", PLONG + """
SELECT review_id, CAST(rk AS INTEGER) AS rank, label, round(p, 6) AS score, threshold FROM top3""")
def q_top3_fallback(spark, sf):
    s = _scored(spark, sf).filter(F.col("fallback").isNotNull())
    e = s.select("review_id", F.posexplode("fallback").alias("pos", "d"))
    return e.select("review_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("d.label").alias("label"),
                    r6("d.score").alias("score"), F.col("d.threshold").alias("threshold"))


@register("score_batch", PLONG + """
SELECT p.review_id, CAST(coalesce(d.n, 0) AS INTEGER) AS n_detected, coalesce(d.labels, '') AS detected,
       coalesce(t.labels, '') AS fallback
FROM b_probs p
LEFT JOIN (SELECT review_id, count(*) AS n, string_agg(label, ',' ORDER BY rk) AS labels FROM ranked GROUP BY 1) d
  ON p.review_id = d.review_id
LEFT JOIN (SELECT review_id, string_agg(label, ',' ORDER BY rk) AS labels FROM top3 GROUP BY 1) t
  ON p.review_id = t.review_id""")
def q_score_batch(spark, sf):
    s = _scored(spark, sf)
    return s.select("review_id", F.size("detected").cast("int").alias("n_detected"),
                    F.array_join(F.col("detected")["label"], ",").alias("detected"),
                    F.coalesce(F.array_join(F.col("fallback")["label"], ","), F.lit(""))
                    .alias("fallback"))


@register("score_batch_unresolved", PLONG + """
, ranked_u AS (SELECT review_id, label_idx, label, p,
                      row_number() OVER (PARTITION BY review_id ORDER BY p DESC, label_idx) AS rk
               FROM b WHERE bit = 1)
, nodet_u AS (SELECT review_id FROM b_probs EXCEPT SELECT review_id FROM ranked_u)
, top3_u AS (SELECT * FROM (SELECT pl.*, row_number() OVER (PARTITION BY pl.review_id ORDER BY p DESC, label_idx) AS rk
                            FROM pl SEMI JOIN nodet_u ON pl.review_id = nodet_u.review_id) WHERE rk <= 3)
SELECT p.review_id, CAST(coalesce(d.n, 0) AS INTEGER) AS n_detected, coalesce(d.labels, '') AS detected,
       coalesce(t.labels, '') AS fallback
FROM b_probs p
LEFT JOIN (SELECT review_id, count(*) AS n, string_agg(label, ',' ORDER BY rk) AS labels FROM ranked_u GROUP BY 1) d
  ON p.review_id = d.review_id
LEFT JOIN (SELECT review_id, string_agg(label, ',' ORDER BY rk) AS labels FROM top3_u GROUP BY 1) t
  ON p.review_id = t.review_id""")
def q_score_batch_unresolved(spark, sf):
    """M3 with conflict resolution switched off: both polarities of an aspect may be reported."""
    s = _scored(spark, sf, resolve=False)
    return s.select("review_id", F.size("detected").cast("int").alias("n_detected"),
                    F.array_join(F.col("detected")["label"], ",").alias("detected"),
                    F.coalesce(F.array_join(F.col("fallback")["label"], ","), F.lit(""))
                    .alias("fallback"))


@register("label_dim_join", PLONG + """
SELECT review_id, CAST(label_idx AS INTEGER) AS label_idx, label, threshold, p > threshold AS passed FROM pl""")
def q_label_dim_join(spark, sf):
    p = bridge.b_probs(spark, sf).select("review_id", F.posexplode("probs").alias("label_idx", "p"))
    j = label_dim_join(p)
    return j.select("review_id", F.col("label_idx").cast("int").alias("label_idx"), "label", "threshold",
                    (~F.isnan("p") & (F.col("p") > F.col("threshold"))).alias("passed"))


# ---------------------------------------------------------------------------
# embeddings: centroids, cosine, dead-band, centroid predictor
# ---------------------------------------------------------------------------

CENT_CTES = """dims AS (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS v
              FROM (SELECT label, vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))
, cen AS (SELECT label, i, avg(v) AS m FROM dims GROUP BY label, i)
, pvec AS (SELECT pos, list(m ORDER BY i) AS centroid
           FROM (SELECT label % 2 = 0 AS pos, i, avg(v) AS m FROM dims GROUP BY 1, 2) GROUP BY pos)
, sims AS (SELECT e.vec_id AS review_id,
                  list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT centroid FROM pvec WHERE pos)) AS sim_pos,
                  list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT centroid FROM pvec WHERE NOT pos)) AS sim_neg
           FROM embeddings e)
"""
CENT = "WITH " + CENT_CTES


#: all classes: even ones are the positive reference, odd ones the negative
EVEN = "label % 2 = 0"


@register("class_centroid", CENT + "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(m, 6) AS value FROM cen")
def q_class_centroid(spark, sf):
    c = class_centroids(bridge.table(spark, sf, "embeddings"))
    e = c.select("label", F.posexplode("centroid").alias("dim", "value"))
    return e.select("label", F.col("dim").cast("int").alias("dim"), r6("value").alias("value"))


def _sims(spark, sf):
    emb = bridge.table(spark, sf, "embeddings")
    cents = polarity_centroids(emb, F.expr(EVEN))
    d = attach_one_row(emb, cents)
    return d.select(F.col("vec_id").alias("review_id"), "embedding",
                    cosine_similarity("embedding", "c_pos").alias("sim_pos"),
                    cosine_similarity("embedding", "c_neg").alias("sim_neg"))


@register("cosine_similarity", CENT + "SELECT review_id, round(sim_pos, 6) AS sim_pos, round(sim_neg, 6) AS sim_neg FROM sims")
def q_cosine(spark, sf):
    return _sims(spark, sf).select("review_id", r6("sim_pos").alias("sim_pos"), r6("sim_neg").alias("sim_neg"))


@register("polarity_deadband", CENT + """
SELECT review_id, CASE WHEN sim_pos - sim_neg > 0.02 THEN 'Pos' WHEN sim_pos - sim_neg < -0.02 THEN 'Neg' END AS polarity
FROM sims""")
def q_deadband(spark, sf):
    s = _sims(spark, sf)
    return s.select("review_id", polarity_from_diff(F.col("sim_pos") - F.col("sim_neg")).alias("polarity"))


def _m2_sql() -> str:
    any_hit = " OR ".join(f"tem_{a}" for a in ASPECTS)
    bits = []
    for a in ASPECTS:
        has = f"(tem_{a} OR (NOT ({any_hit}) AND '{a}' = 'produto'))"
        bits.append(f"CASE WHEN {has} AND pol = 'Pos' THEN '1' ELSE '0' END")
        bits.append(f"CASE WHEN {has} AND pol = 'Neg' THEN '1' ELSE '0' END")
    return (CENT + f""", m AS (SELECT s.review_id, {', '.join(f"{rx('d.text', LEX[a])} AS tem_{a}" for a in ASPECTS)},
       CASE WHEN sim_pos - sim_neg > 0.02 THEN 'Pos' WHEN sim_pos - sim_neg < -0.02 THEN 'Neg' END AS pol,
       sim_pos IS NULL OR sim_neg IS NULL AS failed
  FROM sims s LEFT JOIN documents d ON d.doc_id = s.review_id)
SELECT review_id, concat_ws(',', {', '.join(bits)}) AS y_pred, failed FROM m""")


def _m2(spark, sf):
    emb = bridge.table(spark, sf, "embeddings")
    docs = bridge.table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), detect_aspects("text", LEX, default=NARROW_DEFAULT).alias("aspects"))
    df = emb.join(docs, "vec_id", "left")
    pred = CentroidPredictor(polarity_centroids(emb, F.expr(EVEN)), lexicon=LEX, aspects="aspects")
    return pred.transform(df)


@register("embedding_centroid_predict", _m2_sql())
def q_m2(spark, sf):
    p = _m2(spark, sf)
    return p.select(F.col("vec_id").alias("review_id"), labels_str("y_pred").alias("y_pred"), "failed")


@register("safe_predict", _m2_sql().rsplit("SELECT review_id", 1)[0] + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS n_failed FROM m""")
def q_safe_predict(spark, sf):
    p = _m2(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("failed").alias("n_failed"))


__all__ = ["aspect_hits"]
