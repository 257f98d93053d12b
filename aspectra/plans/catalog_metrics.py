"""Catalog: evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions.scoring import sigmoid
from aspectra.operators import metrics, sampling, weights
from aspectra.operators.predictors import CentroidPredictor, ScoreRegexPredictor, ThresholdScorer, polarity_centroids
from aspectra.plans import bridge
from aspectra.plans.catalog_scoring import CENT_CTES, EVEN, FLAGS_CTE, PLONG_CTES
from aspectra.plans.compare import compare_models, prepare_labelled
from aspectra.plans.registry import labels_str, r6, register
from aspectra.plans.sqlbits import B_EPOCHS, B_PROBS, B_REVIEWS, B_SHEET, ENC, LABEL_DIM, LABEL_VALUES, LOGITS, with_
from aspectra.schema import ASPECTS, DRIVER_LEXICON, MAX_EPOCHS, SAMPLE_SEED

BASE = "Baseline: Review Score"
CENTROID = "Baseline: Embedding Centroid"
FT = "Fine-Tuned: ABSA"

# ---------------------------------------------------------------------------
# SQL side: long-form predictions -> metrics
# ---------------------------------------------------------------------------

YT = "CASE i WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3 WHEN 4 THEN y4 WHEN 5 THEN y5 WHEN 6 THEN y6 ELSE y7 END"
FLIP = "CASE WHEN (review_id + 3 * i) % 23 = 0 THEN 1 - yt ELSE yt END"

# b_preds over every retained review: (model, review_id, i, yt, yp)
PREDS_ALL = with_(B_SHEET, ENC) + f"""
, tl AS (SELECT review_id, i, {YT} AS yt FROM enc, range(8) r(i))
, preds AS (SELECT 'flip' AS model, review_id, i, yt, {FLIP} AS yp FROM tl)
"""

# M7: labelled texts -> P1 -> W7 (20 %, seed 42) -> P10 -> three predictors
SPLIT = "CAST(('0x' || substr(md5(CAST(review_id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) / 4294967296.0"
_SIDES = ("CASE WHEN d.doc_id % 3 = 0 THEN 1 WHEN d.lang = 'de' THEN -1 ELSE 0 END",
          "CASE WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN -1 ELSE 0 END",
          "CASE WHEN l.toxic = 0 AND l.quality = 1 THEN 1 WHEN l.toxic = 1 THEN -1 ELSE 0 END",
          "CASE WHEN d.n_chars > 3000 THEN 1 WHEN d.n_chars < 600 THEN -1 ELSE 0 END")
_NO_ASPECT = "NOT (" + " OR ".join(f"tem_{a}" for a in ASPECTS) + ")"
_HAS = "CASE i // 2 " + " ".join(
    f"WHEN {k} THEN tem_{a}" + (f" OR {_NO_ASPECT}" if a == "produto" else "") for k, a in enumerate(ASPECTS)) + " END"
_SIDE = "CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END"
PREDS_M7 = with_(B_REVIEWS, B_PROBS, LABEL_DIM, CENT_CTES) + FLAGS_CTE + PLONG_CTES + f"""
, t AS (SELECT d.doc_id AS review_id, [{', '.join(_SIDES)}] AS sides
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
        WHERE d.doc_id % 17 <> 0 AND {SPLIT.replace('review_id', 'd.doc_id')} < 0.2)
, tl AS (SELECT review_id, i, CASE WHEN sides[i // 2 + 1] = {_SIDE} THEN 1.0 ELSE 0.0 END AS yt FROM t, range(8) r(i))
, pol AS (SELECT review_id, CASE WHEN sim_pos - sim_neg > 0.02 THEN 1 WHEN sim_pos - sim_neg < -0.02 THEN -1 ELSE 0 END AS side
          FROM sims)
, preds AS (
    SELECT '{BASE}' AS model, tl.review_id, i, yt,
           CASE WHEN ({_HAS}) AND (CASE WHEN review_score >= 4 THEN 1 ELSE -1 END) = {_SIDE} THEN 1.0 ELSE 0.0 END AS yp
    FROM tl JOIN fl ON fl.review_id = tl.review_id
    UNION ALL
    SELECT '{CENTROID}' AS model, tl.review_id, i, yt, CASE WHEN ({_HAS}) AND side = {_SIDE} THEN 1.0 ELSE 0.0 END AS yp
    FROM tl JOIN fl ON fl.review_id = tl.review_id JOIN pol ON pol.review_id = tl.review_id
    UNION ALL
    SELECT '{FT}' AS model, tl.review_id, i, yt, CAST(rbit AS DOUBLE) AS yp
    FROM tl JOIN rs ON rs.review_id = tl.review_id AND rs.label_idx = i)
"""

LABELS_SQL = f", lab AS (SELECT label_idx AS i, label FROM (VALUES {LABEL_VALUES}) t(label_idx, label, aspect, polarity, threshold))\n"

METRICS_CTES = LABELS_SQL + """
, conf AS (SELECT model, i, CAST(sum(CASE WHEN yt = 1 AND yp = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                  CAST(sum(CASE WHEN yt = 0 AND yp = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                  CAST(sum(CASE WHEN yt = 1 AND yp = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
                  CAST(sum(CASE WHEN yt = 0 AND yp = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
           FROM preds GROUP BY model, i)
, per AS (SELECT model, i, tp, fp, fn, tn, tp + fn AS support,
                 CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision,
                 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS recall,
                 CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM conf)
, em AS (SELECT model, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS exact_match
         FROM (SELECT model, review_id, bool_and(yt = yp) AS ok FROM preds GROUP BY 1, 2) GROUP BY 1)
, mm AS (SELECT p.model,
                CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0
                     ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END AS f1_micro,
                avg(f1) AS f1_macro,
                CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END AS f1_weighted,
                any_value(em.exact_match) AS exact_match
         FROM per p JOIN em ON p.model = em.model GROUP BY p.model)
"""


def _metric_select(cols: str, where: str = "") -> str:
    return f"SELECT {cols} FROM mm {where}"


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def _preds_all(spark, sf):
    w = bridge.b_preds_wide(spark, sf)
    return w.select(F.lit("flip").alias("model"), "review_id", "y_true", "y_pred")


def _conf_all(spark, sf):
    return metrics.confusion_counts(_preds_all(spark, sf))


def m7_predictors(spark, sf):
    emb = bridge.table(spark, sf, "embeddings")
    return {
        BASE: ScoreRegexPredictor(text="text", score="review_score", lexicon=DRIVER_LEXICON),
        CENTROID: CentroidPredictor(polarity_centroids(emb, F.expr(EVEN)), text="text", lexicon=DRIVER_LEXICON),
        FT: ThresholdScorer("probs"),
    }


def _m7(spark, sf):
    return compare_models(bridge.b_text_sheet(spark, sf), m7_predictors(spark, sf))


@register("confusion_counts", PREDS_ALL + METRICS_CTES + """
SELECT CAST(p.i AS INTEGER) AS label_idx, l.label, tp, fp, fn, tn, CAST(support AS BIGINT) AS support
FROM per p JOIN lab l ON p.i = l.i""")
def q_confusion_counts(spark, sf):
    c = _conf_all(spark, sf)
    return c.select(F.col("label_idx").cast("int").alias("label_idx"), "label", "tp", "fp", "fn", "tn", "support")


@register("f1_micro", PREDS_ALL + METRICS_CTES + _metric_select("round(f1_micro, 6) AS f1_micro"))
def q_f1_micro(spark, sf):
    return metrics.model_metrics(_conf_all(spark, sf)).select(r6("f1_micro").alias("f1_micro"))


@register("f1_macro", PREDS_ALL + METRICS_CTES + _metric_select("round(f1_macro, 6) AS f1_macro"))
def q_f1_macro(spark, sf):
    return metrics.model_metrics(_conf_all(spark, sf)).select(r6("f1_macro").alias("f1_macro"))


@register("f1_weighted", PREDS_ALL + METRICS_CTES + _metric_select("round(f1_weighted, 6) AS f1_weighted"))
def q_f1_weighted(spark, sf):
    return metrics.model_metrics(_conf_all(spark, sf)).select(r6("f1_weighted").alias("f1_weighted"))


@register("exact_match", PREDS_ALL + METRICS_CTES + _metric_select("round(exact_match, 6) AS exact_match"))
def q_exact_match(spark, sf):
    return metrics.model_metrics(_conf_all(spark, sf)).select(r6("exact_match").alias("exact_match"))


@register("per_class_metrics", PREDS_ALL + METRICS_CTES + """
SELECT CAST(p.i AS INTEGER) AS label_idx, l.label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per p JOIN lab l ON p.i = l.i""")
def q_per_class(spark, sf):
    p = metrics.per_class_metrics(_conf_all(spark, sf))
    return p.select(F.col("label_idx").cast("int").alias("label_idx"), "label", r6("precision").alias("precision"),
                    r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


M7_COLS = ("model, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro, "
           "round(f1_weighted, 6) AS f1_weighted, round(exact_match, 6) AS exact_match")


def _m7_out(m):
    return m.select("model", r6("f1_micro").alias("f1_micro"), r6("f1_macro").alias("f1_macro"),
                    r6("f1_weighted").alias("f1_weighted"), r6("exact_match").alias("exact_match"))


@register("compare_models", PREDS_M7 + METRICS_CTES + _metric_select(M7_COLS))
def q_compare_models(spark, sf):
    return _m7_out(_m7(spark, sf).metrics)


@register("round_metrics", PREDS_M7 + METRICS_CTES + _metric_select(
    "model, round_even(f1_micro, 4) AS f1_micro, round_even(f1_macro, 4) AS f1_macro, "
    "round_even(f1_weighted, 4) AS f1_weighted, round_even(exact_match, 4) AS exact_match"))
def q_round_metrics(spark, sf):
    m = _m7(spark, sf).metrics
    return m.select("model", *[F.bround(c, 4).alias(c) for c in ("f1_micro", "f1_macro", "f1_weighted", "exact_match")])


@register("relative_gain", PREDS_M7 + METRICS_CTES + f"""
SELECT b.model AS baseline, '{FT}' AS model,
       round((f.f1_macro - b.f1_macro) / greatest(b.f1_macro, 0.001) * 100.0, 6) AS gain_pct
FROM mm b, (SELECT f1_macro FROM mm WHERE model = '{FT}') f WHERE b.model <> '{FT}'""")
def q_relative_gain(spark, sf):
    g = metrics.relative_gain(_m7(spark, sf).metrics, FT)
    return g.select("baseline", "model", r6("gain_pct").alias("gain_pct"))


@register("chart_feed", PREDS_M7 + METRICS_CTES + f"""
SELECT 'f1_by_model' AS chart, model, name, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS polarity FROM (
  SELECT model, 'f1_micro' AS name, f1_micro AS value FROM mm UNION ALL
  SELECT model, 'f1_macro', f1_macro FROM mm UNION ALL
  SELECT model, 'f1_weighted', f1_weighted FROM mm)
UNION ALL
SELECT 'f1_by_class', p.model, l.label, round(p.f1, 6), CASE WHEN l.label LIKE '%Pos%' THEN 'Pos' ELSE 'Neg' END
FROM per p JOIN lab l ON p.i = l.i WHERE p.model = '{FT}'""")
def q_chart_feed(spark, sf):
    c = _m7(spark, sf)
    out = metrics.chart_feed(c.metrics, c.per_class, FT)
    return out.withColumn("value", r6("value"))


@register("model_comparison", PREDS_M7 + """
SELECT model, CAST(count(DISTINCT review_id) AS BIGINT) AS n_reviews, CAST(sum(yp) AS BIGINT) AS n_pred_bits
FROM preds GROUP BY model""")
def q_model_comparison(spark, sf):
    p = _m7(spark, sf).predictions
    bits = F.aggregate("y_pred", F.lit(0.0), lambda a, x: a + x)
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum(bits).cast("bigint").alias("n_pred_bits"))


@register("align_truth_pred", PREDS_M7 + f"""
SELECT review_id, string_agg(CAST(CAST(yt AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS y_true,
       string_agg(CAST(CAST(yp AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS y_pred
FROM preds WHERE model = '{FT}' GROUP BY review_id""")
def q_align(spark, sf):
    # two separate frames: the truth from the sheet, the predictions from the stored probabilities
    sheet = prepare_labelled(bridge.b_text_sheet(spark, sf))
    _, truth = sampling.train_test_split(sheet.select("review_id", F.col("labels").alias("y_true")), 0.20, "review_id", SAMPLE_SEED)
    pred = ThresholdScorer("probs").transform(bridge.b_probs(spark, sf)).select("review_id", "y_pred")
    a = metrics.align(truth, pred)
    return a.select("review_id", labels_str("y_true").alias("y_true"), labels_str("y_pred").alias("y_pred"))


@register("train_test_split", with_(B_REVIEWS) + f"""
SELECT review_id, CASE WHEN {SPLIT} < 0.15 THEN 'test' ELSE 'train' END AS split FROM b_reviews""")
def q_split(spark, sf):
    # the split as a column (one scan); train_test_split() gives the two frames from the same rule
    r = bridge.b_reviews(spark, sf)
    return r.select("review_id", sampling.split_label("review_id", 0.15).alias("split"))


# ---------------------------------------------------------------------------
# embeddings as model outputs: eval at 0.5 and focal loss
# ---------------------------------------------------------------------------

EMB_LONG = """WITH el AS (
  SELECT review_id, i, logits[i + 1] AS x, CASE WHEN label % 8 = i THEN 1.0 ELSE 0.0 END AS y
  FROM (SELECT vec_id AS review_id, label, """ + LOGITS + """ AS logits FROM embeddings), range(8) r(i))
"""


@register("eval_at_half", EMB_LONG + """
, preds AS (SELECT 'half' AS model, review_id, i, y AS yt,
                   CASE WHEN 1.0 / (1.0 + exp(-x)) > 0.5 THEN 1.0 ELSE 0.0 END AS yp FROM el)
""" + METRICS_CTES + _metric_select("round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro"))
def q_eval_at_half(spark, sf):
    e = bridge.table(spark, sf, "embeddings")
    truth = bridge.label_truth()
    probs = sigmoid(bridge.label_logits())
    pred = F.transform(probs, lambda p: F.when(p > 0.5, 1.0).otherwise(0.0))
    w = e.select(F.lit("half").alias("model"), F.col("vec_id").alias("review_id"),
                 truth.alias("y_true"), pred.alias("y_pred"))
    m = metrics.model_metrics(metrics.confusion_counts(w))
    return m.select(r6("f1_micro").alias("f1_micro"), r6("f1_macro").alias("f1_macro"))


@register("focal_loss", EMB_LONG + """
, cnt AS (SELECT i, sum(y) AS c, count(*) AS n FROM el GROUP BY i)
, raw AS (SELECT i, sqrt(n / (c + 1.0)) AS r FROM cnt)
, alpha AS (SELECT i, r / (SELECT min(r) FROM raw) AS a FROM raw)
, terms AS (SELECT el.i, (greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x))))
                  * pow(1.0 - ((1.0 / (1.0 + exp(-x))) * y + (1.0 - 1.0 / (1.0 + exp(-x))) * (1.0 - y)), 2.0) AS t
            FROM el)
SELECT CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS n_rows,
       round(sum(t * a) / ((SELECT count(*) FROM embeddings) * 8.0), 6) AS focal_loss
FROM terms JOIN alpha USING (i)""")
def q_focal_loss(spark, sf):
    e = bridge.table(spark, sf, "embeddings")
    d = e.select(bridge.label_logits().alias("logits"), bridge.label_truth().alias("targets"))
    return weights.focal_loss(d).select("n_rows", r6("focal_loss").alias("focal_loss"))


# ---------------------------------------------------------------------------
# evaluation log (b_epochs)
# ---------------------------------------------------------------------------


@register("best_epoch", with_(B_EPOCHS) + """
SELECT run, CAST(epoch AS INTEGER) AS best_epoch, f1_macro AS best_f1_macro FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1_macro DESC, epoch) AS rn FROM b_epochs) WHERE rn = 1""")
def q_best_epoch(spark, sf):
    return metrics.best_epoch(bridge.b_epochs(spark, sf))


def _early_stop_sql(rows: str) -> str:
    return with_(B_EPOCHS) + f"""
, log AS (SELECT * FROM b_epochs WHERE {rows})"""+ EARLY_STOP


EARLY_STOP = """
, m AS (SELECT *, coalesce(f1_macro > max(f1_macro) OVER (PARTITION BY run ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM log)
, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS nth FROM m)
, s AS (SELECT *, nth - max(CASE WHEN improved THEN nth END) OVER (PARTITION BY run ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stale FROM k)
SELECT run, CAST(coalesce(min(CASE WHEN stale >= 3 THEN epoch END), max(epoch)) AS INTEGER) AS stop_epoch
FROM s GROUP BY run"""


@register("early_stop_epoch", _early_stop_sql("epoch <= 20"))
def q_early_stop(spark, sf):
    """W13 with the training budget of 20 epochs."""
    return metrics.early_stop_epoch(bridge.b_epochs(spark, sf), max_epochs=MAX_EPOCHS)


@register("early_stop_every_second", _early_stop_sql("epoch % 2 = 0"))
def q_early_stop_second(spark, sf):
    """W13 where only every second epoch was evaluated: patience counts evaluations."""
    return metrics.early_stop_epoch(bridge.b_epochs(spark, sf).filter("epoch % 2 = 0"))


@register("predictor_interface", PREDS_M7 + """
SELECT model, review_id, string_agg(CAST(CAST(yp AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS y_pred
FROM preds GROUP BY model, review_id""")
def q_predictor_interface(spark, sf):
    """M1: every predictor behind the same ``transform(df) -> df + y_pred`` protocol, stacked by model."""
    p = _m7(spark, sf).predictions
    return p.select("model", "review_id", labels_str("y_pred").alias("y_pred"))
