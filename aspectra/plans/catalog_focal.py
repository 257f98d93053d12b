"""Catalog: training on the focal loss with selection by F1, the saved model in batch and stream, and as a compared model."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions.labels import encode_labels
from aspectra.operators import clean, focal, sampling
from aspectra.operators.focal import FocalModel, FocalPredictor, dense_features, hashed_words, train_focal
from aspectra.operators.predictors import CentroidPredictor, ScoreRegexPredictor, polarity_centroids
from aspectra.plans import bridge
from aspectra.plans.catalog_metrics import BASE, CENTROID, FT, METRICS_CTES, PREDS_M7, SPLIT, _metric_select
from aspectra.plans.catalog_scoring import EVEN
from aspectra.plans.compare import compare_models
from aspectra.plans.registry import r6, register
from aspectra.schema import DEFAULT_SCHEMA, DRIVER_LEXICON
from aspectra.session import drop_path, scratch_path
from aspectra.streaming import scoring as stream

LABELS = ["quality", "toxic"]
#: plain gradient steps over all rows, so that SQL can take the same steps
RATE, EPOCHS, PATIENCE = 2.0, 6, 2


def text_numbers(text: str = "text") -> F.Column:
    """Two numbers of a text as features: characters and spaces, both bounded."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return dense_features(F.array(F.least(F.length(t) / 2000.0, F.lit(3.0)), F.least(spaces / 300.0, F.lit(3.0))))


TEXT_NUMBERS = ("[least(length(coalesce(text, '')) / 2000.0, 3.0), "
                "least((length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', ''))) / 300.0, 3.0)]")


def focal_ctes(rows: str, k: int, d: int = 2) -> str:
    """CTEs of the training over ``fr (review_id, held, x, y)``: ``flog`` and the weights ``fw`` of the best epoch."""
    n = d + 1
    out = [f"fr AS MATERIALIZED ({rows})",
           f"flong AS MATERIALIZED (SELECT review_id, held, CAST(j AS INTEGER) AS j, y[j + 1] AS y, list_append(x, 1.0) AS x FROM fr, range({k}) r(j))",
           "fraw AS (SELECT j, sqrt(count(*) / (sum(y) + 1.0)) AS r FROM flong WHERE NOT held GROUP BY j)",
           "falpha AS MATERIALIZED (SELECT j, r / (SELECT min(r) FROM fraw) AS a FROM fraw)",
           f"fw0 AS (SELECT CAST(j AS INTEGER) AS j, [{', '.join(['CAST(0 AS DOUBLE)'] * n)}] AS w FROM range({k}) r(j))"]
    for e in range(1, EPOCHS + 1):
        out.append(f"""fg{e} AS MATERIALIZED (
  SELECT j, count(*) AS n, sum(a * pow(1 - p, 2) * -ln(p)) AS loss, [{', '.join(f'sum(s * x[{i + 1}])' for i in range(n))}] AS g
  FROM (SELECT *, side * a * (2 * pow(1 - p, 2) * p * ln(p) - pow(1 - p, 3)) AS s
        FROM (SELECT *, 1.0 / (1.0 + exp(-side * list_dot_product(x, w))) AS p
              FROM (SELECT flong.*, w, a, CASE WHEN y > 0.5 THEN 1.0 ELSE -1.0 END AS side
                    FROM flong JOIN fw{e - 1} USING (j) JOIN falpha USING (j) WHERE NOT held)))
  GROUP BY j)""")
        out.append(f"fw{e} AS MATERIALIZED (SELECT j, [{', '.join(f'w[{i + 1}] - {RATE} * g[{i + 1}] / (n * {k})' for i in range(n))}] AS w "
                   f"FROM fw{e - 1} JOIN fg{e} USING (j))")
        out.append(f"""fv{e} AS (
  SELECT j, sum(CASE WHEN said AND y > 0.5 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN said AND y <= 0.5 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN NOT said AND y > 0.5 THEN 1 ELSE 0 END) AS fn
  FROM (SELECT j, y, list_dot_product(x, w) > 0 AS said FROM flong JOIN fw{e} USING (j) WHERE held) GROUP BY j)""")
    f1 = lambda a, b, c: f"CASE WHEN 2 * {a} + {b} + {c} = 0 THEN 0.0 ELSE 2.0 * {a} / (2 * {a} + {b} + {c}) END"
    every = " UNION ALL ".join(
        f"SELECT {e} AS epoch, (SELECT sum(loss) / (any_value(n) * {k}) FROM fg{e}) AS train_loss, {f1('sum(tp)', 'sum(fp)', 'sum(fn)')} AS f1_micro, "
        f"avg({f1('tp', 'fp', 'fn')}) AS f1_macro FROM fv{e}" for e in range(1, EPOCHS + 1))
    out.append(f"fall AS MATERIALIZED ({every})")
    out.append("""fmark AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS stale FROM (
  SELECT *, coalesce(f1_macro > max(f1_macro) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM fall))""")
    out.append(f"flog AS (SELECT * FROM fall WHERE epoch <= coalesce((SELECT min(epoch) FROM fmark WHERE stale >= {PATIENCE}), {EPOCHS}))")
    out.append("fbest AS (SELECT arg_max(epoch, (f1_macro, -epoch)) AS best FROM flog)")
    out.append("fw AS (" + " UNION ALL ".join(f"SELECT j, w FROM fw{e} WHERE (SELECT best FROM fbest) = {e}" for e in range(1, EPOCHS + 1)) + ")")
    return ",\n".join(out)


DOC_ROWS = (f"SELECT d.doc_id AS review_id, {SPLIT.replace('review_id', 'd.doc_id')} < 0.15 AS held, {TEXT_NUMBERS} AS x, "
            "[CAST(l.quality AS DOUBLE), CAST(l.toxic AS DOUBLE)] AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
DOC_SCORES = "WITH " + focal_ctes(DOC_ROWS, 2) + f"""
SELECT review_id, max(CASE WHEN j = 0 THEN p END) AS p_quality, max(CASE WHEN j = 1 THEN p END) AS p_toxic FROM (
  SELECT doc_id AS review_id, j, round(1.0 / (1.0 + exp(-list_dot_product(list_append({TEXT_NUMBERS}, 1.0), w))), 6) AS p FROM documents, fw)
GROUP BY review_id"""


def _fit_documents(spark, sf) -> focal.FocalFit:
    # the numbers are taken before the join, so that texts are not shuffled
    d = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), text_numbers().alias("numbers"))
    rows = d.join(bridge.table(spark, sf, "labels").withColumnRenamed("doc_id", "review_id"), "review_id")
    train, held = sampling.train_test_split(rows, 0.15)
    return train_focal(train, held, LABELS, F.col("numbers"), n_features=2, steps=1, rate=RATE, max_epochs=EPOCHS,
                       patience=PATIENCE, idf=False, adam=False)


def _stored(spark, fit: focal.FocalFit) -> FocalModel:
    """The model, saved and read again."""
    path = scratch_path(spark, "focal-model")
    fit.model.save(spark, path)
    model = FocalModel.load(spark, path)
    drop_path(spark, path)
    return model


@register("focal_training_log", "WITH " + focal_ctes(DOC_ROWS, 2) + """
SELECT CAST(epoch AS INTEGER) AS epoch, round(train_loss, 6) AS train_loss, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro,
       epoch = best AS best FROM flog, fbest""")
def q_focal_log(spark, sf):
    """M6 with A21, W12 and W13: the epochs of a training on the focal loss, up to the one where patience ended it."""
    fit = _fit_documents(spark, sf)
    return fit.log.select("epoch", r6("train_loss").alias("train_loss"), r6("f1_micro").alias("f1_micro"),
                          r6("f1_macro").alias("f1_macro"), (F.col("epoch") == fit.best_epoch).alias("best"))


def _doc_probabilities(df, model):
    p = df.withColumn("_p", model.probabilities(text_numbers()))
    return p.select(F.col("doc_id").alias("review_id"), *[r6(F.get("_p", j)).alias(f"p_{c}") for j, c in enumerate(LABELS)])


@register("score_saved_model", DOC_SCORES)
def q_score_saved(spark, sf):
    """All documents scored by the best model of the training, after it was saved and read again."""
    return _doc_probabilities(bridge.table(spark, sf, "documents"), _stored(spark, _fit_documents(spark, sf)))


@register("stream_score_saved_model", DOC_SCORES)
def q_stream_score_saved(spark, sf):
    """The same for a stream of documents, read back from the sink."""
    model = _stored(spark, _fit_documents(spark, sf))
    src = f"{sf}/documents.parquet"
    sink, ckpt = scratch_path(spark, "stream-focal"), scratch_path(spark, "stream-focal-ckpt")
    stream.stream_score(spark, src, spark.read.parquet(src).schema, lambda df: _doc_probabilities(df, model), sink, ckpt,
                        skip_blank=F.lit(True))
    return spark.read.parquet(sink)


@register("train_focal_text")
def q_train_focal_text(spark, sf):
    """M6 on the words of the texts: mini-batches, Adam, early stopping; probabilities of the held-out documents."""
    d = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    rows = d.join(bridge.table(spark, sf, "labels").withColumnRenamed("doc_id", "review_id"), "review_id")
    train, held = sampling.train_test_split(rows, 0.15)
    fit = train_focal(train, held, LABELS, hashed_words("text", 1 << 14), n_features=1 << 14, max_epochs=6)
    p = held.withColumn("_p", fit.model.probabilities(hashed_words("text", 1 << 14)))
    return p.select("review_id", *LABELS, *[F.get("_p", j).alias(f"p_{c}") for j, c in enumerate(LABELS)],
                    F.lit(fit.best_epoch).alias("best_epoch"), F.lit(fit.stop_epoch).alias("stop_epoch"))


# ---- the trained model next to the baselines ---------------------------------------------------

TRAIN_FRACTION, INNER_SEED = 0.2, 7
_INNER = SPLIT.replace("|42", f"|{INNER_SEED}")
_Y = ", ".join(f"CASE WHEN sides[{i // 2 + 1}] = {1 if i % 2 == 0 else -1} THEN 1.0 ELSE 0.0 END" for i in range(8))
_SIDES_OF = PREDS_M7.split(", t AS (SELECT d.doc_id AS review_id, [")[1].split("] AS sides")[0]
_THRESHOLDS = "[" + ", ".join(str(DEFAULT_SCHEMA.thresholds.get(x, DEFAULT_SCHEMA.default_threshold)) for x in DEFAULT_SCHEMA.labels) + "]"
SHEET_ROWS = f"""
SELECT review_id, {_INNER} < 0.15 AS held, x, [{_Y}] AS y FROM (
  SELECT d.doc_id AS review_id, {TEXT_NUMBERS} AS x, [{_SIDES_OF}] AS sides
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
  WHERE d.doc_id % 17 <> 0) WHERE {SPLIT} >= {TRAIN_FRACTION}"""
TRAINED_PREDS = ", " + focal_ctes(SHEET_ROWS, 8) + f"""
, fp AS (SELECT tl.review_id, j, yt, 1.0 / (1.0 + exp(-list_dot_product(list_append({TEXT_NUMBERS}, 1.0), w))) AS p
         FROM tl JOIN documents d ON d.doc_id = tl.review_id JOIN fw ON fw.j = tl.i)
, fb AS (SELECT *, CASE WHEN p > {_THRESHOLDS}[j + 1] THEN 1 ELSE 0 END AS bit FROM fp)
, fres AS (SELECT review_id, j AS i, yt, CASE
             WHEN nb = 2 AND j % 2 = 0 AND NOT (pp > pn) THEN 0 WHEN nb = 2 AND j % 2 = 1 AND pp > pn THEN 0 ELSE bit END AS rbit
           FROM (SELECT *, sum(bit) OVER o AS nb, max(CASE WHEN j % 2 = 0 THEN p END) OVER o AS pp,
                        max(CASE WHEN j % 2 = 1 THEN p END) OVER o AS pn FROM fb WINDOW o AS (PARTITION BY review_id, j // 2)))
, preds AS (SELECT * FROM preds0 WHERE model <> '{FT}' UNION ALL
            SELECT '{FT}' AS model, review_id, i, yt, CAST(rbit AS DOUBLE) AS yp FROM fres)
"""


@register("compare_trained_models", PREDS_M7.replace(", preds AS (", ", preds0 AS (") + TRAINED_PREDS + METRICS_CTES + _metric_select(
    "model, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted, round(exact_match, 6) AS exact_match"))
def q_compare_trained(spark, sf):
    """M7 with M1's third predictor trained here: on the rows of the sheet that the comparison does not test."""
    sheet = bridge.b_text_sheet(spark, sf)
    rows = clean.drop_removed(sheet)
    rows = rows.withColumn("labels", encode_labels(rows.columns))
    names = [f"y{i}" for i in range(DEFAULT_SCHEMA.n_labels)]
    rows = rows.select("review_id", F.col("review_text").alias("text"), *[F.get("labels", i).alias(c) for i, c in enumerate(names)])
    mine, _ = sampling.train_test_split(rows, TRAIN_FRACTION)
    train, held = sampling.train_test_split(mine, 0.15, seed=INNER_SEED)
    fit = train_focal(train, held, names, text_numbers(), n_features=2, steps=1, rate=RATE, max_epochs=EPOCHS,
                      patience=PATIENCE, idf=False, adam=False)
    emb = bridge.table(spark, sf, "embeddings")
    report = compare_models(sheet, {
        BASE: ScoreRegexPredictor(text="text", score="review_score", lexicon=DRIVER_LEXICON),
        CENTROID: CentroidPredictor(polarity_centroids(emb, F.expr(EVEN)), text="text", lexicon=DRIVER_LEXICON),
        FT: FocalPredictor(_stored(spark, fit), text_numbers())}, test_size=TRAIN_FRACTION)
    return report.metrics.select("model", *[r6(c).alias(c) for c in ("f1_micro", "f1_macro", "f1_weighted", "exact_match")])


