"""Catalog: streaming, token, training and model-UDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions.scoring import computed, sigmoid
from aspectra.functions.text import unicode_strip
from aspectra.operators import sampling, train
from aspectra.operators.predictors import (CentroidPredictor, ModelPredictor, SafeModelPredictor, ScoreRegexPredictor, TextEmbedder,
                                           ThresholdScorer, reference_centroids)
from aspectra.plans import bridge
from aspectra.plans.catalog_metrics import SPLIT
from aspectra.plans.catalog_scoring import FLAGS, PLONG, PLONG_CTES, _flags_sql, _x15_sql
from aspectra.plans.registry import labels_str, r6, register
from aspectra.plans.sqlbits import LABEL_DIM, with_
from aspectra.schema import ASPECTS, DRIVER_LEXICON, NEGATIVE_WORDS, POSITIVE_WORDS
from aspectra.session import scratch_path
from aspectra.streaming import scoring as stream

WORD_RE2 = r"[\p{L}\p{N}_]+"


def _score_probs(df):
    """The M3 scoring used by both the batch and the stream path."""
    probs = computed(df.select(F.col("vec_id").alias("review_id"), "embedding"), probs=sigmoid(bridge.label_logits()))
    s = ThresholdScorer("probs").transform(probs.drop("embedding"))
    return s.select("review_id", F.size("detected").cast("int").alias("n_detected"),
                    F.array_join(F.col("detected")["label"], ",").alias("detected"),
                    F.coalesce(F.array_join(F.col("fallback")["label"], ","), F.lit(""))
                    .alias("fallback"))


@register("stream_score", PLONG + """
SELECT p.review_id, CAST(coalesce(d.n, 0) AS INTEGER) AS n_detected, coalesce(d.labels, '') AS detected,
       coalesce(t.labels, '') AS fallback
FROM b_probs p
LEFT JOIN (SELECT review_id, count(*) AS n, string_agg(label, ',' ORDER BY rk) AS labels FROM ranked GROUP BY 1) d
  ON p.review_id = d.review_id
LEFT JOIN (SELECT review_id, string_agg(label, ',' ORDER BY rk) AS labels FROM top3 GROUP BY 1) t
  ON p.review_id = t.review_id""")
def q_stream_score(spark, sf):
    """The embeddings file as a stream, scored by the batch expressions, read back from the sink."""
    src = f"{sf}/embeddings.parquet"
    schema = spark.read.parquet(src).schema
    sink, ckpt = scratch_path(spark, "stream-score"), scratch_path(spark, "stream-score-ckpt")
    stream.stream_score(spark, src, schema, _score_probs, sink, ckpt,
                        skip_blank=F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return spark.read.parquet(sink)


LATEST_SQL = """
SELECT user_id, event_id, event_type, value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


@register("latest_label_state", LATEST_SQL)
def q_latest_state(spark, sf):
    """Keyed latest record per user, kept by a streaming aggregation + versioned upsert."""
    src = f"{sf}/events.parquet"
    schema = spark.read.parquet(src).schema
    state, ckpt = scratch_path(spark, "label-state"), scratch_path(spark, "label-state-ckpt")
    return stream.stream_latest_state(spark, src, schema, "user_id", ["ts", "event_id"],
                                      ["event_id", "event_type", "value", "ts"], state, ckpt)


@register("latest_label_state_batch", LATEST_SQL)
def q_latest_state_batch(spark, sf):
    ev = bridge.table(spark, sf, "events")
    return stream.latest_by_key(ev, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value", "ts"])


_REMOVED = "event_type = 'error'"
_CLEARED = "event_id % 3000 = 0"
REMOVAL_SQL = f"""
WITH clear AS (SELECT max(row(ts, event_id)) AS last_clear FROM events WHERE {_CLEARED}),
latest AS (SELECT * FROM events WHERE NOT ({_CLEARED}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, event_type, value, ts FROM latest, clear
WHERE event_type <> 'error' AND (last_clear IS NULL OR row(ts, event_id) > last_clear)"""


@register("label_removal_stream", REMOVAL_SQL)
def q_label_removal_stream(spark, sf):
    """T2 with removals and delete-all: 'error' events remove a user's record, some events remove all records before them."""
    src = f"{sf}/events.parquet"
    state, ckpt = scratch_path(spark, "label-removal"), scratch_path(spark, "label-removal-ckpt")
    return stream.stream_latest_state(spark, src, spark.read.parquet(src).schema, "user_id", ["ts", "event_id"],
                                      ["event_id", "event_type", "value", "ts"], state, ckpt, deleted=F.expr(_REMOVED), cleared=F.expr(_CLEARED))


@register("label_removal_batch", REMOVAL_SQL)
def q_label_removal_batch(spark, sf):
    return stream.latest_state(bridge.table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value", "ts"],
                               deleted=F.expr(_REMOVED), cleared=F.expr(_CLEARED))


@register("stream_labelled_progress", """
SELECT CAST(n AS BIGINT) AS labelled, CAST(t AS BIGINT) AS total, round(least(n * 100.0 / t, 100.0), 6) AS pct FROM (
  SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS n,
         (SELECT count(*) FROM documents) AS t)""")
def q_stream_progress(spark, sf):
    """J3 while labels arrive, four files one after another: the counts after the last batch."""
    lab = bridge.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    docs = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"))
    src = scratch_path(spark, "label-files")
    lab.repartition(4).write.parquet(src)
    rows = stream.stream_progress(spark, src, lab.schema, "review_id", docs, scratch_path(spark, "progress"),
                                  scratch_path(spark, "progress-ckpt"), options={"maxFilesPerTrigger": "1"})
    return rows.agg(F.max_by(F.struct("labelled", "total", "pct"), "batch").alias("r")).select("r.labelled", "r.total", r6("r.pct").alias("pct"))


@register("prepare_tokens", f"""
WITH t AS (SELECT doc_id AS review_id, regexp_extract_all(text, '{WORD_RE2}') AS toks FROM documents)
SELECT review_id, CAST(least(len(toks), 128) AS INTEGER) AS n_tokens, 128 AS padded_len,
       CAST(least(len(toks), 128) AS INTEGER) AS mask_sum, toks[1] AS first_token,
       CASE WHEN len(toks) >= 128 THEN toks[128] ELSE '[PAD]' END AS last_slot FROM t""")
def q_prepare_tokens(spark, sf):
    d = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    p = train.prepare_tokens(d, "text")
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return p.select("review_id", real.cast("int").alias("n_tokens"), F.size("tokens").alias("padded_len"),
                    real.cast("int").alias("mask_sum"),
                    F.when(real > 0, F.get("tokens", 0)).alias("first_token"),
                    F.get("tokens", 127).alias("last_slot"))


def _docs_labelled(spark, sf):
    d = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("text"))
    lab = bridge.table(spark, sf, "labels").withColumnRenamed("doc_id", "review_id")
    return d.join(lab, "review_id")


_TRAINING = f"""
t AS (SELECT l.quality, l.toxic, d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id
      WHERE {SPLIT.replace('review_id', 'd.doc_id')} >= 0.15),
raw AS (SELECT sqrt(count(*) / (sum(quality) + 1.0)) AS q, sqrt(count(*) / (sum(toxic) + 1.0)) AS x FROM t)"""


@register("train_multilabel", with_(_TRAINING) + f"""
SELECT d.doc_id AS review_id, l.quality, l.toxic, true AS valid,
       round(CASE WHEN l.quality = 1 THEN q / least(q, x) ELSE 1.0 END, 6) AS w_quality,
       round(CASE WHEN l.toxic = 1 THEN x / least(q, x) ELSE 1.0 END, 6) AS w_toxic
FROM documents d JOIN labels l ON l.doc_id = d.doc_id, raw
WHERE {SPLIT.replace('review_id', 'd.doc_id')} < 0.15""")
def q_train(spark, sf):
    """M6: weighted per-label logistic regressions on the labelled documents; predictions on held-out rows.

    ``valid``: both predictions are probabilities; ``w_``: the class weight of the row's label in the training.
    """
    return _held_out(spark, sf).select(
        "review_id", "quality", "toxic", ((F.size("probs") == 2) & F.forall("probs", lambda x: x.between(0.0, 1.0))).alias("valid"),
        r6("w_quality").alias("w_quality"), r6("w_toxic").alias("w_toxic"))


def _held_out(spark, sf):
    df = _docs_labelled(spark, sf)
    tr, te = sampling.train_test_split(df, 0.15)
    labels = ["quality", "toxic"]
    model = train.train_multilabel(tr, labels)
    return train.label_weight_columns(train.predict_multilabel(model, te, labels), labels, tr)


@register("train_multilabel_probs")
def q_train_probs(spark, sf):
    """M6: the probabilities of the held-out rows."""
    return _held_out(spark, sf).select("review_id", "quality", "toxic", F.get("probs", 0).alias("p_quality"), F.get("probs", 1).alias("p_toxic"))


@register("training_document_frequencies", with_(_TRAINING) + f"""
SELECT word, CAST(count(*) AS BIGINT) AS df FROM (
  SELECT unnest(list_distinct(regexp_extract_all(text, '{WORD_RE2}'))) AS word FROM t) GROUP BY word""")
def q_document_frequencies(spark, sf):
    """M6: the document frequencies behind the training features."""
    tr, _ = sampling.train_test_split(_docs_labelled(spark, sf), 0.15)
    return train.document_frequencies(tr)


@register("model_save_load", "SELECT doc_id AS review_id, true AS equal FROM documents")
def q_save_load(spark, sf):
    """Save the fitted pipeline, load it back, and compare predictions row by row."""
    df = _docs_labelled(spark, sf)
    model = train.train_multilabel(df, ["quality", "toxic"])
    path = scratch_path(spark, "model")
    train.save_model(model, path)
    loaded = train.load_model(path)
    docs = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    # both models score the same rows in one pass (no second scan, no join on the id)
    a = train.predict_multilabel(model, docs, ["quality", "toxic"]).withColumnRenamed("probs", "a")
    b = train.predict_multilabel(loaded, a, ["quality", "toxic"]).withColumnRenamed("probs", "b")
    same = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) < 1e-12), lambda ok: ok)
    return b.select("review_id", same.alias("equal"))


def _udf_sql() -> str:
    logits = [f"{train.CHARS[i]} * (length(t) % 97) / 97.0 + {train.SPACES[i]} * ((length(t) - length(replace(t, ' ', ''))) % 31) / 31.0"
              f" + {train.BIAS}" for i in range(8)]
    probs = ", ".join(f"1.0 / (1.0 + exp(-({x})))" for x in logits)
    return (with_("d AS (SELECT doc_id AS review_id, coalesce(text, '') AS t FROM documents)",
                  f"b_probs AS (SELECT review_id, [{probs}] AS probs FROM d)", LABEL_DIM) + PLONG_CTES
            + "SELECT p.review_id, " + ", ".join(f"round(probs[{i + 1}], 6) AS p{i}" for i in range(8))
            + """, CAST(coalesce(n, 0) AS INTEGER) AS n_detected FROM b_probs p
LEFT JOIN (SELECT review_id, count(*) AS n FROM ranked GROUP BY 1) r ON r.review_id = p.review_id""")


@register("model_udf", _udf_sql())
def q_model_udf(spark, sf):
    """M4: a user model through predict_batch_udf (Arrow batches), then the M3 scoring."""
    d = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    p = ModelPredictor(train.counting_linear_model(), text="text", batch_size=256).transform(d)
    s = ThresholdScorer("probs").transform(p)
    return s.select("review_id", *[r6(F.get("probs", i)).alias(f"p{i}") for i in range(8)],
                    F.size("detected").alias("n_detected"))


def _safe_sql() -> str:
    logits = [f"{train.CHARS[i]} * (length(t) % 97) / 97.0 + {train.SPACES[i]} * ((length(t) - length(replace(t, ' ', ''))) % 31) / 31.0"
              f" + {train.BIAS}" for i in range(8)]
    return ("SELECT doc_id AS review_id, length(t) % 13 = 0 AS failed, " + ", ".join(
        f"CASE WHEN length(t) % 13 = 0 THEN 0.0 ELSE round(1.0 / (1.0 + exp(-({x}))), 6) END AS p{i}" for i, x in enumerate(logits))
            + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")


@register("safe_model_predict", _safe_sql())
def q_safe_model_predict(spark, sf):
    """A model that raises at some texts; these alone get zeros and ``failed``."""
    d = bridge.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    p = SafeModelPredictor(train.brittle(train.counting_linear_model()), text="text", batch_size=256).transform(d)
    return p.select("review_id", "failed", *[r6(F.get("probs", i)).alias(f"p{i}") for i in range(8)])


def _embed_sql() -> str:
    vector = lambda n: f"[CAST(({n}) * (k + 1) % 13 - 6 AS DOUBLE) FOR k IN range(8)]"
    centroid = lambda words: "(SELECT list(m ORDER BY k) FROM (SELECT k, avg(v[k + 1]) AS m FROM (SELECT " + vector(
        "length(w)") + " AS v FROM (VALUES " + ", ".join(f"('{w}')" for w in words) + ") t(w)), range(8) r(k) GROUP BY k))"
    bits = [f"CASE WHEN (tem_{a}{f' OR {no_aspect}' if a == 'produto' else ''}) AND side = {s} THEN '1' ELSE '0' END"
            for no_aspect in ["NOT (" + " OR ".join(f"tem_{a}" for a in ASPECTS) + ")"] for a in ASPECTS for s in (1, -1)]
    return (FLAGS + f""", e AS (SELECT *, {vector("length(substring(coalesce(review_text, ''), 1, 512))")} AS v FROM fl)
, s AS (SELECT *, list_cosine_similarity(v, {centroid(POSITIVE_WORDS)}) - list_cosine_similarity(v, {centroid(NEGATIVE_WORDS)}) AS diff FROM e)
, p AS (SELECT *, CASE WHEN diff > 0.02 THEN 1 WHEN diff < -0.02 THEN -1 ELSE 0 END AS side FROM s)
SELECT review_id, concat_ws(',', {', '.join(bits)}) AS y_pred FROM p""")


@register("text_embedding_predict", _embed_sql())
def q_text_embedding_predict(spark, sf):
    """M2 from text: truncation, encoder, reference-word centroids, cosine and dead band."""
    encoder = train.counting_embedding()
    df = TextEmbedder(encoder, text="review_text").transform(bridge.b_reviews(spark, sf))
    pred = CentroidPredictor(reference_centroids(spark, encoder), text="review_text", lexicon=DRIVER_LEXICON)
    return pred.transform(df).select("review_id", labels_str("y_pred").alias("y_pred"))


def _classify_text(df):
    """T1 on text: the score + regex predictor (no score column, so the missing score counts as 3)."""
    p = ScoreRegexPredictor(text="text", score="review_score", lexicon=DRIVER_LEXICON).transform(df)
    return p.select("conv_id", "turn", labels_str("y_pred").alias("y_pred"))


@register("stream_classify_text", f"""
WITH fl AS (SELECT conv_id, turn, CAST(NULL AS INTEGER) AS review_score, {_flags_sql('text')} FROM conversations
            WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')
SELECT conv_id, turn, {_x15_sql()} AS y_pred FROM fl""")
def q_stream_classify_text(spark, sf):
    """T1 over text: conversation turns as a file stream, blank texts skipped, classified per turn."""
    src = f"{sf}/conversations.parquet"
    schema = spark.read.parquet(src).schema
    sink, ckpt = scratch_path(spark, "stream-text"), scratch_path(spark, "stream-text-ckpt")
    not_blank = F.col("text").isNotNull() & (unicode_strip("text") != "")
    stream.stream_score(spark, src, schema, _classify_text, sink, ckpt, skip_blank=not_blank)
    return spark.read.parquet(sink)
