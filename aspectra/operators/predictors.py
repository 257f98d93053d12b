"""Predictors: text (+ score) -> 8-element label vector.

A predictor is anything with ``transform(df) -> df + <output_col>``; the three
reference predictors are native column expressions; a user model plugs in as
an Arrow-batched ``predict_batch_udf`` (:class:`ModelPredictor`).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.aspects import detect_aspects
from aspectra.functions.scoring import (apply_thresholds, aspect_polarity_vector, computed,
                                        cosine_similarity, detected_labels, polarity_from_diff, resolve_conflicts,
                                        safe_prediction, score_polarity, sigmoid, threshold_array,
                                        top_k_labels)
from aspectra.functions.text import truncate_chars
from aspectra.schema import (DEFAULT_SCHEMA, EMBED_MAX_CHARS, NARROW_DEFAULT, NARROW_LEXICON, NEGATIVE_WORDS,
                             POLARITY_DEADBAND, POSITIVE_WORDS, AspectSchema)


ASPECTS_TMP = "_aspects"


class Predictor(Protocol):
    """M1: the predictor interface."""

    output_col: str

    def transform(self, df: DataFrame) -> DataFrame: ...


class ScoreRegexPredictor:
    """Aspects by the narrow lexicon (default ``produto``); polarity by score >= 4."""

    def __init__(self, text: str = "text", score: str = "review_score", lexicon: dict = NARROW_LEXICON,
                 default=NARROW_DEFAULT, output_col: str = "y_pred", schema: AspectSchema = DEFAULT_SCHEMA):
        self.text, self.score, self.lexicon, self.default = text, score, lexicon, default
        self.output_col, self.schema = output_col, schema

    def transform(self, df: DataFrame) -> DataFrame:
        text = F.col(self.text) if self.text in df.columns else F.lit(None).cast("string")
        score = F.col(self.score) if self.score in df.columns else F.lit(None).cast("int")
        # the regexes run once per row: the aspect array is its own column, read by all 8 bits
        d = df.withColumn(ASPECTS_TMP, detect_aspects(text, self.lexicon, default=self.default))
        vec = aspect_polarity_vector(F.col(ASPECTS_TMP), score_polarity(score), self.schema)
        return d.withColumn(self.output_col, vec).drop(ASPECTS_TMP)


def class_centroids(ref: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Element-wise mean vector per class.

    Uses ``Summarizer.mean`` (a tree-combined vector sum), so no per-dimension
    explode; output has one row per class.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = ref.select(label, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("v"))
    return (v.groupBy(label).agg(Summarizer.mean(F.col("v")).alias("m"))
            .select(label, vector_to_array("m").alias("centroid")))


def polarity_centroids(ref: DataFrame, positive, vector: str = "embedding") -> DataFrame:
    """The two polarity centroids as ONE row (``c_pos``, ``c_neg``).

    ``positive`` is a boolean column expression; rows where it is null are in neither centroid.
    """
    c = class_centroids(ref.withColumn("_positive", positive).filter("_positive is not null"), vector, "_positive")
    return c.agg(F.max(F.when(F.col("_positive"), F.col("centroid"))).alias("c_pos"),
                 F.max(F.when(~F.col("_positive"), F.col("centroid"))).alias("c_neg"))


def reference_centroids(spark, make_embed_fn, pos_words=POSITIVE_WORDS, neg_words=NEGATIVE_WORDS,
                        batch_size: int = 64) -> DataFrame:
    """M2 centroids from reference words: embed each word with the user's encoder, average per polarity.

    ``make_embed_fn`` follows ``predict_batch_udf``: called once per worker, it
    returns ``embed(texts: np.ndarray) -> np.ndarray[n, d]``.  Returns one row
    (``c_pos``, ``c_neg``) for :class:`CentroidPredictor`.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    words = spark.createDataFrame([(w, 1) for w in pos_words] + [(w, 0) for w in neg_words], "word string, label int")
    embed = predict_batch_udf(make_embed_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return polarity_centroids(words.select("label", embed("word").alias("embedding")), F.col("label") == 1)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a frame that has exactly one row (by construction).

    The row is a scalar subquery: it is computed once, before the main stage,
    and read as a constant by every task -- no join, and its size is that of
    one row however large ``df`` is.
    """
    cols = one_row.columns
    row = one_row.select(F.struct(*cols).alias("_row")).scalar()
    return df.select("*", *[row[c].alias(c) for c in cols])


class CentroidPredictor:
    """M2: aspects by the narrow lexicon; polarity by cosine against two centroids.

    ``diff = cos(v, c_pos) - cos(v, c_neg)``; ``> band`` Pos, ``< -band`` Neg,
    otherwise no label (X12).  A missing or malformed vector gives zeros and
    ``failed = true`` (X13).
    """

    def __init__(self, centroids: DataFrame, vector: str = "embedding", text: str = "text",
                 lexicon: dict = NARROW_LEXICON, band: float = POLARITY_DEADBAND,
                 output_col: str = "y_pred", schema: AspectSchema = DEFAULT_SCHEMA, aspects: str | None = None):
        self.centroids, self.vector, self.text, self.lexicon = centroids, vector, text, lexicon
        self.band, self.output_col, self.schema, self.aspects = band, output_col, schema, aspects

    def transform(self, df: DataFrame) -> DataFrame:
        d = attach_one_row(df, self.centroids)
        text = F.col(self.text) if self.text in df.columns else F.lit(None).cast("string")
        v = F.col(self.vector)
        d = computed(d, sim_pos=cosine_similarity(v, "c_pos"), sim_neg=cosine_similarity(v, "c_neg"))
        diff = F.col("sim_pos") - F.col("sim_neg")
        found = detect_aspects(text, self.lexicon, default=NARROW_DEFAULT)
        if self.aspects:  # detected before a join, so that the text need not go through it
            found = F.coalesce(F.col(self.aspects), F.array(*map(F.lit, NARROW_DEFAULT)))
        d = d.withColumn(ASPECTS_TMP, found)
        raw = aspect_polarity_vector(F.col(ASPECTS_TMP), polarity_from_diff(diff, self.band), self.schema)
        ok = v.isNotNull() & (F.size(v) == F.size("c_pos")) & diff.isNotNull()
        return (d.withColumn("failed", ~ok)
                .withColumn(self.output_col, safe_prediction(F.when(ok, raw), self.schema.n_labels))
                .drop("c_pos", "c_neg", ASPECTS_TMP))


class TextEmbedder:
    """M2's first stage: the first 512 characters of a text (X7) through the user's encoder, in Arrow batches.

    ``make_embed_fn`` is that of :func:`reference_centroids`; a null text is embedded as ''.  The result
    is what :class:`CentroidPredictor` compares with the reference centroids.
    """

    def __init__(self, make_embed_fn, text: str = "text", output_col: str = "embedding", n_chars: int = EMBED_MAX_CHARS,
                 batch_size: int = 64):
        self.make_embed_fn, self.text, self.output_col = make_embed_fn, text, output_col
        self.n_chars, self.batch_size = n_chars, batch_size

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, FloatType

        embed = predict_batch_udf(self.make_embed_fn, return_type=ArrayType(FloatType()), batch_size=self.batch_size)
        return df.withColumn(self.output_col, embed(truncate_chars(F.coalesce(F.col(self.text), F.lit("")), self.n_chars)))


class ThresholdScorer:
    """M3: probabilities -> thresholded bits -> conflict resolution -> ranked labels.

    ``probs`` is an 8-element probability column (from a model UDF or a table).
    """

    def __init__(self, probs: str = "probs", thresholds: dict | None = None, resolve: bool = True,
                 output_col: str = "y_pred", schema: AspectSchema = DEFAULT_SCHEMA, top_k: int = 3):
        self.probs, self.resolve, self.output_col, self.schema, self.top_k = probs, resolve, output_col, schema, top_k
        self.thr = threshold_array(schema, thresholds)

    def transform(self, df: DataFrame) -> DataFrame:
        p, out = F.col(self.probs), self.output_col
        d = computed(df, **{out: apply_thresholds(p, self.thr)})
        if self.resolve:
            d = computed(d, **{out: resolve_conflicts(F.col(out), p)})
        d = computed(d, detected=detected_labels(F.col(out), p, self.schema))
        return computed(d, fallback=F.when(F.size("detected") == 0, top_k_labels(p, self.top_k, self.schema, self.thr)))


class ModelPredictor:
    """M4: a user model as an Arrow-batched scorer (text -> 8 logits -> probabilities).

    ``make_predict_fn`` is called once per Python worker and returns
    ``predict(texts: np.ndarray) -> np.ndarray[n, 8]`` of logits;
    ``predict_batch_udf`` feeds it batches of ``batch_size`` rows.
    """

    def __init__(self, make_predict_fn, text: str = "text", batch_size: int = 64,
                 output_col: str = "probs", n_labels: int = 8, logits: bool = True):
        self.make_predict_fn, self.text, self.batch_size = make_predict_fn, text, batch_size
        self.output_col, self.n_labels, self.logits = output_col, n_labels, logits

    def udf(self):
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, DoubleType

        return predict_batch_udf(self.make_predict_fn, return_type=ArrayType(DoubleType()),
                                 batch_size=self.batch_size)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.udf()(F.coalesce(F.col(self.text), F.lit("")))
        col = sigmoid(out) if self.logits else out
        return df.withColumn(self.output_col, col)


def isolating(make_predict_fn, n_labels: int = 8):
    """X13 for models that raise: a failing batch is halved until the rows that fail are alone.

    Wraps a ``make_predict_fn``: the new one returns ``n_labels + 1`` numbers a row, of which the last is 1
    for a row whose text makes the model raise (or return anything but ``n_labels`` numbers); its others are 0.
    k failing rows in a batch of n cost about ``2 k log2(n)`` more calls.
    """
    def make():
        import numpy as np

        predict = make_predict_fn()

        def one_pass(texts):
            try:
                out = np.asarray(predict(texts), dtype=np.float64)
                if out.shape != (len(texts), n_labels):
                    raise ValueError(f"the model returned {out.shape} for {len(texts)} texts")
                return np.concatenate([out, np.zeros((len(texts), 1))], axis=1)
            except Exception:  # whatever a model raises is that row's failure, not the job's
                if len(texts) == 1:
                    return np.r_[np.zeros(n_labels), 1.0].reshape(1, -1)
                half = len(texts) // 2
                return np.concatenate([one_pass(texts[:half]), one_pass(texts[half:])])

        return lambda texts: one_pass(np.asarray(texts)) if len(texts) else np.zeros((0, n_labels + 1))

    return make


class SafeModelPredictor(ModelPredictor):
    """M4 with X13: probabilities, all zero for the rows at which the model fails, and a column ``failed``."""

    def __init__(self, make_predict_fn, text: str = "text", batch_size: int = 64, output_col: str = "probs",
                 n_labels: int = 8, logits: bool = True):
        super().__init__(isolating(make_predict_fn, n_labels), text, batch_size, output_col, n_labels, logits)

    def transform(self, df: DataFrame) -> DataFrame:
        d = computed(df.withColumn("_out", self.udf()(F.coalesce(F.col(self.text), F.lit("")))), _out=F.col("_out"))
        values = F.slice("_out", 1, self.n_labels)
        failed = F.element_at("_out", self.n_labels + 1) > 0
        return (d.withColumn("failed", failed)
                .withColumn(self.output_col, F.when(failed, F.array_repeat(F.lit(0.0), self.n_labels)).otherwise(
                    sigmoid(values) if self.logits else values)).drop("_out"))


class TrainedModelPredictor:
    """M1 third predictor: a model fitted by :func:`aspectra.operators.train.train_multilabel`.

    Probabilities per label -> per-label thresholds -> conflict resolution, as
    the reference scores its fine-tuned model; ``output_col`` holds the 0/1 vector.
    """

    def __init__(self, model, text: str = "text", output_col: str = "y_pred", thresholds: dict | None = None,
                 resolve: bool = True, schema: AspectSchema = DEFAULT_SCHEMA):
        self.model, self.text, self.output_col, self.schema = model, text, output_col, schema
        self.scorer = ThresholdScorer("probs", thresholds, resolve, output_col, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        from aspectra.operators.train import predict_multilabel

        cols = [f"y{i}" for i in range(self.schema.n_labels)]
        scored = self.scorer.transform(predict_multilabel(self.model, df, cols, self.text))
        return scored.drop("probs", "detected", "fallback")

