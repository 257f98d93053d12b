"""Model inputs and training (M4-M6, S10), re-aimed at Spark ML.

* M5: fixed-length token input: Unicode word split, truncate to 128, pad with a
  mask -- built-in array functions only.
* M6: one weighted ``LogisticRegression`` per label over shared
  ``RegexTokenizer -> HashingTF -> IDF`` features, in one ``Pipeline``.  Row
  weight = the label's A11 class weight on positive rows, 1 elsewhere.
* S10: ``PipelineModel`` save / load.
* M4: a user model as an Arrow-batched ``predict_batch_udf``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.schema import MAX_EPOCHS, MAX_TOKENS

WORD_PATTERN = r"[\p{L}\p{N}_]+"
PAD = "[PAD]"


def tokens(text, pattern: str = WORD_PATTERN) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0)


def prepare_tokens(df: DataFrame, text: str = "text", max_len: int = MAX_TOKENS) -> DataFrame:
    """M5: ``tokens`` (padded to ``max_len`` with [PAD]) and ``attention_mask`` (1 real, 0 pad)."""
    t = F.slice(tokens(text), 1, max_len)
    n = F.size(t)
    pad = F.array_repeat(F.lit(PAD), F.lit(max_len) - n)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    return df.withColumn("tokens", F.concat(t, pad)).withColumn("attention_mask", mask)


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, df)``: the number of rows that hold each word of the M6 features."""
    return (df.select(F.explode(F.array_distinct(tokens(text))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("df")))


def label_weight_columns(df: DataFrame, label_cols: list[str], counted: DataFrame | None = None) -> DataFrame:
    """A11 weights for 0/1 label columns, attached as ``w_<label>`` row weights.

    One aggregate pass (over ``counted``, by default ``df``) gives N and the positives; the weights are
    literals afterwards (k numbers), so no join back to the rows.
    """
    row = (df if counted is None else counted).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in label_cols]).first()
    n = float(row["n"])
    raw = {c: (n / ((row[c] or 0.0) + 1.0)) ** 0.5 for c in label_cols}
    lo = min(raw.values()) if raw else 1.0
    out = df
    for c in label_cols:
        out = out.withColumn(f"w_{c}", F.when(F.col(c) == 1, F.lit(raw[c] / lo)).otherwise(F.lit(1.0)))
    return out


def feature_pipeline(text: str = "text", num_features: int = 1 << 18):
    """Shared text features: Unicode word tokens -> hashed term frequencies -> IDF."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=WORD_PATTERN, gaps=False, toLowercase=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features")])


def label_model(label: str, reg_param: float = 0.01, max_iter: int = MAX_EPOCHS):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="_features", labelCol=label, weightCol=f"w_{label}",
                              predictionCol=f"pred_{label}", probabilityCol=f"prob_{label}",
                              rawPredictionCol=f"raw_{label}", regParam=reg_param, maxIter=max_iter)


def multilabel_pipeline(label_cols: list[str], text: str = "text", num_features: int = 1 << 18,
                        reg_param: float = 0.01, max_iter: int = MAX_EPOCHS):
    """M6 as one unfitted ``Pipeline``: shared features + one weighted logistic regression per label."""
    from pyspark.ml import Pipeline

    feats = feature_pipeline(text, num_features).getStages()
    return Pipeline(stages=[*feats, *[label_model(c, reg_param, max_iter) for c in label_cols]])


def train_multilabel(df: DataFrame, label_cols: list[str], text: str = "text", num_features: int = 1 << 18,
                     reg_param: float = 0.01, max_iter: int = MAX_EPOCHS, parallelism: int | None = None,
                     partitions: int | None = None):
    """Fit M6 on ``df`` (labels as 0/1 columns); returns one ``PipelineModel``.

    The text is tokenized and hashed once: the sparse term-frequency vectors
    (not the text) are persisted (memory, spilling to disk; recomputed from
    lineage if an executor is lost); IDF is fitted on them and every per-label
    regression iterates over the IDF-weighted vectors.  The
    per-label fits are independent, so up to ``parallelism`` (default 2; each
    keeps its own blocks) of them run as concurrent Spark jobs (as ``OneVsRest`` does); each iteration is a
    cluster-wide tree aggregate either way.  ``max_iter`` defaults to the
    reference's training budget of 20 passes.
    """
    from pyspark import StorageLevel
    from pyspark.ml import PipelineModel

    d = label_weight_columns(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), label_cols)
    d = d.select(text, *[F.col(c).cast("double").alias(c) for c in label_cols], *[f"w_{c}" for c in label_cols])
    tok, tf, idf = feature_pipeline(text, num_features).getStages()
    # one pass over the text: hashed term frequencies are persisted, IDF is fitted and applied on them
    counts = tf.transform(tok.transform(d)).select("_tf", *label_cols, *[f"w_{c}" for c in label_cols])
    # each iteration merges one dense gradient per partition, so the input's partitioning is kept;
    # ``partitions`` spreads the vectors evenly when the input is large but unevenly split
    if partitions:
        counts = counts.repartition(partitions)
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    idf_model = idf.fit(counts)
    x = idf_model.transform(counts).select("_features", *label_cols, *[f"w_{c}" for c in label_cols])
    try:
        n = max(1, min(2, len(label_cols)) if parallelism is None else parallelism)
        fit = lambda c: label_model(c, reg_param, max_iter).fit(x)
        if n == 1:
            models = [fit(c) for c in label_cols]
        else:
            from multiprocessing.pool import ThreadPool

            with ThreadPool(n) as pool:
                models = pool.map(fit, label_cols)
    finally:
        counts.unpersist()
    return PipelineModel(stages=[tok, tf, idf_model, *models])


def predict_multilabel(model, df: DataFrame, label_cols: list[str], text: str = "text") -> DataFrame:
    """Probabilities of the positive class per label as an array column ``probs``."""
    from pyspark.ml.functions import vector_to_array

    d = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    out = model.transform(d)
    probs = F.array(*[F.get(vector_to_array(F.col(f"prob_{c}")), 1) for c in label_cols])
    drop = ["_tok", "_tf", "_features"] + [f"{p}_{c}" for c in label_cols for p in ("pred", "prob", "raw")]
    return out.withColumn("probs", probs).drop(*drop)


def save_model(model, path: str) -> None:
    """Persist the fitted pipeline (features and per-label models together)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


#: the stand-in model: logit i is CHARS[i] * (characters mod 97) / 97 + SPACES[i] * (spaces mod 31) / 31 + BIAS
CHARS, SPACES, BIAS = [(i - 3.5) / 2 for i in range(8)], [2 - i / 2 for i in range(8)], -0.5


def counting_linear_model():
    """A small stand-in user model for M4: two counts of a text -> one matrix product per batch.

    Returns ``make_predict_fn`` for ``predict_batch_udf``; the weights are made once per Python worker.
    """
    def make_predict_fn():
        import numpy as np

        w = np.array([CHARS, SPACES])

        def predict(texts):
            n = np.array([(len(t) % 97 / 97.0, t.count(" ") % 31 / 31.0) for t in map(str, texts)]).reshape(-1, 2)
            return n @ w + BIAS

        return predict

    return make_predict_fn


def brittle(make_predict_fn, divisor: int = 13):
    """A stand-in model that raises at texts whose length is a multiple of ``divisor``."""
    def make():
        predict = make_predict_fn()

        def run(texts):
            if any(len(t) % divisor == 0 for t in map(str, texts)):
                raise RuntimeError("a text the model cannot take")
            return predict(texts)

        return run

    return make


def counting_embedding(dim: int = 8):
    """A stand-in text encoder that SQL can compute: component k is (characters * (k + 1) mod 13) - 6."""
    def make_embed_fn():
        import numpy as np

        factor = np.arange(1, dim + 1)

        def embed(texts):
            n = np.array([len(t) for t in map(str, texts)], dtype=np.int64)
            return (n[:, None] * factor % 13 - 6).astype(np.float32)

        return embed

    return make_embed_fn


def hashed_word_embedding(dim: int = 8):
    """A stand-in text encoder for ``predict_batch_udf`` (e.g. for M2 reference centroids).

    Each text maps to ``dim`` values in [-7.5, 7.5] from 4-bit slices of its CRC32
    (deterministic, no model files).  Returns ``make_embed_fn``.
    """
    def make_embed_fn():
        import zlib

        import numpy as np

        def embed(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for r, t in enumerate(texts):
                h = zlib.crc32(str(t).encode("utf-8"))
                out[r] = [((h >> ((4 * k) % 32)) & 15) - 7.5 for k in range(dim)]
            return out

        return embed

    return make_embed_fn
