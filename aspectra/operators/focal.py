"""M6 with its own loss: mini-batch training on the weighted focal loss (A21), selected by validation F1.

A model is one matrix of ``n_features + 1`` rows (the last is the bias) and a column per label.  The rows
to train on are written once, dealt into ``steps`` mini-batches by a hash of their id.  A step reads one
of them: every task adds up the gradient of its rows, Spark sums the tasks' gradients by feature, and the
driver, which holds the model, takes an Adam (or plain gradient) step.  What the driver receives is bounded
by the size of the model, whatever the size of the data.

After every epoch the model is evaluated on the validation rows (counts per label, summed in the tasks)
and a row is added to the log; training ends when ``patience`` epochs in a row have not beaten the best
F1-macro, and the best model is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.functions.scoring import computed
from aspectra.operators.train import tokens
from aspectra.schema import EARLY_STOP_PATIENCE, FOCAL_GAMMA, MAX_EPOCHS
from aspectra.session import drop_path, scratch_path

N_FEATURES = 1 << 16
#: feature values that a task works on at once (one row at least)
VALUES_AT_ONCE = 1 << 17


def hashed_words(text: str | Column, n_features: int = N_FEATURES) -> Column:
    """The features of a text: a hash of each word, with the values ``1 / sqrt(words)``."""
    words = tokens(F.lower(F.col(text) if isinstance(text, str) else text))
    at = F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(n_features)).cast("int"))
    n = F.size(at)
    return F.struct(at.alias("at"), F.array_repeat(F.lit(1.0) / F.sqrt(F.greatest(n, F.lit(1)).cast("double")), n).alias("value"))


def dense_features(vector: str | Column) -> Column:
    """A numeric vector as features: its components in order."""
    v = F.coalesce(F.col(vector) if isinstance(vector, str) else vector, F.array().cast("array<double>"))
    return F.struct(F.transform(v, lambda x, i: i).alias("at"), F.transform(v, lambda x: x.cast("double")).alias("value"))


@dataclass
class FocalModel:
    """Weights ``[n_features + 1, labels]``; ``scale`` multiplies the values of each feature."""

    weights: np.ndarray
    scale: np.ndarray
    labels: list[str] = field(default_factory=list)

    def logits(self, bounds: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.tile(self.weights[-1], (len(bounds) - 1, 1))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        scaled = value * self.scale[at]
        for j in range(self.weights.shape[1]):
            out[:, j] += np.bincount(row, scaled * self.weights[at, j], len(out))
        return out

    def probabilities(self, features: Column) -> Column:
        """The probability of every label, in Arrow batches."""
        model = self

        @F.pandas_udf("array<double>")
        def score(f: pd.DataFrame) -> pd.Series:
            bounds = np.r_[0, np.cumsum([0 if x is None else len(x) for x in f["at"]])].astype(np.int64)
            flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *[x for x in f[c] if x is not None]]).astype(kind)
            p = 1 / (1 + np.exp(-model.logits(bounds, flat("at", np.int64), flat("value", np.float64))))
            return pd.Series(list(p))

        return score(features)

    def save(self, spark: SparkSession, path: str) -> None:
        """The weights as a Parquet table, a row per feature that is in use."""
        used = np.flatnonzero((self.weights != 0).any(axis=1) | (np.arange(len(self.weights)) == len(self.weights) - 1))
        # plain numbers: without Arrow, Spark takes no numpy values inside of lists
        rows = list(zip(used.tolist(), np.r_[self.scale, 1.0][used].tolist(), self.weights[used].tolist()))
        meta = ",".join(self.labels)
        (spark.createDataFrame(rows, "feature long, scale double, weights array<double>")
         .withColumn("n_features", F.lit(len(self.scale)).cast("long")).withColumn("labels", F.lit(meta))
         .write.mode("overwrite").parquet(path))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FocalModel:
        t = spark.read.parquet(path).toPandas()
        n, labels = int(t["n_features"][0]), t["labels"][0].split(",")
        weights, scale = np.zeros((n + 1, len(labels))), np.ones(n + 1)
        weights[t["feature"]] = np.stack(t["weights"])
        scale[t["feature"]] = t["scale"]
        return cls(weights, scale[:-1], labels)


@dataclass
class FocalFit:
    model: FocalModel
    log: DataFrame          # run, epoch, train_loss, f1_micro, f1_macro
    best_epoch: int
    stop_epoch: int
    class_weights: dict[str, float]


def focal_terms(logits: np.ndarray, y: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss ``(1 - p_t)^gamma * BCE`` and its derivative by the logit, element by element."""
    z = np.where(y > 0.5, logits, -logits)  # p_t is the logistic of z
    log_p = -np.logaddexp(0, -z)
    p = np.exp(log_p)
    rest = np.exp(-np.logaddexp(0, z))  # 1 - p_t
    loss = rest ** gamma * -log_p
    slope = gamma * rest ** gamma * p * log_p - rest ** (gamma + 1)
    return loss, np.where(y > 0.5, slope, -slope)


def _slices(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bounds, features, values and targets of some rows ``(at, value, y)``."""
    for batch in batches:
        lists = batch.column("at")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        at = lists.values.to_numpy()
        value = batch.column("value").values.to_numpy()
        y = np.array(batch.column("y").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + VALUES_AT_ONCE, side="right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            a, b = offsets[i], offsets[j]
            yield offsets[i:j + 1] - a, at[a:b], value[a:b], y[i:j]
            i = j


def gradient(rows: DataFrame, model: FocalModel, alpha: np.ndarray, gamma: float) -> tuple[float, int, np.ndarray]:
    """Summed loss, rows and gradient over ``rows (at, value, y)``; tasks add up their own rows first."""
    n, k = model.weights.shape

    def sums(batches):
        total, loss, count = np.zeros((n, k)), 0.0, 0
        for bounds, at, value, y in _slices(batches):
            terms, slope = focal_terms(model.logits(bounds, at, value), y, gamma)
            loss, count = loss + float((terms * alpha).sum()), count + len(y)
            slope *= alpha
            scaled, row = value * model.scale[at], np.repeat(np.arange(len(y)), np.diff(bounds))
            for j in range(k):
                total[:-1, j] += np.bincount(at, scaled * slope[row, j], n - 1)
            total[-1] += slope.sum(axis=0)
        used = np.flatnonzero((total != 0).any(axis=1))
        feature = np.r_[used, n, n + 1] if count else used
        values = np.concatenate([total[used], np.full((1, k), loss), np.full((1, k), count)]) if count else total[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(feature.astype(np.int64)), *[pa.array(values[:, j]) for j in range(k)]], ["feature", *[f"g{j}" for j in range(k)]])

    parts = rows.select("at", "value", "y").mapInArrow(sums, "feature long, " + ", ".join(f"g{j} double" for j in range(k)))
    found = parts.groupBy("feature").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(k)]).toArrow()
    out = np.zeros((n + 2, k))
    if found.num_rows:
        out[found.column("feature").to_numpy()] = np.stack([found.column(f"g{j}").to_numpy() for j in range(k)], axis=1)
    return float(out[n, 0]), int(out[n + 1, 0]), out[:n]


def f1_scores(rows: DataFrame, model: FocalModel) -> tuple[float, float]:
    """F1 micro and macro of ``rows (at, value, y)`` at probability 0.5; counts are summed in the tasks."""
    k = model.weights.shape[1]

    def counts(batches):
        total = np.zeros((3, k), dtype=np.int64)
        for bounds, at, value, y in _slices(batches):
            said, true = model.logits(bounds, at, value) > 0, y > 0.5
            total += [(said & true).sum(axis=0), (said & ~true).sum(axis=0), (~said & true).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), *[pa.array(x) for x in total]], ["label", "tp", "fp", "fn"])

    found = (rows.select("at", "value", "y").mapInArrow(counts, "label long, tp long, fp long, fn long")
             .groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).orderBy("label").toPandas())
    tp, fp, fn = (found[c].to_numpy(dtype=np.float64) for c in ("tp", "fp", "fn"))
    f1 = lambda a, b, c: np.divide(2 * a, 2 * a + b + c, out=np.zeros_like(a), where=2 * a + b + c > 0)
    if not len(tp):
        return 0.0, 0.0
    return float(f1(tp.sum(keepdims=True), fp.sum(keepdims=True), fn.sum(keepdims=True))[0]), float(f1(tp, fp, fn).mean())


def _document_scale(rows: DataFrame, n_features: int, n_rows: int) -> np.ndarray:
    """Inverse document frequencies ``ln((N + 1) / (df + 1)) + 1`` of the features."""
    df = rows.select(F.explode(F.array_distinct("at")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).toArrow()
    counts = np.zeros(n_features)
    counts[df.column("at").to_numpy()] = df.column("df").to_numpy()
    return np.log((n_rows + 1) / (counts + 1)) + 1


def train_focal(train: DataFrame, valid: DataFrame, labels: list[str], features: Column, n_features: int = N_FEATURES,
                key: str = "review_id", steps: int = 4, rate: float = 0.02, max_epochs: int = MAX_EPOCHS,
                patience: int = EARLY_STOP_PATIENCE, gamma: float = FOCAL_GAMMA, idf: bool = True, adam: bool = True,
                run: str = "focal") -> FocalFit:
    """Fit ``labels`` (0/1 columns) on ``features`` (a struct of ``at`` and ``value``).

    Defined cases: a null label is 0; rows without features train the bias; an empty table raises ``ValueError``.
    """
    spark, k = train.sparkSession, len(labels)
    y = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in labels])
    step = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(steps)).cast("int")
    shaped = lambda df: computed(df.select(F.col(key), y.alias("y"), features.alias("f")), f=F.col("f"))
    paths = [scratch_path(spark, name) for name in ("focal-train", "focal-valid")]
    shaped(train).select("y", "f.at", "f.value", step.alias("step")).write.partitionBy("step").parquet(paths[0])
    shaped(valid).select("y", "f.at", "f.value").write.parquet(paths[1])
    try:
        kind = "y array<double>, at array<int>, value array<double>"
        rows, held = spark.read.schema(f"{kind}, step int").parquet(paths[0]), spark.read.schema(kind).parquet(paths[1])
        n, *positive = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.get("y", j)), F.lit(0.0)) for j in range(k)]).first()
        if not n:
            raise ValueError("no rows to train on")
        raw = np.sqrt(n / (np.array(positive) + 1.0))
        alpha = raw / raw.min()  # A11
        model = FocalModel(np.zeros((n_features + 1, k)), _document_scale(rows, n_features, n) if idf else np.ones(n_features), list(labels))
        first, second, t = np.zeros_like(model.weights), np.zeros_like(model.weights), 0
        log, best, stale = [], None, 0
        for epoch in range(1, max_epochs + 1):
            loss = seen = 0.0
            for b in range(steps):
                part_loss, count, g = gradient(rows.filter(F.col("step") == b), model, alpha, gamma)
                if not count:
                    continue
                loss, seen, t = loss + part_loss, seen + count, t + 1
                g /= count * k
                if adam:
                    first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                    g = (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
                model = FocalModel(model.weights - rate * g, model.scale, model.labels)
            micro, macro = f1_scores(held, model)
            log.append((run, epoch, loss / (seen * k), micro, macro))
            stale = 0 if best is None or macro > best[0] else stale + 1
            if stale == 0:
                best = (macro, epoch, model)
            if stale >= patience:
                break
    finally:
        for path in paths:
            drop_path(spark, path)
    table = spark.createDataFrame(log, "run string, epoch int, train_loss double, f1_micro double, f1_macro double")
    return FocalFit(best[2], table, best[1], log[-1][1], dict(zip(labels, alpha.tolist())))


class FocalPredictor:
    """M1 third predictor: a model of :func:`train_focal`, its probabilities scored as M3."""

    def __init__(self, model: FocalModel, features: Column, output_col: str = "y_pred", **scorer):
        from aspectra.operators.predictors import ThresholdScorer

        self.model, self.features, self.output_col = model, features, output_col
        self.scorer = ThresholdScorer("_probs", output_col=output_col, **scorer)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = computed(df.withColumn("_f", self.features), _f=F.col("_f")).withColumn("_probs", self.model.probabilities(F.col("_f")))
        return self.scorer.transform(scored).drop("_f", "_probs", "detected", "fallback")
