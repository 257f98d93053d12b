"""Model comparison job (M7): labelled sheet -> split -> predictors -> metrics.

One lineage produces a wide table ``(model, review_id, y_true, y_pred)``; the
metrics come from a single partial-aggregating pass over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.labels import encode_labels
from aspectra.operators import clean, metrics, sampling
from aspectra.operators.joins import attach_scores
from aspectra.operators.predictors import Predictor
from aspectra.schema import DEFAULT_SCHEMA, SAMPLE_SEED, AspectSchema


@dataclass
class Comparison:
    predictions: DataFrame   # model, review_id, y_true, y_pred
    confusion: DataFrame     # A12
    metrics: DataFrame       # A13-A16 per model
    per_class: DataFrame     # A17


def prepare_labelled(labelled: DataFrame, scores: DataFrame | None = None,
                     schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """J1 (if the score is missing) -> P1 -> X5 -> S8/P9 -> P10."""
    df = labelled
    if "review_score" not in df.columns and scores is not None:
        df = attach_scores(df, scores)
    df = clean.drop_removed(df)
    df = df.withColumn("labels", encode_labels(df.columns, schema))
    df = clean.normalize_columns(df, schema, add_missing_sentiments=False)
    if "review_text" in df.columns:
        df = df.withColumnRenamed("review_text", "text")
    if "review_score" in df.columns:
        df = clean.fill_missing_score(df)
    return df


def compare_models(labelled: DataFrame, predictors: dict[str, Predictor], scores: DataFrame | None = None,
                   test_size: float = 0.20, seed: int = SAMPLE_SEED,
                   schema: AspectSchema = DEFAULT_SCHEMA) -> Comparison:
    df = prepare_labelled(labelled, scores, schema)
    _, test = sampling.train_test_split(df, test_size, "review_id", seed)
    # every predictor adds its column to the same rows (one scan of the test set);
    # the (model, prediction) pairs are then unpivoted, no union of re-scanned branches
    scored = test.select("review_id", "labels", *[c for c in test.columns if c not in ("review_id", "labels")])
    names = []
    for k, (name, pred) in enumerate(predictors.items()):
        scored = pred.transform(scored).withColumnRenamed(pred.output_col, f"_pred{k}")
        names.append(name)
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_pred{k}").alias("y_pred"))
                      for k, n in enumerate(names)])
    preds = (scored.select("review_id", F.col("labels").alias("y_true"), F.inline(pairs))
             .select("model", "review_id", "y_true", "y_pred"))
    conf = metrics.confusion_counts(preds, schema=schema)
    return Comparison(preds, conf, metrics.model_metrics(conf), metrics.per_class_metrics(conf))


class ColumnPredictor:
    """Wrap a column expression (e.g. a stored prediction) as a predictor."""

    def __init__(self, fn, output_col: str = "y_pred"):
        self.fn, self.output_col = fn, output_col

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output_col, self.fn(df))
