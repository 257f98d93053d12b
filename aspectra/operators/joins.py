"""Joins (J1-J5): equi-joins on the review id or the label index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import normalise_label
from aspectra.schema import DEFAULT_SCHEMA, KEEP_FLAG, AspectSchema, label_dimension


def attach_scores(labelled: DataFrame, scores: DataFrame, key: str = "review_id",
                  score: str = "review_score") -> DataFrame:
    """Left join distinct (id, score) pairs; an id with two scores fans out.

    Skipped when the score column is already present.  Both sides are large in
    general: a shuffle join on the id that AQE may turn into a broadcast and
    splits on skewed ids.
    """
    if score in labelled.columns:
        return labelled
    return labelled.join(scores.select(key, score).distinct(), key, "left")


def labelled_progress(label_ids: DataFrame, dataset: DataFrame, key: str = "review_id") -> DataFrame:
    """Label records whose id exists in the dataset, out of the dataset size; pct capped at 100."""
    # both sides are de-duplicated with map-side partial aggregation before the shuffle, so an id
    # copied across a third of the dataset reaches the join as one row; the aggregate's hash
    # partitioning on the id is the one the join needs, so this adds no exchange
    labelled = label_ids.select(key).distinct().join(dataset.select(key).distinct(), key, "left_semi")
    n_lab = labelled.agg(F.count(F.lit(1)).alias("labelled"))
    total = dataset.agg(F.count(F.lit(1)).alias("total"))
    # the dataset size is a scalar subquery on the one-row count (no join)
    j = n_lab.select("labelled", total.select("total").scalar().alias("total"))
    pct = F.least(F.coalesce(F.try_divide(F.col("labelled") * 100.0, F.col("total")), F.lit(0.0)), F.lit(100.0))
    return j.select("labelled", "total", pct.alias("pct"))


def export_join(reviews: DataFrame, states: DataFrame, key: str = "review_id", text: str = "review_text",
                schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Each review with its stored label record (or defaults) as the 7 export columns.

    ``states`` holds one record per id, as the label store does (a change
    history is first reduced with :func:`aspectra.streaming.scoring.latest_by_key`);
    the left join then keeps exactly one row per review.
    """
    r = reviews.select(F.col(key).cast("string").alias(key), F.coalesce(F.col(text), F.lit("")).alias("review_text"))
    j = r.join(states, key, "left")
    cols = [F.col(key), F.col("review_text")]
    for aspect, col in zip(schema.aspects, schema.sentiment_columns):
        v = F.element_at(F.col("state.categories"), F.lit(schema.category_names[aspect]))
        cols.append(F.coalesce(v, F.lit("")).alias(col))
    cols.append(F.when(F.coalesce(F.col("state.toRemove"), F.lit(False)), F.lit("Sim"))
                .otherwise(F.lit(KEEP_FLAG)).alias("to_remove"))
    return j.select(*cols)


def label_dim_join(long: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA, default: float | None = None) -> DataFrame:
    """Attach label name and threshold by ``label_idx`` (8-row dimension, broadcast)."""
    spark = long.sparkSession
    dim = label_dimension(spark, schema)
    d = default if default is not None else schema.default_threshold
    j = long.join(F.broadcast(dim), "label_idx", "left")
    return j.withColumn("threshold", F.coalesce(F.col("threshold"), F.lit(float(d))))


__all__ = ["attach_scores", "labelled_progress", "export_join", "label_dim_join", "normalise_label"]
