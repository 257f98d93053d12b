"""Multi-label evaluation.

Truth and prediction travel as aligned fixed-length arrays on one row, keyed
by id (J6: never positional).  Confusion counts for every (model, label) come
from ONE partial-aggregating pass over the wide rows: no explode of the data,
and the shuffle carries one small row per model per map task.  Everything
after that runs on at most ``models x labels`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.operators.reports import _rows
from aspectra.schema import DEFAULT_SCHEMA, EARLY_STOP_PATIENCE, GAIN_FLOOR, AspectSchema


def _div0(a: Column, b: Column) -> Column:
    """zero_division=0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def align(truth: DataFrame, pred: DataFrame, key: str = "review_id",
          y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Align truth and predictions by id (inner join), not by position.

    Expects one prediction row per id, as a predictor's output has; the model
    comparison job does not join at all (every predictor is a column on the
    same rows).
    """
    return truth.select(key, y_true).join(pred.select(key, *[c for c in pred.columns if c != key]), key)


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     model: str | None = "model", schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """TP, FP, FN, TN and support per (model, label) plus the model's exact matches.

    ``y_true``/``y_pred`` are 0/1 double arrays in label order.
    """
    k = schema.n_labels
    t, p = F.col(y_true), F.col(y_pred)
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.count_if(t == p).alias("n_exact")]
    for i in range(k):
        ti = F.get(t, i) == 1.0
        pi = F.get(p, i) == 1.0
        aggs += [F.count_if(ti & pi).alias(f"tp{i}"), F.count_if(~ti & pi).alias(f"fp{i}"),
                 F.count_if(ti & ~pi).alias(f"fn{i}"), F.count_if(~ti & ~pi).alias(f"tn{i}")]
    keys = [model] if model else []
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    pairs = [(F.lit(i), F.lit(lbl), F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}"), F.col(f"tn{i}"))
             for i, lbl in enumerate(schema.labels)]
    out = wide.select(*keys, "n_rows", "n_exact",
                      F.inline(_rows(pairs, ["label_idx", "label", "tp", "fp", "fn", "tn"])))
    return out.withColumn("support", F.col("tp") + F.col("fn"))


def per_class_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per label; undefined -> 0."""
    keys = [c for c in ("model",) if c in conf.columns]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.select(*keys, "label_idx", "label",
                       _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"),
                       _div0(2 * tp, 2 * tp + fp + fn).alias("f1"), "support")


def model_metrics(conf: DataFrame) -> DataFrame:
    """F1 micro, macro, weighted and exact match per model."""
    keys = [c for c in ("model",) if c in conf.columns]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    agg = (conf.withColumn("f1", f1).groupBy(*keys)
           .agg(F.sum("tp").alias("stp"), F.sum("fp").alias("sfp"), F.sum("fn").alias("sfn"),
                F.avg("f1").alias("f1_macro"),
                F.sum(F.col("f1") * F.col("support")).alias("wf1"), F.sum("support").alias("ssup"),
                # constant per model (one value repeated on its 8 label rows)
                F.max("n_exact").alias("n_exact"), F.max("n_rows").alias("n_rows")))
    return agg.select(*keys,
                      _div0(2 * F.col("stp"), 2 * F.col("stp") + F.col("sfp") + F.col("sfn")).alias("f1_micro"),
                      "f1_macro",
                      _div0(F.col("wf1"), F.col("ssup")).alias("f1_weighted"),
                      _div0(F.col("n_exact"), F.col("n_rows")).alias("exact_match"))


def relative_gain(metrics: DataFrame, target: str, metric: str = "f1_macro",
                  floor: float = GAIN_FLOOR) -> DataFrame:
    """``(target - base) / max(base, floor) * 100`` for every other model."""
    w = Window.partitionBy()  # over the handful of model rows only
    tgt = F.max(F.when(F.col("model") == target, F.col(metric))).over(w)
    return (metrics.select("model", F.col(metric).alias("base"), tgt.alias("target_value"))
            .filter(F.col("model") != target)
            .select(F.col("model").alias("baseline"), F.lit(target).alias("model"),
                    ((F.col("target_value") - F.col("base")) / F.greatest(F.col("base"), F.lit(floor))
                     * 100.0).alias("gain_pct")))


def chart_feed(metrics: DataFrame, per_class: DataFrame, model: str) -> DataFrame:
    """M8: the numbers behind the two comparison charts as one long table.

    chart 'f1_by_model': (model, metric name, value); chart 'f1_by_class':
    (model, label, f1, polarity) for one model.
    """
    m = metrics.select("model", F.inline(F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(n).alias("value"))
          for n in ("f1_micro", "f1_macro", "f1_weighted")])))
    a = m.select(F.lit("f1_by_model").alias("chart"), "model", "name", "value",
                 F.lit(None).cast("string").alias("polarity"))
    c = per_class.filter(F.col("model") == model).select(
        F.lit("f1_by_class").alias("chart"), "model", F.col("label").alias("name"), F.col("f1").alias("value"),
        F.when(F.col("label").contains("Pos"), "Pos").otherwise("Neg").alias("polarity"))
    return a.unionByName(c)


def best_epoch(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "f1_macro") -> DataFrame:
    """Best epoch per run by the metric (greater is better, earliest on a tie)."""
    return log.groupBy(run).agg(
        F.max_by(F.col(epoch), F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"),
        F.max(metric).alias(f"best_{metric}"))


def early_stop_epoch(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "f1_macro",
                     patience: int = EARLY_STOP_PATIENCE, max_epochs: int | None = None) -> DataFrame:
    """First epoch at which ``patience`` evaluations in a row failed to beat the best so far.

    Runs that never trigger stop at their last epoch (or ``max_epochs``).
    The window is partitioned by run and ordered by epoch: the log holds one
    row per evaluation, so each partition is bounded by the epoch count.
    """
    df = log if max_epochs is None else log.filter(F.col(epoch) <= max_epochs)
    w_prev = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    w_run = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    improved = F.coalesce(F.col(metric) > F.max(metric).over(w_prev), F.lit(True))
    # evaluations are numbered: patience counts them, not epoch numbers
    marked = df.withColumn("improved", improved).withColumn("nth", F.row_number().over(Window.partitionBy(run).orderBy(epoch)))
    marked = marked.withColumn("last_best", F.max(F.when(F.col("improved"), F.col("nth"))).over(w_run))
    marked = marked.withColumn("stale", F.col("nth") - F.col("last_best"))
    return marked.groupBy(run).agg(
        F.coalesce(F.min(F.when(F.col("stale") >= patience, F.col(epoch))), F.max(epoch)).alias("stop_epoch"))
