"""End-to-end jobs, one per workflow step of the reference.

Each job is a composition of the library's operators; it returns lazy
DataFrames (and writes only when an output path is given), so callers choose
what to materialize.

* :func:`labelling_sample` -- reviews -> clean -> detect -> quota/fill sample -> sheet (§3.1)
* :func:`distribution_report` -- label sheet -> profile tables (§3.4)
* :func:`train_from_sheet` -- label sheet -> weighted per-label model (§3.2, re-aimed at Spark ML)
* :func:`score_texts` -- model -> probabilities -> thresholds -> conflicts -> ranked labels (§3.4)
* :func:`comparison_report` -- split, predictors, metrics, gains, chart data, CSV (§3.3);
  :func:`compare_models` is re-exported from :mod:`aspectra.plans.compare`
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.labels import encode_labels
from aspectra.operators import clean, metrics, reports, train, weights
from aspectra.operators.predictors import ThresholdScorer
from aspectra.plans.compare import compare_models  # noqa: F401  (re-export)
from aspectra.plans.sample_plan import SampleResult, balanced_sample
from aspectra.schema import DEFAULT_SCHEMA, WIDE_LEXICON, AspectSchema
from aspectra.session import scratch_path
from aspectra.sources import io


def labelling_sample(reviews: DataFrame, lexicon: dict = WIDE_LEXICON, out_path: str | None = None,
                     **kw) -> SampleResult:
    """The labelling sample and its sheet; the sheet is written as CSV when ``out_path`` is given."""
    res = balanced_sample(reviews, lexicon, **kw)
    if out_path:
        io.write_sheet_csv(res.sheet.orderBy("row_index"), out_path)
    return res


@dataclass
class Report:
    flag_counts: DataFrame        # A2, on all rows
    sentiments: DataFrame         # A3, on retained rows
    classes: DataFrame            # A4/A5 (count, percent, bar) in label order
    total_labels: DataFrame       # A6
    imbalance: DataFrame          # A7
    unlabelled: DataFrame         # A8
    n_rows: int                   # rows read
    n_retained: int               # rows after P1


def distribution_report(sheet: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA) -> Report:
    """Label distribution and imbalance report of a label sheet.

    The retained rows (P1) with their label vector are read once per table;
    every table is a single aggregate over them.
    """
    sheet = clean.normalize_columns(sheet, schema, add_missing_sentiments=False)
    kept = clean.drop_removed(sheet)
    enc = kept.withColumn("labels", encode_labels(kept.columns, schema))
    classes = reports.class_counts(enc, "labels", schema)
    return Report(
        flag_counts=reports.flag_value_counts(sheet) if "to_remove" in sheet.columns else None,
        sentiments=reports.sentiment_distribution(kept, schema),
        classes=classes,
        total_labels=reports.total_labels(enc, "labels", schema),
        imbalance=reports.imbalance_report(classes),
        unlabelled=reports.unlabelled_count(kept, schema),
        n_rows=sheet.count(),
        n_retained=int(kept.count()),
    )


@dataclass
class ComparisonReport:
    metrics: DataFrame            # A13-A16 per model
    per_class: DataFrame          # A17 per model and label
    gains: DataFrame              # A19: target model against each other model
    chart: DataFrame              # M8: the numbers behind the two charts


def comparison_report(labelled: DataFrame, predictors: dict, target: str, scores: DataFrame | None = None,
                      out_path: str | None = None, **kw) -> ComparisonReport:
    """The model comparison of the workflow (§3.3): split, predictors, metrics, gains, chart data.

    ``target`` names the model compared against the others (the fine-tuned one
    in the reference).  The metrics table is written as CSV when ``out_path``
    is given (S5).  The confusion table (models x labels rows) is written to the shared scratch folder
    once; every table derives from it, so the predictors run once.
    """
    confusion = compare_models(labelled, predictors, scores, **kw).confusion
    path = scratch_path(labelled.sparkSession, "confusion")
    confusion.coalesce(1).write.parquet(path)
    confusion = labelled.sparkSession.read.schema(confusion.schema).parquet(path)
    totals, per_class = metrics.model_metrics(confusion), metrics.per_class_metrics(confusion)
    if out_path:
        io.write_metrics(totals, out_path)
    return ComparisonReport(totals, per_class, metrics.relative_gain(totals, target),
                            metrics.chart_feed(totals, per_class, target))


def _label_columns(schema: AspectSchema) -> list[str]:
    return [f"y{i}" for i in range(schema.n_labels)]


def train_from_sheet(sheet: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA, **kw):
    """Training data (P1 -> P4 -> X5 -> P9) -> one weighted model per label; returns ``(model, weights)``.

    ``weights`` is the A11 table of the training rows; the same weights are
    the positive-row weights inside :func:`aspectra.operators.train.train_multilabel`.
    """
    df = clean.normalize_columns(sheet, schema, add_missing_sentiments=False)
    df = clean.drop_unlabelled(clean.drop_removed(df), schema)
    df = clean.rename_text(df, "text")
    df = df.withColumn("labels", encode_labels(df.columns, schema))
    cols = _label_columns(schema)
    wide = df.select("text", "labels", *[F.get("labels", i).alias(c) for i, c in enumerate(cols)])
    model = train.train_multilabel(wide.drop("labels"), cols, "text", **kw)
    return model, weights.class_weights(wide, "labels", schema)


def score_texts(model, df: DataFrame, text: str = "text", schema: AspectSchema = DEFAULT_SCHEMA,
                thresholds: dict | None = None, resolve: bool = True) -> DataFrame:
    """Model probabilities -> per-label thresholds -> conflict resolution -> ranked labels (+ top-3 fallback)."""
    p = train.predict_multilabel(model, df, _label_columns(schema), text)
    return ThresholdScorer("probs", thresholds, resolve, schema=schema).transform(p)


__all__ = ["ComparisonReport", "Report", "compare_models", "comparison_report", "distribution_report",
           "labelling_sample", "score_texts", "train_from_sheet"]
