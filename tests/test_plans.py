"""Physical-plan checks: native expressions, pruning, pushdown and bounded broadcasts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from aspectra.plans import queries as catalog

TRAINED = {"focal_training_log", "score_saved_model", "stream_score_saved_model", "train_focal_text", "compare_trained_models",
           "train_multilabel", "train_multilabel_probs", "model_save_load"}  # fit a model first
PYTHON_OK = {"model_udf", "safe_model_predict", "text_embedding_predict"} | TRAINED  # user model / Spark ML
SKIP_PLAN = {"stream_score", "latest_label_state", "label_removal_stream", "write_metrics", "write_sheet_csv", "export_labels_csv",
             "export_labels_json"} | TRAINED  # read back from a sink or fit a model


def plan(df) -> str:
    """The formatted physical plan (what ``df.explain("formatted")`` prints)."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SKIP_PLAN - PYTHON_OK))
def test_no_python_in_plan(spark, sf_dir, name):
    p = plan(E.queries()[name](spark, sf_dir))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_model_udf_is_arrow_batched(spark, sf_dir):
    p = plan(E.queries()["model_udf"](spark, sf_dir))
    assert "ArrowEvalPython" in p and "BatchEvalPython" not in p


def test_label_dimension_is_broadcast(spark, sf_dir):
    assert "BroadcastHashJoin" in plan(E.queries()["label_dim_join"](spark, sf_dir))


def test_column_pruning(spark, sf_dir):
    p = plan(E.queries()["score_histogram"](spark, sf_dir))
    scan = [ln for ln in p.splitlines() if ln.strip().startswith("ReadSchema")]
    assert scan and all("text" not in ln for ln in scan), scan


def test_filter_pushdown(spark, sf_dir):
    p = plan(E.queries()["require_text"](spark, sf_dir))
    assert any("PushedFilters" in ln and "IsNotNull(text)" in ln for ln in p.splitlines())


def test_per_group_limit_before_shuffle(spark, sf_dir):
    p = plan(E.queries()["stratified_sample"](spark, sf_dir))
    assert "WindowGroupLimit" in p


def test_compare_models_reads_each_input_once(spark, sf_dir):
    # texts, vectors and labels once, all predictors in one pass; the centroids are a scalar subquery
    p = plan(E.queries()["compare_models"](spark, sf_dir)).split("===== Subqueries")[0]
    scans = [ln for ln in p.splitlines() if ln.startswith("(") and "Scan parquet" in ln]
    assert len(scans) == 3, scans
    assert "Union" not in p


def test_no_text_goes_through_the_centroid_join(spark, sf_dir):
    p = plan(E.queries()["embedding_centroid_predict"](spark, sf_dir))
    joins = [b for b in p.split("\n\n") if "Join" in b.split("\n")[0]]
    exchanges = [b for b in p.split("\n\n") if "Exchange" in b.split("\n")[0]]
    assert joins and not any("text#" in b for b in exchanges + joins)


def test_centroids_are_a_scalar_subquery(spark, sf_dir):
    p = plan(E.queries()["embedding_centroid_predict"](spark, sf_dir))
    assert "Subquery" in p and "NestedLoopJoin" not in p and "Cartesian" not in p


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SKIP_PLAN))
def test_no_cross_or_nested_loop_join(spark, sf_dir, name):
    p = plan(E.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", ["top3_fallback", "rank_detected_labels", "score_batch", "label_dim_join", "resolve_conflict"])
def test_logits_are_computed_once(spark, sf_dir, name):
    # one strided sum for all eight logits, and nothing copies it into inferred filters
    p = E.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("aggregate(") == 1, name


def test_computed_replaces_and_adds_columns(spark):
    from aspectra.functions.scoring import computed

    df = computed(spark.range(3).selectExpr("id", "id * 2 as x"), x=F.col("x") + 1, y=F.col("id") * 10)
    assert sorted(map(tuple, df.select("id", "x", "y").collect())) == [(0, 1, 0), (1, 3, 10), (2, 5, 20)]


def test_logits_of_short_and_missing_vectors(spark):
    from aspectra.plans.bridge import LOGIT_SCALE, LOGIT_SHIFT, label_logits

    rows = [(0, None), (1, []), (2, [1.0, 2.0]), (3, [float(i) for i in range(19)])]
    got = dict(spark.createDataFrame(rows, "id int, embedding array<float>").select("id", label_logits()).collect())
    for k, v in rows:
        want = [sum((v or [])[i::8]) * LOGIT_SCALE + LOGIT_SHIFT for i in range(8)]
        assert got[k] == pytest.approx(want)
