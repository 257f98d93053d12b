"""Golden values at sf0.01, measured independently with DuckDB when the blueprint was written."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from aspectra.functions.scoring import cosine_similarity, polarity_from_diff
from aspectra.operators.predictors import attach_one_row, polarity_centroids
from aspectra.plans import bridge

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="sf0.01 data not present")


def q(spark, name):
    return E.queries()[name](spark, SF)


def test_encoded_sheet_counts(spark):
    assert q(spark, "drop_removed").count() == 14117
    assert q(spark, "drop_unlabelled").count() == 12803
    got = [r.n for r in q(spark, "class_counts").orderBy("label_idx").collect()]
    assert got == [4640, 4792, 2810, 2832, 1413, 821, 1237, 1234]


def test_class_weights(spark):
    got = [r.weight for r in q(spark, "class_weights").orderBy("label_idx").collect()]
    assert got == pytest.approx([1.016244, 1.0, 1.30579, 1.30071, 1.841107, 2.414726, 1.96763, 1.970018], abs=1e-6)


def test_flip_metrics(spark):
    vals = {n: q(spark, n).first()[0] for n in ("f1_micro", "f1_macro", "f1_weighted", "exact_match")}
    assert vals == pytest.approx({"f1_micro": 0.885157, "f1_macro": 0.848724, "f1_weighted": 0.88985,
                                  "exact_match": 0.652192}, abs=1e-6)


def test_fill_to_target_in_isolation(spark):
    """W3 alone (quota ids not excluded, 140 taken): the blueprint's measured id sums."""
    from aspectra.operators import sampling
    from aspectra.plans import bridge
    from aspectra.plans.sample_plan import detect_candidates
    from aspectra.schema import DRIVER_LEXICON

    cand = detect_candidates(bridge.b_reviews(spark, SF), DRIVER_LEXICON)
    none = cand.limit(0)
    rows = (sampling.fill_to_target(cand, none, n_taken=140).groupBy("review_score")
            .agg(F.count("*").alias("n"), F.sum("review_id").alias("s")).orderBy("review_score").collect())
    assert [r.n for r in rows] == [12] * 5
    assert [r.s for r in rows] == [7540, 4992, 6899, 5231, 6058]


def test_fill_to_target_after_quota(spark):
    """In the plan the 140 quota ids are excluded first, as the reference does; score 3 is never in a quota."""
    rows = q(spark, "fill_to_target").groupBy("review_score").agg(
        F.count("*").alias("n"), F.sum("review_id").alias("s")).orderBy("review_score").collect()
    assert [r.n for r in rows] == [12] * 5
    assert [r.s for r in rows] == [8160, 4877, 6899, 5006, 5883]


def test_early_stop(spark):
    got = {r.run: r.stop_epoch for r in q(spark, "early_stop_epoch").collect()}
    assert got == {"click": 9, "error": 7, "purchase": 7, "signup": 4, "view": 8}


def test_polarity_deadband(spark):
    """The blueprint's numbers: centroids of the classes 0 and 1 (the query takes all classes)."""
    emb = bridge.table(spark, SF, "embeddings")
    two = polarity_centroids(emb, F.expr("CASE label WHEN 0 THEN true WHEN 1 THEN false END"))
    diff = cosine_similarity("embedding", "c_pos") - cosine_similarity("embedding", "c_neg")
    rows = attach_one_row(emb, two).select(polarity_from_diff(diff).alias("polarity"))
    got = {r.polarity: r.n for r in rows.groupBy("polarity").agg(F.count("*").alias("n")).collect()}
    assert got == {"Pos": 256, "Neg": 208, None: 36}


def test_label_json_sum(spark):
    assert q(spark, "parse_label_json").first().sum_k == 498223


def test_latest_state_users(spark):
    assert q(spark, "latest_label_state_batch").count() == 150
