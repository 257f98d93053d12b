"""Training on the focal loss: gradients, summing over tasks, the epoch log, selection, and the stored model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.operators import focal, metrics
from aspectra.operators.focal import FocalModel, FocalPredictor, dense_features, hashed_words, train_focal


def test_slopes_match_finite_differences():
    r = np.random.default_rng(1)
    x, y = r.normal(0, 4, (50, 3)), r.integers(0, 2, (50, 3)).astype(float)
    for gamma in (0.0, 1.0, 2.0, 3.5):
        _, slope = focal.focal_terms(x, y, gamma)
        h = 1e-5
        near = (focal.focal_terms(x + h, y, gamma)[0] - focal.focal_terms(x - h, y, gamma)[0]) / (2 * h)
        assert np.allclose(slope, near, atol=1e-6)
    loss, slope = focal.focal_terms(np.array([[-800.0, 800.0]]), np.array([[1.0, 1.0]]), 2.0)
    assert np.isfinite(loss).all() and np.isfinite(slope).all()


def sparse_rows(spark, n=60, features=9, labels=2, seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = int(r.integers(0, 6))
        rows.append((i, [int(a) for a in r.integers(0, features, m)], [float(v) for v in r.normal(size=m)],
                     [float(v) for v in r.integers(0, 2, labels)]))
    return rows, spark.createDataFrame(rows, "review_id long, at array<int>, value array<double>, y array<double>").repartition(5)


def test_the_summed_gradient_is_the_gradient_of_the_loss(spark, monkeypatch):
    monkeypatch.setattr(focal, "VALUES_AT_ONCE", 7)
    rows, df = sparse_rows(spark)
    r = np.random.default_rng(3)
    model = FocalModel(r.normal(size=(10, 2)), r.uniform(0.5, 2, 9), ["a", "b"])
    alpha = np.array([1.0, 2.5])

    def loss_of(weights):
        total = 0.0
        for _, at, value, y in rows:
            z = weights[-1].copy()
            for a, v in zip(at, value):
                z += v * model.scale[a] * weights[a]
            total += float((focal.focal_terms(z[None], np.array([y]), 2.0)[0] * alpha).sum())
        return total

    loss, n, g = focal.gradient(df, model, alpha, 2.0)
    assert n == len(rows) and loss == pytest.approx(loss_of(model.weights))
    for i in range(10):
        for j in range(2):
            step = np.zeros((10, 2))
            step[i, j] = 1e-5
            near = (loss_of(model.weights + step) - loss_of(model.weights - step)) / 2e-5
            assert g[i, j] == pytest.approx(near, abs=1e-5)


def labelled(spark, n=400):
    rows = [(i, " ".join(["good" if i % 3 else "bad", "item", f"w{i % 7}", "fast" if i % 4 == 0 else "slow"]), int(i % 3 > 0), int(i % 4 == 0))
            for i in range(n)]
    return spark.createDataFrame(rows, "review_id long, text string, fine int, quick int")


def test_training_learns_and_keeps_the_best_epoch(spark):
    df = labelled(spark)
    train, held = df.filter("review_id % 5 > 0"), df.filter("review_id % 5 = 0")
    fit = train_focal(train, held, ["fine", "quick"], hashed_words("text", 1 << 10), n_features=1 << 10, rate=0.05, max_epochs=12)
    log = fit.log.orderBy("epoch").collect()
    assert log[0]["train_loss"] > log[-1]["train_loss"] and max(r["f1_macro"] for r in log) > 0.95
    assert fit.best_epoch == metrics.best_epoch(fit.log).first()["best_epoch"]
    assert fit.stop_epoch == metrics.early_stop_epoch(fit.log, patience=3).first()["stop_epoch"] == log[-1]["epoch"]
    p = held.withColumn("p", fit.model.probabilities(hashed_words("text", 1 << 10)))
    right = p.filter((F.get("p", 0) > 0.5) == (F.col("fine") == 1)).count()
    assert right >= 0.95 * held.count()


def test_patience_ends_the_training(spark):
    df = labelled(spark, 60)
    fit = train_focal(df, df, ["fine"], dense_features(F.array(F.lit(0.0))), n_features=1, steps=1, idf=False, patience=2, max_epochs=9)
    assert fit.stop_epoch == 3 and fit.best_epoch == 1 and fit.log.count() == 3  # nothing to learn from


def test_a_stored_model_gives_the_same_probabilities(spark, tmp_dir):
    df = labelled(spark, 80)
    features = hashed_words("text", 1 << 8)
    fit = train_focal(df, df, ["fine", "quick"], features, n_features=1 << 8, max_epochs=2)
    fit.model.save(spark, f"{tmp_dir}/model")
    again = FocalModel.load(spark, f"{tmp_dir}/model")
    assert again.labels == ["fine", "quick"] and np.array_equal(again.weights, fit.model.weights)
    texts = spark.createDataFrame([(1, "good item"), (2, None), (3, ""), (4, "never seen")], "id int, text string")
    one = texts.select("id", fit.model.probabilities(features).alias("p")).orderBy("id").collect()
    two = texts.select("id", again.probabilities(features).alias("p")).orderBy("id").collect()
    assert one == two and all(len(r["p"]) == 2 for r in one)
    assert one[1]["p"] == one[2]["p"]  # no words: the bias alone


def test_a_model_is_stored_in_a_session_without_arrow(spark, tmp_dir):
    model = FocalModel(np.random.default_rng(4).normal(size=(6, 2)), np.arange(1.0, 6.0), ["a", "b"])
    model.weights[2] = 0  # not in use: not stored
    conf, was = "spark.sql.execution.arrow.pyspark.enabled", spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set(conf, "false")
    try:
        model.save(spark, f"{tmp_dir}/model")
        again = FocalModel.load(spark, f"{tmp_dir}/model")
    finally:
        spark.conf.set(conf, was)
    assert again.labels == model.labels and np.array_equal(again.weights, model.weights)
    assert np.array_equal(np.delete(again.scale, 2), np.delete(model.scale, 2))


def test_the_predictor_adds_one_column(spark):
    model = FocalModel(np.zeros((3, 8)), np.ones(2), [f"y{i}" for i in range(8)])
    model.weights[-1] = [9, -9, 9, 9, -9, -9, -9, -9]
    df = spark.createDataFrame([(1, "x")], "review_id int, text string")
    out = FocalPredictor(model, dense_features(F.array(F.lit(1.0), F.lit(2.0)))).transform(df)
    assert out.columns == ["review_id", "text", "y_pred"]
    assert out.first()["y_pred"] == [1, 0, 0, 1, 0, 0, 0, 0]  # equal sides of a pair: the negative one stays


def test_no_rows_to_train_on(spark):
    df = labelled(spark, 5)
    with pytest.raises(ValueError, match="no rows"):
        train_focal(df.limit(0), df, ["fine"], hashed_words("text"))


def test_texts_are_not_shuffled_to_the_training(spark, sf_dir, monkeypatch):
    from aspectra.plans import catalog_focal

    seen = []
    monkeypatch.setattr(catalog_focal, "train_focal", lambda train, held, labels, features, **k: seen.append(train.select("review_id", features.alias("f"))))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog_focal._fit_documents(spark, sf_dir)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = seen[0]._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    shuffled = [part for part in plan.split("\n\n") if ") Exchange\n" in part]
    assert len(shuffled) == 2 and not any("text#" in part for part in shuffled)
