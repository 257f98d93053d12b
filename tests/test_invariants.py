"""Algebraic and scale invariants.

* results do not depend on partitioning (hash-ordered sampling, D13);
* a hot key holding a third of the rows gives the same per-group top-n;
* conflict resolution never leaves both polarities of an aspect set;
* the stream path equals the batch path.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from aspectra.functions.scoring import apply_thresholds, resolve_conflicts, sigmoid, threshold_array
from aspectra.functions.text import format_percent, int_div, percent_cell
from aspectra.operators import metrics, sampling
from aspectra.plans import bridge
from aspectra.plans.sample_plan import balanced_sample
from aspectra.schema import DRIVER_LEXICON


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stratified_sample_partition_invariant(spark, sf_dir):
    r = bridge.b_reviews(spark, sf_dir).select("review_id", "review_score")
    a = sampling.stratified_sample(r, ["review_score"], 7)
    b = sampling.stratified_sample(r.repartition(13, "review_id"), ["review_score"], 7)
    assert _rows(a) == _rows(b)
    counts = {row.review_score: row.n for row in a.groupBy("review_score").agg(F.count("*").alias("n")).collect()}
    assert all(v == 7 for v in counts.values())


def test_top_n_hot_key_matches_unsalted(spark):
    # group 0 holds a third of the rows: the salted two-level top-n must equal a plain one
    df = spark.range(30000).select(F.col("id").alias("review_id"),
                                   F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"))
    order = [F.xxhash64("review_id"), F.col("review_id")]
    salted = sampling.top_n_per_group(df, ["g"], 5, order, salt=F.pmod(F.col("review_id"), F.lit(64)))
    plain = sampling.top_n_per_group(df, ["g"], 5, order, salt=None)
    assert _rows(salted.drop("_rank")) == _rows(plain.drop("_rank"))


def test_balanced_sample_bounds(spark, sf_dir):
    res = balanced_sample(bridge.b_reviews(spark, sf_dir), DRIVER_LEXICON)
    final = res.final.select("review_id", "row_index").collect()
    ids = [r.review_id for r in final]
    assert len(ids) == len(set(ids)) <= 200
    assert sorted(r.row_index for r in final) == list(range(len(final)))
    assert res.sheet.count() == len(final)


def test_quota_sample_sequential_exclusion(spark, sf_dir):
    res = balanced_sample(bridge.b_reviews(spark, sf_dir), DRIVER_LEXICON)
    q = res.quota.groupBy("review_id").agg(F.countDistinct("step").alias("k"))
    assert q.filter(F.col("k") > 1).count() == 0  # a taken id is never taken again


def test_resolve_conflicts_never_both(spark, sf_dir):
    p = bridge.b_probs(spark, sf_dir)
    low = F.array(*[F.lit(0.1)] * 8)  # low thresholds: many pairs set before resolution
    bits = resolve_conflicts(apply_thresholds("probs", low), "probs")
    both = p.select(bits.alias("b")).select(
        F.exists(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.get("b", 2 * k) + F.get("b", 2 * k + 1)) > 1).alias("x"))
    assert both.filter("x").count() == 0


def test_thresholds_strict_and_nan_safe(spark):
    df = spark.createDataFrame([([0.5, 0.51, float("nan"), 0.45, 0.3, 0.46, 0.25, 0.31],)], "probs array<double>")
    bits = df.select(apply_thresholds("probs", threshold_array()).alias("b")).first().b
    assert bits == [0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0]


def test_split_disjoint_and_covering(spark, sf_dir):
    r = bridge.b_reviews(spark, sf_dir).select("review_id")
    tr, te = sampling.train_test_split(r, 0.2)
    assert tr.join(te, "review_id").count() == 0
    assert tr.count() + te.count() == r.count()


def test_exact_match_bounded_by_label_accuracy(spark, sf_dir):
    w = bridge.b_preds_wide(spark, sf_dir).select(F.lit("m").alias("model"), "review_id", "y_true", "y_pred")
    conf = metrics.confusion_counts(w)
    m = metrics.model_metrics(conf).first()
    acc = [(r.tp + r.tn) / (r.tp + r.tn + r.fp + r.fn) for r in conf.collect()]
    assert m.exact_match <= min(acc) + 1e-12


def test_identical_predictions_score_one(spark, sf_dir):
    w = bridge.b_preds_wide(spark, sf_dir).select(F.lit("m").alias("model"), "review_id", "y_true",
                                                    F.col("y_true").alias("y_pred"))
    m = metrics.model_metrics(metrics.confusion_counts(w)).first()
    assert m.f1_micro == pytest.approx(1.0) and m.exact_match == pytest.approx(1.0)


def test_stream_equals_batch(spark, sf_dir):
    q = E.queries()
    assert _rows(q["stream_score"](spark, sf_dir)) == _rows(q["score_batch"](spark, sf_dir))
    assert _rows(q["latest_label_state"](spark, sf_dir)) == _rows(q["latest_label_state_batch"](spark, sf_dir))
    from aspectra.plans.catalog_models import _classify_text

    conv = bridge.table(spark, sf_dir, "conversations")
    assert _rows(q["stream_classify_text"](spark, sf_dir)) == _rows(_classify_text(conv))


def test_sigmoid_matches_python(spark):
    import math

    df = spark.createDataFrame([([-3.0, 0.0, 2.5],)], "x array<double>")
    got = df.select(sigmoid("x").alias("s")).first().s
    assert got == pytest.approx([1 / (1 + math.exp(3.0)), 0.5, 1 / (1 + math.exp(-2.5))])


def test_reference_word_centroids(spark, sf_dir):
    from aspectra.operators.predictors import CentroidPredictor, reference_centroids
    from aspectra.schema import DRIVER_LEXICON

    from aspectra.operators.train import hashed_word_embedding

    cents = reference_centroids(spark, hashed_word_embedding(8))
    row = cents.first()
    assert len(row.c_pos) == 8 and len(row.c_neg) == 8
    emb = bridge.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 8).alias("embedding"), F.lit("chegou rápido").alias("text"))
    out = CentroidPredictor(cents, lexicon=DRIVER_LEXICON).transform(emb)
    assert out.filter("failed").count() == 0
    assert out.count() == emb.count()


def test_latest_by_key_hot_key(spark):
    from pyspark.sql import Window

    from aspectra.streaming.scoring import latest_by_key

    # user 0 holds a third of the events; ties on ts are broken by event_id
    ev = spark.range(30000).select(F.col("id").alias("event_id"),
                                   F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("user_id"),
                                   (F.col("id") % 500).alias("ts"), (F.col("id") * 7 % 11).alias("value"))
    got = latest_by_key(ev, "user_id", ["ts", "event_id"], ["event_id", "ts", "value"])
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    want = ev.withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_id", "ts", "value")
    assert _rows(got.select("user_id", "event_id", "ts", "value")) == _rows(want)


def test_balanced_sample_partition_invariant(spark, sf_dir):
    r = bridge.b_reviews(spark, sf_dir)
    a = balanced_sample(r, DRIVER_LEXICON).final.select("review_id", "row_index")
    b = balanced_sample(r.repartition(11, "lang"), DRIVER_LEXICON).final.select("review_id", "row_index")
    assert _rows(a) == _rows(b)


def test_row_index_across_uneven_partitions(spark):
    from aspectra.sources.io import row_index

    # 20,000 rows in 9 uneven partitions, shuffled: the index must be the rank in the order
    df = spark.range(20000).withColumn("k", (F.col("id") * 7919) % 20000)
    df = df.repartition(9, F.col("id") % 3).select("k")
    out = row_index(df, ["k"], "index")
    bad = out.filter(F.col("index") != F.col("k")).count()
    assert bad == 0 and out.count() == 20000


def test_exact_split_size(spark, sf_dir):
    import math

    r = bridge.b_reviews(spark, sf_dir).select("review_id")
    n = r.count()
    tr, te = sampling.train_test_split(r, 0.15, exact=True)
    assert te.count() == math.ceil(n * 0.15)
    assert tr.count() + te.count() == n and tr.join(te, "review_id").count() == 0


def test_exact_split_keeps_all_rows_of_repeated_ids(spark):
    rows = spark.range(40).selectExpr("id % 10 AS review_id", "id AS copy")
    tr, te = sampling.train_test_split(rows, 0.25, exact=True)
    assert tr.count() + te.count() == 40 and te.count() == 12  # three whole ids reach ten rows
    assert tr.join(te, "review_id").count() == 0
    for share, held in ((0.0, 0), (1.0, 40)):
        assert sampling.train_test_split(rows, share, exact=True)[1].count() == held


def test_early_stop_counts_evaluations(spark):
    log = spark.createDataFrame([("r", e, f) for e, f in ((2, 0.9), (4, 0.1), (6, 0.2), (8, 0.3), (10, 0.4))],
                                "run string, epoch int, f1_macro double")
    assert metrics.early_stop_epoch(log).first().stop_epoch == 8
    assert metrics.early_stop_epoch(log, max_epochs=6).first().stop_epoch == 6


def test_percent_text_is_pythons(spark):
    values = [0.0625, 0.0025, 0.35 / 100, 0.125, 0.0, 1.0, 0.00049999, 0.0005, 0.0015, 0.9995, 0.99949, 12.3456, -0.0625, 1 / 3,
              *(k / 16 for k in range(17)), *(k / 2000 for k in range(40)), *(k / 997 for k in range(0, 997, 13))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in df.select(format_percent("x"), format_percent("x", 0), format_percent("x", 2),
                                       percent_cell("x", 8)).collect()]
    # the product 100 x is a double in Python's format too
    assert got == [(f"{100 * v:.1f}%", f"{100 * v:.0f}%", f"{100 * v:.2f}%", f"{f'{100 * v:.1f}%':>8}") for v in values]


def test_integer_division_of_longs(spark):
    r = spark.createDataFrame([(6_000_000_000, 7)], "a long, b long").select(int_div("a", 2), int_div("a", "b"), int_div("b", 2))
    assert tuple(r.first()) == (3_000_000_000, 857_142_857, 3)


def test_sheet_row_has_the_score_that_was_sampled(spark):
    text = "entrega rapida e produto excelente, preco bom e atendimento otimo em tudo"
    rows = [(i, s, text) for i in range(30) for s in (1, 5)]
    res = balanced_sample(spark.createDataFrame(rows, "review_id long, review_score int, review_text string"))
    drawn = {(r.review_id, r.review_score) for r in res.final.collect()}
    assert {(r.review_id, r.review_score) for r in res.sheet.collect()} == drawn and len(drawn) == 30


def test_unbounded_exclusion_is_not_forced_to_broadcast(spark):
    big = spark.range(1000).withColumnRenamed("id", "review_id")
    used = spark.range(0, 1000, 3).withColumnRenamed("id", "review_id")
    q = sampling.exclude_used(big, used)  # no proven bound: AQE decides at run time
    hint = q._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in hint.lower()
    assert q.count() == 1000 - 334
    qb = sampling.exclude_used(big, used, bounded=True)
    assert "broadcast" in qb._jdf.queryExecution().analyzed().toString().lower()


def test_labelling_sample_job_writes_sheet(spark, sf_dir, tmp_dir):
    from aspectra.plans.jobs import labelling_sample
    from aspectra.sources import io

    raw = bridge.b_reviews(spark, sf_dir).select(
        F.col("review_id").cast("string").alias("review_id"), "review_score",
        F.col("review_text").alias("review_comment_message"))  # the raw-source column name (F1)
    res = labelling_sample(raw, DRIVER_LEXICON, out_path=f"{tmp_dir}/sheet")
    back = io.read_label_sheet(spark, f"{tmp_dir}/sheet")
    n = res.sheet.count()
    assert 0 < n <= 200 and back.count() == n
    assert set(back.columns) >= {"review_id", "review_score", "review_text", "aspectos_detectados", "to_remove"}
    assert back.filter(F.col("to_remove") != "Não").count() == 0


def test_row_index_hot_key_is_split(spark):
    from aspectra.sources.io import row_index

    # key 0 holds a third of the rows (copies); the index must still be a permutation in key order
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                   (F.col("id") % 7).alias("v")).repartition(8)
    out = row_index(df, ["k"], "index")
    rows = out.select("k", "index").collect()
    assert sorted(r["index"] for r in rows) == list(range(30000))
    by_index = sorted(rows, key=lambda r: r["index"])
    assert all(a.k <= b.k for a, b in zip(by_index, by_index[1:]))
    # the sort the index uses spreads the hot key over several partitions
    tie = [F.xxhash64("k", "v"), F.monotonically_increasing_id()]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")  # keep the 8 range partitions (AQE would merge this small input)
    try:
        sizes = [r["count"] for r in df.orderBy("k", *tie).groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in df.orderBy("k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(key, old)
    assert max(plain) >= 10000 and max(sizes) < 10000


def test_distribution_report_equals_the_verified_queries(spark, sf_dir):
    from aspectra.plans.jobs import distribution_report

    sheet = bridge.b_sheet(spark, sf_dir)
    rep = distribution_report(sheet)
    q = E.queries()
    assert _rows(rep.classes.select("label_idx", "label", "n")) == _rows(q["class_counts"](spark, sf_dir))
    assert rep.total_labels.first()[0] == q["total_labels"](spark, sf_dir).first()[0]
    assert rep.unlabelled.first()[0] == q["unlabelled_count"](spark, sf_dir).first()[0]
    imb = q["imbalance_report"](spark, sf_dir).first()
    got = rep.imbalance.first()
    assert (got.max_count, got.min_positive, got.tier) == (imb.max_count, imb.min_positive, imb.tier)


def test_comparison_report_equals_the_verified_queries(spark, sf_dir):
    from aspectra.plans.catalog_metrics import FT, m7_predictors
    from aspectra.plans.jobs import comparison_report

    rep = comparison_report(bridge.b_text_sheet(spark, sf_dir), m7_predictors(spark, sf_dir), FT)
    assert rep.metrics.count() == 3
    q = E.queries()
    r6 = lambda df, cols: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                                 for r in df.select(*cols).collect())
    cols = ["model", "f1_micro", "f1_macro", "f1_weighted", "exact_match"]
    assert r6(rep.metrics, cols) == r6(q["compare_models"](spark, sf_dir), cols)
    assert r6(rep.gains, ["baseline", "model", "gain_pct"]) == r6(q["relative_gain"](spark, sf_dir),
                                                                   ["baseline", "model", "gain_pct"])
