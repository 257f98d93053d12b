"""W2 and W3 from one pass: the same rows as the steps taken one after another, also where ids repeat."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aspectra.functions.text import sampling_hash
from aspectra.operators import sampling
from aspectra.plans import bridge
from aspectra.plans.sample_plan import balanced_sample
from aspectra.schema import DRIVER_LEXICON

ORDER = ("a", "b", "c")
QUOTAS = {"a": 8, "b": 6, "c": 10}


def step_by_step(rows, target):
    """``(id, mark, step, band, rank)``, each step over all rows."""
    quota, used = [], set()
    for step, aspect in enumerate(ORDER, 1):
        picked = []
        for band, scores in (("neg", (1, 2)), ("pos", (4, 5))):
            pool = sorted((r for r in rows if r[f"tem_{aspect}"] and r["review_score"] in scores and r["review_id"] not in used),
                          key=lambda r: (r["h"], r["review_id"], r["tie"]))
            picked += [(r["review_id"], r["mark"], step, band, k) for k, r in enumerate(pool[:QUOTAS[aspect] // 2], 1)]
        used |= {p[0] for p in picked}
        quota += picked
    fill, per = [], (target - len(quota)) // 5
    for s in range(1, 6):
        pool = sorted((r for r in rows if r["review_score"] == s and r["review_id"] not in used), key=lambda r: (r[f"h{s}"], r["review_id"], r["tie"]))
        fill += [(r["review_id"], r["mark"], len(ORDER) + 1, None, k) for k, r in enumerate(pool[:max(per, 0)], 1)]
    return quota, fill


def some_candidates(spark, n, ids, hot=0, seed=0):
    r = random.Random(seed)
    rows = [(r.randrange(ids), r.choice([None, 1, 2, 3, 4, 5]), r.random() < 0.5, r.random() < 0.4, r.random() < 0.3, i) for i in range(n)]
    rows += [(1, r.choice([1, 5]), True, True, True, n + i) for i in range(hot)]
    return spark.createDataFrame(rows, "review_id long, review_score int, tem_a boolean, tem_b boolean, tem_c boolean, mark int").repartition(5)


@pytest.mark.parametrize("n,ids,hot", [(300, 400, 0), (300, 25, 0), (80, 6, 0), (200, 300, 400), (6, 3, 0), (0, 1, 0)])
def test_one_pass_takes_the_rows_of_the_steps(spark, n, ids, hot):
    df = some_candidates(spark, n, ids, hot)
    others = [c for c in df.columns if c != "review_id"]
    rows = df.select("*", sampling_hash("review_id", 42).alias("h"), F.xxhash64(*others).alias("tie"),
                     *[sampling_hash("review_id", F.lit(42 + s)).alias(f"h{s}") for s in range(1, 6)]).collect()
    quota, fill = sampling.quota_and_fill(df, order=ORDER, quotas=QUOTAS, target=60)
    want = step_by_step(rows, 60)
    got = lambda f, band: sorted((r["review_id"], r["mark"], r["step"], r["band"] if band else None, r["sample_rank"]) for r in f.collect())
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(got(quota, True), key=key) == sorted(want[0], key=key)
    assert sorted(got(fill, False), key=key) == sorted(want[1], key=key)
    assert sorted(map(tuple, sampling.quota_sample(df, order=ORDER, quotas=QUOTAS).collect())) == sorted(map(tuple, quota.collect()))
    alone = sampling.fill_to_target(df, quota, target=60, step=len(ORDER) + 1)
    assert sorted(map(str, alone.collect())) == sorted(map(str, fill.collect()))


def test_null_ids_are_never_excluded(spark):
    rows = [(None, 1, True, True, True, i) for i in range(30)]
    df = spark.createDataFrame(rows, "review_id long, review_score int, tem_a boolean, tem_b boolean, tem_c boolean, mark int")
    assert sampling.quota_sample(df, order=ORDER, quotas=QUOTAS).groupBy("step").count().orderBy("step").collect() == [(1, 4), (2, 3), (3, 5)]


def test_the_texts_are_scanned_once_for_all_steps(spark, sf_dir, monkeypatch):
    plans = []
    collect = type(spark.range(1)).collect

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(spark.range(1)), "collect", noted)
    res = balanced_sample(bridge.b_reviews(spark, sf_dir), DRIVER_LEXICON)
    assert sum(p.count("FileScan") for p in plans) == 1 and "WindowGroupLimit" in plans[0]
    assert "FileScan" not in res.final._jdf.queryExecution().executedPlan().toString()
