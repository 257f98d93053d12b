"""File-order positions (W15, S9), failing models (X13), label states as VARIANT (X20), and joins of bucketed tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.functions.labels import label_variant, variant_field
from aspectra.operators import joins, train
from aspectra.operators.predictors import ModelPredictor, SafeModelPredictor, isolating
from aspectra.sources import io


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def several_files(spark, path, n=7, rows=501):
    """Files of different sizes, in no order of the id."""
    df = spark.range(rows).select((F.col("id") * 37 % rows).alias("review_id"), F.concat(F.lit("text "), "id").alias("review_text"))
    df.repartition(n, F.col("review_id") % 11).write.parquet(path)
    return spark.read.parquet(path)


def test_positions_over_several_files(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq

    df = several_files(spark, f"{tmp_dir}/d")
    got = {r["review_id"]: r["index"] for r in io.file_row_index(df).collect()}
    want = [i for f in sorted(glob.glob(f"{tmp_dir}/d/part-*.parquet")) for i in pq.read_table(f).column("review_id").to_pylist()]
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(501))


def test_the_feed_neither_sorts_nor_shuffles_texts(spark, tmp_dir):
    feed = io.labelling_feed(several_files(spark, f"{tmp_dir}/d"))
    p = plan(feed)
    # the only rows that move are the files' sizes
    assert "text" not in " ".join(ln for ln in p.splitlines() if "Exchange" in ln or "Sort" in ln)
    assert feed.count() == 501 and feed.filter("get_json_object(json, '$.index') <> index").count() == 0


def test_many_files_are_joined_without_a_broadcast_hint(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(io, "BROADCAST_FILES", 2)
    df = several_files(spark, f"{tmp_dir}/d")
    assert sorted(r["index"] for r in io.file_row_index(df).collect()) == list(range(501))


def test_sources_without_positions_are_ordered_by_id(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "review_id long, review_text string")
    assert not io.has_file_positions(df)
    assert [tuple(r) for r in io.labelling_feed(df).select("id", "index").orderBy("index").collect()] == [("1", 0), ("2", 1), ("3", 2)]


def test_one_raising_text_in_a_thousand(spark):
    texts = [f"text {i} " + "x" * (1 if (len(f"text {i} ") + 1) % 13 else 2) for i in range(1000)]
    texts[417] = "y" * 26
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    model = train.counting_linear_model()
    safe = SafeModelPredictor(train.brittle(model), text="t", batch_size=1000).transform(df)
    plain = ModelPredictor(model, text="t", batch_size=1000).transform(df)
    good = {r["id"]: r["probs"] for r in plain.collect()}
    rows = safe.collect()
    assert [r["id"] for r in rows if r["failed"]] == [417]
    assert all(r["probs"] == ([0.0] * 8 if r["failed"] else good[r["id"]]) for r in rows)


def test_failing_batches_are_halved():
    calls = []

    def make():
        def predict(texts):
            calls.append(len(texts))
            if "bad" in list(texts):
                raise KeyError("bad")
            return np.ones((len(texts), 2))
        return predict

    out = isolating(make, 2)()(np.array(["x"] * 1023 + ["bad"]))
    assert out[:, 2].sum() == 1 and out[1023].tolist() == [0, 0, 1] and len(calls) == 21
    assert isolating(lambda: lambda t: np.ones((len(t), 3)), 2)()(np.array(["a", "b"]))[:, 2].tolist() == [1, 1]  # wrong width
    assert isolating(make, 2)()(np.array([], dtype=object)).shape == (0, 3)


def test_a_variant_keeps_keys_that_no_schema_names(spark, tmp_dir):
    rows = [('{"categories": {"Entrega": "Positivo", "Produto": "Neutro"}, "toRemove": true, "note": [1, {"x": null}]}',), ("not json",), (None,), ("{}",)]
    df = spark.createDataFrame(rows, "json string").select(label_variant("json").alias("v"), "json")
    df.write.parquet(f"{tmp_dir}/v")
    back = spark.read.parquet(f"{tmp_dir}/v")
    got = back.select("json", variant_field("v", "$.categories.Entrega", "string").alias("e"), variant_field("v", "$.toRemove", "boolean").alias("r"),
                      variant_field("v", "$.note[0]", "int").alias("n"), variant_field("v", "$.categories", "int").alias("wrong"),
                      F.to_json("v").alias("j")).collect()
    by = {r["json"]: r for r in got}
    assert by[rows[0][0]][1:5] == ("Positivo", True, 1, None)
    assert by["not json"]["j"] is None and by[None]["j"] is None and by["{}"][1:5] == (None,) * 4


@pytest.fixture()
def bucketed(spark):
    names = ["t_reviews_b", "t_scores_b", "t_states_b"]
    ids = spark.range(2000).withColumnRenamed("id", "review_id")
    state = F.struct(F.create_map(F.lit("Produto"), F.lit("Positivo")).alias("categories"), F.lit(False).alias("toRemove"))
    frames = [ids.withColumn("review_text", F.lit("x")), ids.withColumn("review_score", (F.col("review_id") % 5).cast("int")),
              ids.filter("review_id % 3 = 0").select(F.col("review_id").cast("string").alias("review_id"), state.alias("state"))]
    frames[0] = frames[0].withColumn("review_id", F.col("review_id").cast("string"))
    frames[1] = frames[1].withColumn("review_id", F.col("review_id").cast("string"))
    for name, df in zip(names, frames):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        io.write_bucketed(df, name, "review_id", 4)
    yield [spark.table(n) for n in names]
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_bucketed_tables_join_without_an_exchange(spark, bucketed):
    reviews, scores, states = bucketed
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (joins.attach_scores(reviews, scores), joins.export_join(reviews, states)):
            p = plan(df)
            assert "SortMergeJoin" in p and "Exchange" not in p, p
            assert df.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
