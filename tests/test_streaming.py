"""T2 state over several micro-batches: restart, a second query, and delete-all."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from aspectra.plans import bridge
from aspectra.streaming import scoring as st

KEY, ORDER, VALS = "user_id", ["ts", "event_id"], ["event_id", "event_type", "value", "ts"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(KEY, *VALS).collect())


def _split(spark, sf_dir, tmp_dir, n):
    """The events in ``n`` files, each its own micro-batch with maxFilesPerTrigger=1."""
    ev = bridge.table(spark, sf_dir, "events")
    src = f"{tmp_dir}/src"
    ev.withColumn("_part", F.pmod(F.col("event_id"), F.lit(n))).repartition(n, "_part").drop("_part").write.parquet(src)
    return ev, src


def test_batches_restart_and_new_checkpoint(spark, sf_dir, tmp_dir):
    ev, src = _split(spark, sf_dir, tmp_dir, 5)
    state, ckpt = f"{tmp_dir}/state", f"{tmp_dir}/ckpt"
    out = st.stream_latest_state(spark, src, ev.schema, KEY, ORDER, VALS, state, ckpt, options={"maxFilesPerTrigger": 1})
    expect = _rows(st.latest_by_key(ev, KEY, ORDER, VALS))
    assert _rows(out) == expect
    folders = glob.glob(f"{state}/*/*/")
    assert len(folders) >= 3 and len({f.split("/")[-3] for f in folders}) == 1

    # the same checkpoint again: no new input, nothing written, same state
    again = st.stream_latest_state(spark, src, ev.schema, KEY, ORDER, VALS, state, ckpt)
    assert _rows(again) == expect and len(glob.glob(f"{state}/*/*/")) == len(folders)

    # a new checkpoint restarts its batch numbers and overwrites nothing of the first query
    late = f"{tmp_dir}/late"
    ev.limit(1).withColumn("user_id", F.lit(-7).cast(ev.schema["user_id"].dataType)).write.parquet(late)
    both = _rows(st.stream_latest_state(spark, late, ev.schema, KEY, ORDER, VALS, state, f"{tmp_dir}/ckpt-2"))
    assert len(both) == len(expect) + 1 and set(expect) < set(both)


def test_delete_all_is_a_new_state_folder(spark, sf_dir, tmp_dir):
    ev, src = _split(spark, sf_dir, tmp_dir, 1)
    schema = st.latest_by_key(ev, KEY, ORDER, VALS).schema
    assert st.read_state(spark, f"{tmp_dir}/empty", schema, KEY, ORDER).count() == 0
    one = f"{tmp_dir}/one"
    ev.limit(1).write.parquet(one)
    out = st.stream_latest_state(spark, one, ev.schema, KEY, ORDER, VALS, f"{tmp_dir}/empty", f"{tmp_dir}/ckpt-3")
    assert out.count() == 1


def test_stream_scoring_over_several_batches_equals_batch(spark, sf_dir, tmp_dir):
    from aspectra.plans.catalog_models import _score_probs

    emb = bridge.table(spark, sf_dir, "embeddings")
    src = f"{tmp_dir}/emb"
    emb.repartition(4, "vec_id").write.parquet(src)  # four files -> four micro-batches
    sink, ckpt = f"{tmp_dir}/sink", f"{tmp_dir}/ckpt-t1"
    q = st.stream_score(spark, src, emb.schema, _score_probs, sink, ckpt, options={"maxFilesPerTrigger": 1})
    assert q.lastProgress is not None
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted(tuple(r) for r in _score_probs(emb).collect())
    assert got == want
    # a restart on the same checkpoint with no new files adds nothing (exactly-once file sink)
    st.stream_score(spark, src, emb.schema, _score_probs, sink, ckpt)
    assert spark.read.parquet(sink).count() == len(want)


def test_removals_relabels_and_delete_all_in_one_query(spark, tmp_dir):
    rows = [(1, 10, "a", "set"), (2, 11, "a", "set"), (3, 12, "a", "set"),          # file 0
            (1, 20, None, "delete"), (2, 21, "b", "set"), (None, 22, "x", "set"),    # re-label, removal, no key
            (1, 30, "c", "set"),                                                     # labelled again
            (9, 40, None, "clear"),                                                  # delete-all
            (2, 50, "d", "set"), (4, 51, "e", "set"), (4, 35, "late", "set"), (3, 39, "late", "set")]
    files = [rows[:3], rows[3:6], rows[6:7], rows[7:8], rows[8:]]
    kind = "id long, at long, label string, op string"
    every = spark.createDataFrame(rows, kind)
    gone, clear = F.col("op") == "delete", F.col("op") == "clear"
    state, ckpt, src = f"{tmp_dir}/s", f"{tmp_dir}/c", f"{tmp_dir}/src"
    seen = []
    for k, part in enumerate(files):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)
        out = st.stream_latest_state(spark, src, every.schema, "id", ["at"], ["label", "at"], state, ckpt,
                                     deleted=gone, cleared=clear, merge_every=2)
        so_far = spark.createDataFrame([r for f in files[:k + 1] for r in f], kind)
        batch = st.latest_state(so_far, "id", ["at"], ["label", "at"], gone, clear)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
        seen.append(sorted(r["id"] for r in out.collect()))
    assert seen == [[1, 2, 3], [2, 3], [1, 2, 3], [], [2, 4]]
    # merged after the second and fourth batch: one merged folder and the batch after it are left
    names = sorted(p.split("/")[-2] for p in glob.glob(f"{state}/*/*/"))
    assert len(names) == 2 and "-" in names[0] and names[1] == "000000000004"


def test_a_merge_that_did_not_end_is_not_read(spark, tmp_dir):
    ev = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id long, at long, label string")
    ev.coalesce(1).write.parquet(f"{tmp_dir}/src")
    st.stream_latest_state(spark, f"{tmp_dir}/src", ev.schema, "id", ["at"], ["label"], f"{tmp_dir}/s", f"{tmp_dir}/c")
    own = glob.glob(f"{tmp_dir}/s/*/")[0]
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{own}/000000000000-broken")
    import os

    os.remove(f"{own}/000000000000-broken/_SUCCESS")
    schema = ev.select("id", "label").schema
    assert sorted(map(tuple, st.read_state(spark, f"{tmp_dir}/s", schema, "id", ["at"]).collect())) == [(1, "a"), (2, "b")]


def test_progress_of_every_batch_equals_the_batch_query(spark, tmp_dir):
    from aspectra.operators.joins import labelled_progress

    data = spark.createDataFrame([(i % 40,) for i in range(60)], "review_id long")
    files = [[1, 2, 2, 99], [2, 3, 4], [100], [1, 5, 39, 5]]
    for ids in files:
        spark.createDataFrame([(i,) for i in ids], "review_id long").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/l")
    got = {r["batch"]: r for r in st.stream_progress(spark, f"{tmp_dir}/l", data.schema, "review_id", data, f"{tmp_dir}/p", f"{tmp_dir}/c",
                                                     options={"maxFilesPerTrigger": 1}).collect()}
    assert len(got) == 4
    for k in range(4):
        so_far = spark.createDataFrame([(i,) for f in files[:k + 1] for i in f], "review_id long")
        want = labelled_progress(so_far, data).first()
        assert (got[k]["labelled"], got[k]["total"]) == (want["labelled"], want["total"]) and abs(got[k]["pct"] - want["pct"]) < 1e-9
