"""The mix: targets, quotas, permutations, and the words taken."""

import random

from pyspark.sql import functions as F

from aspectra.llm import mixing
from helpers import words

SCHEMA = "doc_id long, text string, source string, n_chars long, place int, sid string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rows(seed, n=300, sources=("a", "b", "ç", "B", None, "zz", "")):
    rng = random.Random(seed)
    weights = [9, 3, 1, 1, 2, 0.2, 1]
    return [(d, " ".join(f"w{d}_{k}" for k in range(rng.choice([0, 1, 5, 40, 200, 700]))),
             rng.choices(sources, weights)[0], 7, 1, "x") for d in range(n)]


def test_targets_and_taken_words(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df).collect()
    size = {d: len(words(t)) for d, t, *_ in data}
    per_source = {}
    for d, _, s, *_ in data:
        per_source[s] = per_source.get(s, 0) + size[d]
    want, taken = targets(per_source), {}
    assert len(got) == len(data)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per_source[r.source] and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6, (s, taken[s], t)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_slots_are_a_multinomial_draw_and_hold_each_block_once_a_pass(spark):
    m = mixing.plan(spark.createDataFrame(rows(2, 600), SCHEMA), block=16, shard_slots=256)
    quota = {r.sid: r.quota for r in m.sources.collect()}
    slots = m.slots.collect()
    assert sorted(r.slot for r in slots) == list(range(sum(quota.values())))
    assert len({(r.sid, r.epoch, r.block) for r in slots}) == len(slots) and max(r.epoch for r in slots) <= 1
    per = {}
    for r in slots:
        per[r.shard, r.sid] = per.get((r.shard, r.sid), 0) + 1
    big = max(quota, key=quota.get)
    share = quota[big] / len(slots)
    counts = [per.get((s, big), 0) for s in range(len(slots) // 256)]
    assert len(set(counts)) > 3 and all(abs(c - 256 * share) < 6 * (256 * share) ** 0.5 for c in counts)


def test_permutations(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
        for key in (3, -5):
            x = [r[0] for r in df.withColumn("key", F.lit(key).cast("long")).orderBy("id").select(
                mixing.permuted("id", "n", "key")).collect()]
            assert sorted(x) == list(range(n))
            if n == 1000:
                assert sum(a + 1 == b for a, b in zip(x, x[1:])) < 20 and x != sorted(x)


def test_mixed_documents_hold_the_words_taken(spark):
    df = spark.createDataFrame([*rows(3, 120), (500, None, "a", 0, 1, "x"), (501, "  two\n words ", "only", 3, 1, "x")], SCHEMA)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    texts, n = {r.doc_id: r.text for r in df.collect()}, {}
    for r in out.collect():
        mine = words(r.text)
        n[r.doc_id] = n.get(r.doc_id, 0) + len(mine)
        left = iter(words(texts[r.doc_id]))
        assert all(w in left for w in mine) and r.n_chars == len(r.text)
        if len(mine) == len(words(texts[r.doc_id])):
            assert r.text == texts[r.doc_id]
    assert n == {d: k for d, k in taken.items() if k}


def test_repeated_rows_and_empty_tables(spark):
    data = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", "s"), (None, "f g", "s"), (2, None, None), (2, "", "t")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 2), (0, 2), (1, 3), (1, 3), (2, 0), (2, 0)]
    assert sum(r.taken for r in got) <= 20 and mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mixed_documents(df.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix(df.filter("text is null or text = ''")).collect()} == {0}


def test_small_sources_meet_their_targets(spark):
    rng = random.Random(4)
    sizes = {f"s{k:02}": rng.randrange(16, 52) for k in range(20)}
    data = [(100 * k + j, " ".join(f"w{j}_{i}" for i in range(m)), s) for k, (s, n) in enumerate(sizes.items())
            for j, m in enumerate([n // 3, n - n // 3])]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    want, taken = targets(sizes), {}
    for r in mixing.mix(df).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in want.items())
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(df).collect()) == sum(taken.values())
