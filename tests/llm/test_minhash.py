"""MinHash near-duplicates against brute force, and the parts of the method."""

import random

import numpy as np
import pytest

from aspectra.llm import minhash
from aspectra.llm.tables import connected_components
from helpers import components, similar_components

SCHEMA = "doc_id long, text string, leader string, key int"


def check(spark, texts, size=4, rows=None):
    df = spark.createDataFrame(rows or [(d, t, "x", 1) for d, t in texts.items()], SCHEMA)
    got = minhash.near_duplicates(df, size=size).collect()
    comp, n = similar_components(texts, size)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        (d, n[d], comp[d], comp[d] == d) for d in (texts if rows is None else [r[0] for r in rows]))


def mutated(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def groups(seed=3):
    """Chains and groups of copies at all distances around the threshold, and unrelated texts."""
    rng = random.Random(seed)
    texts, d = {}, 0
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for k in (0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6, 8, 12):
            texts[d] = mutated(rng, base, k)
            d += 1
    for _ in range(20):
        texts[d] = " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 60)))
        d += 1
    ids = list(texts)
    rng.shuffle(ids)
    return dict(zip(ids, texts.values()))


def test_groups_around_the_threshold(spark):
    check(spark, groups())


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(minhash, "LEADER_ROWS", 2)
    check(spark, groups(5))


def test_whole_small_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(spark, {r.doc_id: r.text for r in rows})


def test_defined_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    texts = {5: None, 3: "", 9: " \t\n", 2: "A b", 7: "a  B", 8: "a b c", 4: "a b c d", 6: "A B C D", 1: long, 0: long + " x"}
    check(spark, texts)
    check(spark, {7: "a b", 2: "a B"}, rows=[(7, "a b", None, None), (7, "a b", "q", 2), (2, "a B", "q", None)])
    none = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in none.collect()) == [
        (False, 1, True), (True, None, True), (True, None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketch_fills_every_coordinate_and_estimates_the_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1200]), np.unique(pool[300:])
    sets = [a, b, a[:1], a[:3]]
    s = minhash.sketch(np.concatenate(sets), np.repeat(np.arange(4), [len(x) for x in sets]), 4, 640)
    assert not (s == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    assert abs((s[0] == s[1]).mean() - 900 / 1500) < 0.08
    assert (minhash.sketch(a[::-1].copy(), np.zeros(len(a), int), 1, 640)[0] == s[0]).all()


@pytest.mark.parametrize("n", [0, 1, 200])
def test_components(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 2 // 3)]
    links += [(1000 + i, 1001 + i) for i in range(60) if n > 1]  # a long path
    got = connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    nodes = {x for e in links for x in e}
    assert sorted(map(tuple, got)) == sorted(components(nodes, links).items())


def test_blocks_are_bounded_by_members(spark):
    main, others = range(9000), range(9000, 9040)
    rows = [(1, d, 12, 0) for d in main] + [(1, d, 12, d % 3 + 1) for d in others] + [(2, d, 12, d) for d in range(3)]
    tasks = minhash.block_tasks(spark.createDataFrame(rows, "key long, doc_id long, n_shingles long, component long"))
    met, members = {}, {}
    for r in tasks.collect():
        members.setdefault((r.key, r.i, r.j), []).append(r)
    assert max(map(len, members.values())) < 2.2 * minhash.BLOCK_MEMBERS
    assert sum(map(len, members.values())) < 2 * len(rows)
    for (key, i, j), m in members.items():
        few = [r for r in m if key == 2 or r.component]
        for x in few:
            for y in m:
                if x.component != y.component and (i == j or x.b != y.b):
                    pair = (key, min(x.doc_id, y.doc_id), max(x.doc_id, y.doc_id))
                    met.setdefault(pair, set()).add((i, j))
    assert all(len(v) == 1 for v in met.values())
    apart = sum(1 for a in others for b in others if a < b and a % 3 != b % 3)
    assert len(met) == len(main) * len(others) + apart + 3


def test_a_large_group_of_short_texts_next_to_another_component(spark):
    texts = {d: " ".join([*(f"w{k}" for k in range(14)), f"n{d}"]) for d in range(5000)}
    texts[9000] = " ".join([*(f"w{k}" for k in range(12)), "x", "y"])
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, size=4).collect()}
    assert got == {d: 9000 if d == 9000 else 0 for d in texts}


def test_an_id_with_several_texts_links_by_each_of_them(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(30):
        a, b, c = ([f"{k}{g}_{rng.randrange(10 ** 6)}" for _ in range(60)] for k in "abc")
        i = 10 * g + rng.randrange(3)
        ids = [i, 10 * g + 4, 10 * g + 5, 10 * g + 7]
        rows += [(ids[0], " ".join(a)), (ids[0], " ".join(b)), (ids[1], mutated(rng, a, 1)), (ids[2], mutated(rng, b, 1)), (ids[3], " ".join(c))]
        want |= {ids[0]: i, ids[1]: i, ids[2]: i, ids[3]: ids[3]}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles == 57 for r in got)


def test_ids_that_share_two_texts_and_empty_texts(spark):
    rows = [(3, "p q r s t u"), (3, "v w x y z a"), (2, "v w x y z a"), (5, "p q r s t u"), (5, ""), (6, None), (6, "p q r s t u"), (1, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 2, 5: 2, 6: 2}
    assert sorted((r.doc_id, r.n_shingles) for r in got) == [(1, 0), (2, 3), (3, 3), (3, 3), (5, 0), (5, 3), (6, 0), (6, 3)]
