"""ITQ near-duplicates of vectors against brute force."""

import numpy as np
import pytest

from aspectra.llm import itq
from helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(vectors, cosine=0.95):
    ids = sorted(vectors)
    x = np.array([np.array(vectors[i], np.float32) for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b]
    comp = components(ids, links)
    return {i: (int(near[k].sum()) - 1, comp[i]) for k, i in enumerate(ids)}, len(links)


def made(n_clusters=12, size=12, noise=0.02, dim=64, seed=0, lone=400):
    rng = np.random.default_rng(seed)
    rows = [c + rng.standard_normal(dim) * noise for c in rng.standard_normal((n_clusters, dim)) / 8 for _ in range(size)]
    rows += list(rng.standard_normal((lone, dim)))
    ids = rng.permutation(len(rows) * 3)[:len(rows)]
    return {int(i): [float(v) for v in np.float32(r)] for i, r in zip(ids, rows)}


def run(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(df).collect()}


def test_clusters(spark):
    vectors = made()
    want, links = brute(vectors)
    assert links > 300 and run(spark, vectors) == want


def test_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 10)
    vectors = made(2, 60, lone=50, seed=1)
    assert run(spark, vectors) == brute(vectors)[0]


def test_recall_at_the_threshold(spark):
    vectors = made(60, 8, noise=0.0285, seed=2)  # cosines around 0.95
    want, links = brute(vectors)
    got = run(spark, vectors)
    found = sum(n for n, _ in got.values()) / 2
    assert 0.9 * links <= found <= links and links > 200
    assert all(got[i][0] <= want[i][0] for i in want)


def test_whole_small_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in rows}
    assert run(spark, vectors) == brute(vectors)[0]


def test_codes_are_balanced_and_near_vectors_get_near_codes():
    x = itq._unit(np.random.default_rng(0).standard_normal((2000, 64)) @ np.diag(np.linspace(2, 0.2, 64)))
    mean, p = itq.fit_rotation(x)
    code = itq.encode(x, mean, p).view(np.uint64)
    ones = ((code[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).mean(axis=0)
    assert abs(ones - 0.5).max() < 0.1
    near = itq.encode(itq._unit(x + 0.002), mean, p).view(np.uint64)
    assert np.bitwise_count(code ^ near).mean() < 3 < 25 < np.bitwise_count(code ^ np.roll(code, 1)).mean()


def test_defined_cases(spark):
    a, b = [1.0] * 8, [1.0] * 7 + [1.01]
    rows = [(1, a), (2, b), (3, None), (4, []), (5, [0.0] * 8), (6, [1.0] * 7 + [None]), (7, [float("nan")] * 8),
            (8, [float("inf")] * 8), (9, [1.0] * 5), (2, b), (None, a), (10, [-1.0] * 8), (11, [v * 1e30 for v in a])]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    out = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got)
    linked = {1: 2, 2: 2, 11: 2}
    assert out == sorted([(i or 0, linked.get(i, 0), 1 if i in linked else i, i not in (2, 11)) for i, _ in rows])
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    none = itq.near_duplicates(spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in none.collect()] == [(1, 0, 1, True)]


def test_vectors_of_every_length_are_searched(spark):
    rows = {i: [1.0, 0.01 * i, 0.02] for i in range(5)} | {10 + i: [2.0, 0.1, 0.01 * i, 0.0] for i in range(4)}
    rows |= {20: [1.0], 21: [-1.0], 22: [3.0], 30: [1.0] * 6}
    got = run(spark, rows)
    assert {i: got[i] for i in range(5)} == {i: (4, 0) for i in range(5)}
    assert {i: got[i] for i in range(10, 14)} == {i: (3, 10) for i in range(10, 14)}
    assert got[20] == (1, 20) and got[22] == (1, 20) and got[21] == (0, 21) and got[30] == (0, 30)


def near_the_threshold(dim, common, n=1500, seed=4, cosine=0.9525):
    """Vectors with a common mean of that squared norm, each with a partner at the cosine."""
    r = np.random.default_rng(seed)
    mean = np.zeros(dim)
    mean[0] = np.sqrt(common)
    x = mean + r.standard_normal((n, dim)) * np.sqrt((1 - common) / dim)
    x = itq._unit(x)
    to = r.standard_normal(x.shape)
    to -= (to * x).sum(axis=1, keepdims=True) * x
    to /= np.linalg.norm(to, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine ** 2) * to


@pytest.mark.parametrize("dim", [16, 32, 64, 384])
@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_pairs_at_the_threshold_meet(dim, common):
    x, y = near_the_threshold(dim, common)
    model = itq.fit(np.concatenate([x, y]), 0.95)
    a, b = model.codes(x).view(np.uint64), model.codes(y).view(np.uint64)
    met = np.zeros(len(x), dtype=bool)
    for s in range(a.shape[1]):
        apart = a[:, s] ^ b[:, s]
        for t in range(0, model.bits, 16):
            met |= (np.bitwise_count(apart) <= model.radius[s]) & (np.bitwise_count((apart >> np.uint64(t)) & np.uint64(0xFFFF)) <= 2)
    assert met.mean() >= 0.99, (len(model.rotations), met.mean())


def test_recall_with_a_common_mean_and_few_dimensions(spark):
    x, y = near_the_threshold(16, 0.0, n=300, seed=9)
    u, v = near_the_threshold(64, 0.8, n=300, seed=10)
    vectors = {i: [float(c) for c in row] for i, row in enumerate([*x, *y])}
    vectors |= {10_000 + i: [float(c) for c in row] for i, row in enumerate([*u, *v])}
    got = run(spark, vectors)
    for low, dim in ((0, 16), (10_000, 64)):
        part = {i: w for i, w in vectors.items() if low <= i < low + 10_000}
        want, links = brute(part)
        found = sum(got[i][0] for i in part) / 2
        assert links >= 300 and 0.99 * links <= found <= links


def test_a_cluster_at_the_mean_is_found(spark):
    r = np.random.default_rng(6)
    centre = np.ones(64)
    vectors = {i: [float(c) for c in centre + 0.01 * r.standard_normal(64)] for i in range(150)}
    vectors |= {1000 + i: [float(c) for c in r.standard_normal(64)] for i in range(20)}
    assert run(spark, vectors) == brute(vectors)[0]
