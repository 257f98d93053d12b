"""Operator 6: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal components is learned on a bounded sample so that the signs of the
rotated components are balanced and lose little; the signs are a vector's binary code.  The code is
cut into substrings, one table each.  A vector is filed in a table under its substring and every
substring one bit away, so two vectors whose substrings differ in at most two bits meet there.  A
pair that meets several times counts in one place only: the first table in which it meets, in the
smallest cell the two share.

How far apart the codes of a linked pair are depends on the data (a common mean, few dimensions), so it is
measured: partners at exactly the threshold are made for the sample's vectors, in random directions and
towards other vectors, and the sample's own linked pairs are added; further rotations with tables of their
own are learned until ``RECALL`` of each kind of pairs meet (at most ``ROTATIONS``).  Every other rotation is
learned about the origin instead of the mean, for vectors that lie close around the mean.  The code distance
that each rotation allows is taken from the made pairs, five deviations out.

Cells are first compared by code alone; only vectors with a partner there are looked up and compared by
cosine in double precision.  Large cells are split into pairs of blocks, links are counted inside the task,
and a task hands on no more than one edge per vector, so no list of all pairs is made.

The rotations are fitted on at most about ``SAMPLE`` vectors (chosen by a hash of ``vec_id``); every
vector is indexed.  Vectors of each length are searched among themselves, with rotations of their own.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing; vectors of different lengths do not link; rows with the same ``vec_id`` are one vector (the
largest by bytes, if they differ); rows without a ``vec_id`` link with nothing; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.tables import Roots, blocks, by_group, connected_components, grouped, written

#: vectors the rotations are fitted on, over all lengths; at least LEAST of each length
SAMPLE, LEAST = 20_000, 500
#: share of pairs at the threshold that must meet, and the rotations tried for it
RECALL, ROTATIONS = 0.997, 16
#: made pairs to measure that on
TRIALS = 4_000
CODE_BITS, SUBSTRING_BITS = 64, 16
#: rows of a cell compared in one block
BLOCK = 4096


def fit_rotation(x: np.ndarray, bits: int = CODE_BITS, rounds: int = 50, seed: int = 7, centre: bool = True):
    """``(mean, projection)`` such that ``sign((v - mean) @ projection)`` is the code."""
    mean = x.mean(axis=0) if centre else np.zeros(x.shape[1])
    centred = x - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    p = vectors[:, ::-1][:, :bits]
    v = centred @ p
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((p.shape[1],) * 2))[0]
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return mean, p @ r


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of at most 64 bits as signed integers, bit i for component i."""
    signs = (x - mean) @ projection >= 0
    weight = np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64)
    return (signs * weight).sum(axis=1, dtype=np.uint64).view(np.int64)


@dataclass
class Model:
    """The rotations of one length, and for each the bits in which linked codes differ at most."""

    rotations: list
    bits: int
    radius: list[int]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """``[rows, rotations]``"""
        return np.stack([encode(x, *r) for r in self.rotations], axis=1)


def threshold_pairs(x: np.ndarray, cosine: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and partners at that cosine: half in random directions, half towards other vectors."""
    r = np.random.default_rng(seed)
    a = x[r.integers(0, len(x), TRIALS)]
    to = np.where(np.arange(TRIALS)[:, None] % 2, r.standard_normal(a.shape), x[r.integers(0, len(x), TRIALS)])
    to = to - (to * a).sum(axis=1, keepdims=True) * a
    size = np.sqrt((to * to).sum(axis=1, keepdims=True))
    some = size[:, 0] > 1e-9
    a, to = a[some], to[some] / size[some]
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * to


def linked_pairs(x: np.ndarray, cosine: float, rows: int = 3000, seed: int = 13) -> np.ndarray:
    """Some pairs of the vectors themselves that link, at most TRIALS."""
    r = np.random.default_rng(seed)
    some = r.permutation(len(x))[:rows]
    at = np.argwhere(np.triu(x[some] @ x[some].T >= cosine, 1))
    return some[at[r.permutation(len(at))[:TRIALS]]]


def fit(x: np.ndarray, cosine: float) -> Model:
    """Rotations until pairs at the threshold meet."""
    bits = min(CODE_BITS, x.shape[1])
    a, b = threshold_pairs(x, cosine)
    kind = np.arange(len(a)) % 2
    own = linked_pairs(x, cosine)
    a, b, kind = np.concatenate([a, x[own[:, 0]]]), np.concatenate([b, x[own[:, 1]]]), np.r_[kind, np.full(len(own), 2)]
    made = kind < 2
    met, rotations, radius = np.zeros(len(a), dtype=bool), [], []
    while True:
        rotations.append(fit_rotation(x, bits, seed=7 + len(rotations), centre=len(rotations) % 2 == 0))
        apart = encode(a, *rotations[-1]).view(np.uint64) ^ encode(b, *rotations[-1]).view(np.uint64)
        d = _popcount(apart)
        radius.append(min(bits, math.ceil(d[made].mean() + 5 * d[made].std())) if made.any() else bits)
        for t in range(0, bits, SUBSTRING_BITS):
            met |= (d <= radius[-1]) & (_popcount((apart >> np.uint64(t)) & np.uint64((1 << SUBSTRING_BITS) - 1)) <= 2)
        found = min((met[kind == k].mean() for k in (0, 1, 2) if (kind == k).any()), default=1.0)
        if found >= RECALL or len(rotations) == ROTATIONS:
            return Model(rotations, bits, radius)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)``: one row per vector that can link, its components as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id is not null").filter((F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0))
    return some.groupBy("vec_id").agg(F.max("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """A row for every rotation, table and cell of a vector, with all its codes; a cell holds one length."""
    order = {w: k for k, w in enumerate(sorted(models))}
    most = max(len(m.rotations) for m in models.values())

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                widths = batch.column("_w").to_numpy()
                for w in np.unique(widths):
                    mine = batch.filter(pa.array(widths == w))
                    m = models[int(w)]
                    codes = m.codes(_unit(_matrix(mine.column("v"), int(w)))).view(np.uint64)
                    cells = []
                    for s in range(codes.shape[1]):
                        for t in range(0, m.bits, SUBSTRING_BITS):
                            width = min(SUBSTRING_BITS, m.bits - t)
                            sub = (codes[:, s] >> np.uint64(t)) & np.uint64((1 << width) - 1)
                            at = np.uint64((order[int(w)] << 48) + ((s * (CODE_BITS // SUBSTRING_BITS) + t // SUBSTRING_BITS) << 32))
                            cells += [(sub ^ np.uint64(d)) + at for d in (0, *(1 << k for k in range(width)))]
                    n = len(cells)
                    padded = np.zeros((len(codes), most), np.uint64)
                    padded[:, :codes.shape[1]] = codes
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(mine.column("vec_id").to_numpy(), n)), pa.array(np.concatenate(cells).view(np.int64)),
                         *[pa.array(np.tile(padded[:, s].view(np.int64), n)) for s in range(most)]],
                        ["vec_id", "cell", *[f"code{s}" for s in range(most)]])

    return vectors.mapInArrow(run, "vec_id long, cell long, " + ", ".join(f"code{s} long" for s in range(most)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Places:
    """Where a pair of codes is counted."""

    def __init__(self, models: dict[int, Model]):
        order = sorted(models)
        self.bits = np.array([models[w].bits for w in order])
        most = max(len(models[w].rotations) for w in order)
        self.radius = np.array([models[w].radius + [0] * (most - len(models[w].radius)) for w in order])
        self.rotations = np.array([len(models[w].rotations) for w in order])

    def here(self, a: list[np.ndarray], b: list[np.ndarray], cell: np.ndarray) -> np.ndarray:
        """Pairs near in a rotation whose place to count is this cell; ``a``, ``b``: the codes by rotation."""
        kind = (cell >> np.uint64(48)).astype(np.int64)
        table = ((cell >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
        place = cell & np.uint64((1 << SUBSTRING_BITS) - 1)
        out = np.zeros(len(cell), dtype=bool)
        open_pair = np.ones(len(cell), dtype=bool)
        mask = np.uint64((1 << SUBSTRING_BITS) - 1)
        for s in range(len(a)):
            near = open_pair & (s < self.rotations[kind]) & (_popcount(a[s] ^ b[s]) <= self.radius[kind, s])
            for t in range(0, CODE_BITS, SUBSTRING_BITS):
                x, y = (a[s] >> np.uint64(t)) & mask, (b[s] >> np.uint64(t)) & mask
                diff = x ^ y
                d = _popcount(diff)
                low = diff & (~diff + np.uint64(1))
                shared = np.where(d == 2, np.minimum(x ^ low, y ^ low), np.minimum(x, y))
                meets = near & open_pair & (d <= 2) & (t < self.bits[kind])
                out |= meets & (table == s * (CODE_BITS // SUBSTRING_BITS) + t // SUBSTRING_BITS) & (place == shared)
                open_pair &= ~meets
        return out


def _pairs(t: pa.Table, places: _Places):
    """Index pairs of one chunk of whole groups that are to be counted there, one offset at a time."""
    cell, i, j, blk = (t.column(c).to_numpy() for c in ("cell", "i", "j", "b"))
    codes = [t.column(c).to_numpy().view(np.uint64) for c in t.column_names if c.startswith("code")]
    cell = cell.view(np.uint64)
    at = np.arange(len(cell))
    d = 0
    while len(at):
        d += 1
        at = at[at + d < len(cell)]
        to = at + d
        at = at[(cell[at] == cell[to]) & (i[at] == i[to]) & (j[at] == j[to])]
        a = at[(i[at] == j[at]) | (blk[at] != blk[at + d])]
        if len(a):
            a = a[places.here([c[a] for c in codes], [c[a + d] for c in codes], cell[a])]
            if len(a):
                yield a, a + d


_KEYS = ["cell", "i", "j"]


def _with_partner(places: _Places):
    def run(batches):
        for t in by_group(batches, _KEYS):
            has = np.zeros(t.num_rows, dtype=bool)
            for a, b in _pairs(t, places):
                has[a] = True
                has[b] = True
            yield from t.filter(pa.array(has)).to_batches()

    return run


def _links(places: _Places, cosine: float):
    def run(batches):
        for whole in by_group(batches, _KEYS):
            widths = whole.column("_w").to_numpy()
            for w in np.unique(widths):
                t = whole.filter(pa.array(widths == w)).combine_chunks()
                v = _unit(_matrix(t.column("v").chunk(0), int(w)))
                n = np.zeros(t.num_rows, np.int64)
                roots = Roots(t.num_rows)
                for a, b in _pairs(t, places):
                    for k in range(0, len(a), 65_536):
                        x, y = a[k:k + 65_536], b[k:k + 65_536]
                        ok = np.einsum("ij,ij->i", v[x], v[y]) >= cosine
                        np.add.at(n, x[ok], 1)
                        np.add.at(n, y[ok], 1)
                        roots.join(x[ok], y[ok])
                some = np.flatnonzero(n)
                vec = t.column("vec_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(vec[some]), pa.array(n[some]), pa.array(vec[roots.root[some]])],
                                                 ["vec_id", "n", "other"])

    return run


def fitted(found: DataFrame, cosine: float, sample: int = SAMPLE) -> dict[int, Model]:
    """The model of every length of which there are two vectors; the driver holds the sample of one length at a time."""
    counts = {r["_w"]: r["count"] for r in found.groupBy("_w").count().filter("count > 1").collect()}
    share = max(LEAST, sample // max(1, len(counts)))
    out = {}
    for w, n in sorted(counts.items()):
        # a hash of the id chooses about ``share`` vectors
        some = found.filter((F.col("_w") == w) & (F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, share / n))))
        x = np.array([r.v for r in some.select("v").limit(2 * share).collect()]).reshape(-1, w)
        out[w] = fit(_unit(x) if len(x) else np.eye(w), cosine)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding)``."""
    found = written(usable(vectors).withColumn("_w", F.size("v")), "vectors")
    models = fitted(found, cosine, sample)
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not models:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.lit(True).alias("kept"))
    places = _Places(models)
    found = found.filter(F.col("_w").isin(list(models)))
    cells = _cells(found, models)
    codes = [f"{c} long" for c in cells.columns if c.startswith("code")]
    tasks = blocks(cells, "cell", "vec_id", None, BLOCK)
    active = written(grouped(tasks, _KEYS, _with_partner(places), f"vec_id long, cell long, {', '.join(codes)}, b int, i int, j int"), "cells")
    links = written(grouped(active.join(found, "vec_id"), _KEYS, _links(places, cosine), "vec_id long, n long, other long"), "links")
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    nodes = connected_components(links.select(F.col("vec_id").alias("src"), F.col("other").alias("dst")))
    return (ids.join(counts, "vec_id", "left").join(nodes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
