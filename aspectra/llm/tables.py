"""Written intermediate tables, connected components, and grouped streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.session import drop_path, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, a lost executor loses nothing."""
    return at_path(df, name)[0]


def at_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs started inside send Python batches of about ``size`` bytes, whatever the length of a row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (src, dst)``: the smallest node it can reach.

    Alternating large-star and small-star rounds; each round is two grouped minima joined back, its
    result written to the shared folder.  Hubs are pre-aggregated and their joins can be split.
    An edge from a node to itself makes a component of one.
    """
    spark = edges.sparkSession
    u, v = F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    stars, path = at_path(edges.filter("src <> dst").select(u, v).distinct(), "edges")
    seen = _signature(stars)
    while seen[0]:
        nxt, new_path = at_path(_small_star(_large_star(stars)), "edges")
        now = _signature(nxt)
        drop_path(spark, path)
        stars, path, done, seen = nxt, new_path, now == seen, now
        if done:
            break
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.join(found.select("node"), "node", "left_anti").union(roots).distinct()
    return found.union(alone)


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1_000_003)).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def by_group(batches: Iterable[pa.RecordBatch], keys: list[str],
             rows_at_once: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; at least one group each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows_at_once:
            continue
        t = pa.Table.from_batches(held)
        cut = int(group_starts(t, keys)[-1])
        if cut:
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).combine_chunks().to_batches()
            n = t.num_rows - cut
        rows_at_once = max(rows_at_once, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def blocks(members: DataFrame, key: str, member: str, weight: str | None, limit: int) -> DataFrame:
    """Split large groups: rows of ``members`` dealt to tasks ``(key, i, j)`` with their block ``b``.

    A group whose rows (or summed ``weight``) exceed ``limit`` is cut into blocks by a hash of
    ``member``; each pair of blocks i <= j is one task, so any two members meet in exactly one task
    (``b`` differs between them where i < j) and no task holds more than about twice ``limit``.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    large = (members.groupBy(key).agg(size.alias("_size")).filter(F.col("_size") > limit)
             .select(key, F.ceil(F.col("_size") / F.lit(limit)).cast("int").alias("_n")))
    df = members.join(large, key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    df = df.withColumn("b", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1),
                                 lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))))
    return df.withColumn("_p", pair).select(*members.columns, "b", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"))


def grouped(df: DataFrame, keys: list[str], fn: Callable, schema: str, order: list[str] | None = None) -> DataFrame:
    """``fn`` (an iterator of Arrow batches) over partitions that hold whole groups, sorted by ``keys``."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(fn, schema)


class Roots:
    """Union-find over 0..n-1 that reads all roots at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            np.minimum.at(self.root, hi, lo)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
