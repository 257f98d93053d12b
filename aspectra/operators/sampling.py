"""Seeded sampling, quotas, splits and dedupe.

Sampling order is a hash of (id, seed), with the id as tie-breaker (D13): the
result does not depend on partitioning, so it is the same on 8 threads and on
1000 executors.  Per-group top-n runs as a two-level tree: a partial top-n per
(group, salt bucket), then the final top-n per group over at most
``salt_buckets * n`` rows, so a group holding a third of the data never lands
in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.text import hash_unit_interval, sampling_hash
from aspectra.operators.clean import score_band
from aspectra.schema import (CAP_SEED, QUOTA_ORDER, QUOTAS, SAMPLE_SEED, SAMPLE_TARGET,
                             SHUFFLE_SEED)

SALT_BUCKETS = 256


def with_sample_key(df: DataFrame, key: str = "review_id", seed=SAMPLE_SEED, name: str = "_h") -> DataFrame:
    return df.withColumn(name, sampling_hash(key, seed))


def _tie_break(df: DataFrame, key: str) -> list[Column]:
    # id, then a content hash so duplicate ids still order deterministically
    others = [c for c in df.columns if c not in (key, "_h")]
    return [F.col(key), F.xxhash64(*[F.col(c) for c in others]) if others else F.lit(0)]


def content_salt(df: DataFrame, buckets: int = SALT_BUCKETS) -> Column:
    """A bucket by the whole row: the copies of a hot id that differ in anything are spread out."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets))


def top_n_per_group(df: DataFrame, groups: list[str], n, order: list[Column],
                    salt: Column | None = None, buckets: int = SALT_BUCKETS,
                    rank_col: str = "_rank") -> DataFrame:
    """Rows with rank <= n within each group under ``order``; ``n`` may be a column.

    Two levels: (group, salt) then group.  With a literal ``n`` Spark also
    applies a partial WindowGroupLimit before each shuffle, so only <= n rows
    per group and map task cross the network at either level (a column ``n``
    gets no such limit; the library's callers pass literals).
    """
    nn = n if isinstance(n, Column) else F.lit(int(n))
    if salt is not None and buckets > 1:
        w1 = Window.partitionBy(*groups, salt).orderBy(*order)
        df = df.withColumn(rank_col, F.row_number().over(w1)).filter(F.col(rank_col) <= nn).drop(rank_col)
    w2 = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= nn)


def stratified_sample(df: DataFrame, strata: list[str], n: int, key: str = "review_id",
                      seed=SAMPLE_SEED) -> DataFrame:
    """``min(n, size)`` rows per stratum, without replacement, fixed seed."""
    d = with_sample_key(df, key, seed)
    salt = content_salt(d)
    out = top_n_per_group(d, strata, n, [F.col("_h")] + _tie_break(df, key), salt)
    return out.drop("_h")


def exclude_used(df: DataFrame, used_ids: DataFrame, key: str = "review_id", bounded: bool = False) -> DataFrame:
    """Anti-join against ids already taken.

    ``bounded=True`` is for callers that prove the size of ``used_ids`` (the
    sampler: at most the sum of its quotas), which is then broadcast.  Otherwise
    the join is left to AQE, which broadcasts only if the runtime size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    used = used_ids.select(key).distinct()
    return df.join(F.broadcast(used) if bounded else used, key, "left_anti")


def concat_samples(parts: list[DataFrame]) -> DataFrame | None:
    """Bag union of step samples (None for an empty list)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def used_ids(parts: list[DataFrame], key: str = "review_id") -> DataFrame | None:
    """The set of ids in the given samples."""
    u = concat_samples([p.select(key) for p in parts])
    return u.distinct() if u is not None else None


def _bottom_rows(candidates: DataFrame, key: str, groups: Column, n_ids: int, n_copies: int) -> list:
    """Per group the ``n_copies`` first rows of each of the ``n_ids`` first ids, as rows on the driver.

    ``groups`` is an array of ``(group, h)``: the groups that a row is in, and its place there.  One pass
    over ``candidates``; ranks are limited per (group, salt) before a group comes together, so neither a
    large group nor an id that holds a third of the rows lands in one task.  The result has at most
    ``groups * n_ids * n_copies`` rows, whatever the size of the data.
    """
    tie = _tie_break(candidates, key)[1]
    rows = (candidates.withColumn("_tie", tie).withColumn("_salt", content_salt(candidates))
            .withColumn("_g", F.explode(groups)).withColumn("_group", F.col("_g.group")).withColumn("_h", F.col("_g.h")).drop("_g"))
    for part in (["_group", "_salt"], ["_group"]):
        ids = Window.partitionBy(*part).orderBy("_h", key)
        copies = Window.partitionBy(*part, "_h", key).orderBy("_tie")
        rows = rows.withColumn("_id_rank", F.dense_rank().over(ids)).filter(F.col("_id_rank") <= n_ids)
        rows = rows.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= n_copies)
    found = rows.drop("_salt", "_id_rank", "_copy").collect()
    return sorted(found, key=lambda r: (r["_group"], r["_h"] or "", r[key] is not None, r[key], r["_tie"]))


def _quota_groups(score: str, key: str, order, seed) -> list[Column]:
    band = score_band(score)
    return [F.when(F.col(f"tem_{a}") & band.isNotNull(), F.struct(F.concat_ws("/", F.lit(a), band).alias("group"),
                                                                 sampling_hash(key, seed).alias("h"))) for a in order]


def _fill_groups(score: str, key: str, seed) -> list[Column]:
    return [F.when(F.col(score).isin(1, 2, 3, 4, 5), F.struct(F.concat(F.lit("score/"), F.col(score).cast("string")).alias("group"),
                                                              sampling_hash(key, F.col(score) + F.lit(seed)).alias("h")))]


def _some(groups: list[Column]) -> Column:
    return F.filter(F.array(*groups), lambda g: g.isNotNull())


def _take_quotas(pool: list, key: str, order, quotas: dict) -> list[tuple]:
    """``(row, band, rank, step)``: each step takes the first rows of its two groups whose ids no earlier step took."""
    taken, used = [], set()
    for step, aspect in enumerate(order, start=1):
        picked = []
        for band in ("neg", "pos"):
            mine = [r for r in pool if r["_group"] == f"{aspect}/{band}" and r[key] not in used]
            picked += [(r, band, rank, step) for rank, r in enumerate(mine[:quotas[aspect] // 2], start=1)]
        used |= {r[key] for r, *_ in picked if r[key] is not None}
        taken += picked
    return taken


def _take_fill(pool: list, key: str, taken: set, per: int, step: int) -> list[tuple]:
    out = []
    for score in range(1, 6):
        mine = [r for r in pool if r["_group"] == f"score/{score}" and r[key] not in taken]
        out += [(r, None, rank, step) for rank, r in enumerate(mine[:max(per, 0)], start=1)]
    return out


def _sample_frame(candidates: DataFrame, picked: list[tuple], band: bool) -> DataFrame:
    cols = candidates.columns
    rows = [tuple(r[c] for c in cols) + ((b,) if band else ()) + (rank, step) for r, b, rank, step in picked]
    schema = T.StructType([*candidates.schema.fields, *([T.StructField("band", T.StringType())] if band else []),
                           T.StructField("sample_rank", T.IntegerType()), T.StructField("step", T.IntegerType())])
    return candidates.sparkSession.createDataFrame(rows, schema)


def quota_and_fill(candidates: DataFrame, key: str = "review_id", score: str = "review_score", order=QUOTA_ORDER,
                   quotas: dict = QUOTAS, target: int = SAMPLE_TARGET, seed: int = SAMPLE_SEED) -> tuple[DataFrame, DataFrame]:
    """W2 and W3 from one pass over ``candidates``.

    A step needs the first rows of its groups outside the ids taken before it; these are at most the sum
    of the quotas, so as many more ids per group hold all that any step can take.  The steps then choose
    among these rows, a bounded number, on the driver.
    """
    total = sum(quotas[a] for a in order)
    most = max([quotas[a] // 2 for a in order] + [target // 5])
    groups = _some(_quota_groups(score, key, order, seed) + _fill_groups(score, key, seed))
    pool = _bottom_rows(candidates, key, groups, most + total, most)
    quota = _take_quotas(pool, key, order, quotas)
    taken = {r[key] for r, *_ in quota if r[key] is not None}
    fill = _take_fill(pool, key, taken, (target - len(quota)) // 5, len(order) + 1)
    return _sample_frame(candidates, quota, True), _sample_frame(candidates, fill, False)


def quota_sample(candidates: DataFrame, key: str = "review_id", score: str = "review_score",
                 order=QUOTA_ORDER, quotas: dict = QUOTAS, seed=SAMPLE_SEED) -> DataFrame:
    """Sequential per-aspect quotas, each half negative band + half positive band.

    ``candidates`` has ``key``, ``score`` and a boolean ``tem_<aspect>`` per aspect.
    Step k excludes ids taken by steps 1..k-1 (a row not taken stays eligible).  One pass, as
    :func:`quota_and_fill`.  Output adds ``step`` (1-based), ``band`` and ``sample_rank``.
    """
    total, half = sum(quotas[a] for a in order), max(quotas[a] // 2 for a in order)
    pool = _bottom_rows(candidates, key, _some(_quota_groups(score, key, order, seed)), half + total, half)
    return _sample_frame(candidates, _take_quotas(pool, key, order, quotas), True)


def fill_to_target(candidates: DataFrame, quota_part: DataFrame, key: str = "review_id",
                   score: str = "review_score", target: int = SAMPLE_TARGET,
                   seed: int = SAMPLE_SEED, step: int = 5, n_taken: int | None = None) -> DataFrame:
    """Add ``(target - n) // 5`` rows per score 1..5 from unused rows, seed ``seed + score``.

    ``n`` is the number of quota rows; these, at most the quota total, are read to the driver.
    """
    rows = quota_part.select(key).collect()
    per = (target - (len(rows) if n_taken is None else n_taken)) // 5
    pool = _bottom_rows(candidates, key, _some(_fill_groups(score, key, seed)), per + len(rows), per) if per > 0 else []
    return _sample_frame(candidates, _take_fill(pool, key, {r[key] for r in rows if r[key] is not None}, per, step), False)


def dedupe_by_id(df: DataFrame, key: str = "review_id", order: list[Column] | None = None) -> DataFrame:
    """First row per id in concatenation order (step, band, score, then sample order).

    Runs on the bounded sample (quota total + fill), not on the reviews.
    """
    order = order or [F.col(c) for c in ("step", "band", "review_score", "sample_rank") if c in df.columns]
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter(F.col("_first") == 1).drop("_first")


def cap_sample(df: DataFrame, n: int = SAMPLE_TARGET, key: str = "review_id", seed=CAP_SEED) -> DataFrame:
    """Keep ``n`` rows by the seeded order if there are more (a top-k: the limit is the feature)."""
    return (with_sample_key(df, key, seed).orderBy("_h", key).limit(n).drop("_h"))


def shuffle_rows(df: DataFrame, key: str = "review_id", seed=SHUFFLE_SEED, index: str = "row_index") -> DataFrame:
    """Seeded permutation with a fresh 0..n-1 index (input is the capped sample)."""
    w = Window.orderBy(sampling_hash(key, seed), F.col(key))
    return df.withColumn(index, (F.row_number().over(w) - 1).cast("int"))


def split_label(key: str = "review_id", test_size: float = 0.2, seed=SAMPLE_SEED) -> Column:
    """W7 as a column: 'test' or 'train' by the same hash bucket as :func:`train_test_split`."""
    return F.when(hash_unit_interval(key, seed) < test_size, F.lit("test")).otherwise(F.lit("train"))


def train_test_split(df: DataFrame, test_size: float, key: str = "review_id", seed=SAMPLE_SEED,
                     exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two-way split by hash bucket of (id, seed): no shuffle, no leak between splits.

    ``exact=True`` holds out the fewest whole ids, in the order of the same hash, that together have
    ``ceil(n * test_size)`` rows (exactly that many if ids are unique).  The cut is found from row
    counts of 65,536 hash ranges and of the ids of one range; each side is then a filter.
    """
    u = hash_unit_interval(key, seed)
    if not exact:
        return df.filter(u >= test_size), df.filter(u < test_size)
    import math

    h = sampling_hash(key, seed)
    ids = df.groupBy(F.substring(h, 1, 4).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    need, cut = math.ceil(sum(r.n for r in ids) * test_size), None
    for r in ids:
        if need <= r.n:
            cut = r.range
            break
        need -= r.n
    if need <= 0 or cut is None:
        return df, df.limit(0)
    so_far = Window.orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)  # the ids of one range
    last = (df.filter(F.substring(h, 1, 4) == cut).groupBy(F.col(key), h.alias("h")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).filter(F.col("before") < need)
            .agg(F.max(F.struct("h", key)).alias("last")).first()["last"])
    held = (h < last["h"]) | ((h == last["h"]) & (F.col(key) <= last[key]))
    return df.filter(~held), df.filter(held)


def distinct_pairs(df: DataFrame, cols=("review_id", "review_score")) -> DataFrame:
    """Distinct (id, score) pairs."""
    return df.select(*cols).distinct()
