"""Operator 10: near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct word shingles.  Its sketch has ``bands * rows``
coordinates, filled in rounds: in round i every element is hashed to one bin with the value
(i, hash), each bin keeps its smallest value, and the rounds end once no bin is empty; after as many
random rounds as there are bins, round ``bins + b`` sends every element to bin b, so every coordinate
fills.  Two sketches agree in a coordinate with probability equal to the Jaccard similarity, and the
number of agreeing coordinates is concentrated around its mean.

Documents with equal sets form a class, which goes on as one node, named by 64 bits of the set's digest.
All sets of one ``doc_id`` are linked.  Nodes of equal band
meet in a bucket.  First every document is checked, on full sets, against its buckets' smallest
document; what that leaves in different components of one bucket is then compared in blocks, on full
sets, whatever the bucket's size; a block is bounded by its shingles and by its members, and the blocks
of a bucket's largest component meet only those of the others.  Pairs already known to be connected are not compared and no list
of all pairs is made.  The only loss is by banding: a pair of similarity s shares no bucket with
probability (1 - s**rows)**bands, 3e-6 at s = 0.8 with the default 32 bands of 5 rows.

Defined results: null or empty texts and texts without words have an empty set and link with nothing;
a text with fewer words than a shingle has its whole word sequence as one element; rows with the same
``doc_id`` are one document, linked by each of their texts (every row stays a row of the result, with the
size of its own set); rows without a ``doc_id`` link
with nothing and are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm import words as W
from aspectra.llm.tables import Roots, by_group, connected_components, group_starts, grouped, written

BANDS, ROWS = 32, 5
#: shingles of all members of a block; a larger bucket is split
BLOCK_SHINGLES = 1 << 19
#: members of a block; a task compares two blocks in a dense matrix over their members
BLOCK_MEMBERS = 2048
#: members checked against one bucket leader in a task
LEADER_ROWS = 2048
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, bounds = W.word_hashes(data, offsets)
    weight = W.constants(size, 3)
    n = len(h) - size + 1
    full = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        full += h[k:k + len(full)] * weight[k]
    full = W.mix(full)
    short = W.constants(size, 4)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(full[a:b - size + 1])
        elif b > a:
            yield W.mix((h[a:b] * weight[:b - a]).sum(dtype=np.uint64, keepdims=True) + short[b - a])
        else:
            yield full[:0]


def sketch(elements: np.ndarray, row: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """``n_rows x bins`` coordinates of the sets given as elements and their row (ascending)."""
    out = np.full(n_rows * bins, _EMPTY)
    seeds = W.constants(bins, 5)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * bins):
        if not len(elements):
            break
        value = W.mix(elements ^ seeds[i % bins])
        to = (value >> np.uint64(32)) % np.uint64(bins) if i < bins else np.uint64(i - bins)
        at = row * bins + np.asarray(to).astype(np.int64)
        np.minimum.at(out, at, (value & low) | np.uint64(i << 32))
        open_row = (out.reshape(n_rows, bins) == _EMPTY).any(axis=1)
        keep = open_row[row]
        elements, row = elements[keep], row[keep]
    return out.reshape(n_rows, bins)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weight, salt = W.constants(rows, 6), W.constants(bands, 7)
    x = coordinates.reshape(len(coordinates), bands, rows)
    return W.mix((x * weight).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)


def sketches(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, digest, keys)``; an empty set has no digest and no keys."""
    def run(batches: Iterable[pa.RecordBatch]):
        for batch, data, offsets in W.chunks(batches):
            sets = list(shingle_sets(data, offsets, size))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys = band_keys(sketch(np.concatenate(sets), np.repeat(np.arange(len(n)), n), len(n), bands * rows),
                             bands, rows)
            digest = [_digest(s) for s in sets]
            some = n > 0
            flat = pa.array(keys[some].reshape(-1))
            bounds = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(bounds), flat)], ["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _digest(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, elements)``: the node of each text, and its full set as the bytes of its sorted hashes."""
    def run(batches):
        for batch, data, offsets in W.chunks(batches):
            sets = list(shingle_sets(data, offsets, size))
            node = [int.from_bytes(d[:8], "big", signed=True) if (d := _digest(s)) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["doc_id", "elements"])

    return docs.select("text").mapInArrow(run, "doc_id long, elements binary")


def similar(shared, a, b, percent: int):
    """Whether ``100 * intersection >= percent * union``, in integers."""
    return 100 * shared >= percent * (a + b - shared)


def _check_leaders(percent: int):
    def run(batches):
        held, leader = None, None
        for batch in batches:
            a, s = batch.column("leader").to_numpy(), batch.column("salt").to_numpy()
            d, sets = batch.column("doc_id").to_numpy(), batch.column("elements")
            out = []
            for k in range(batch.num_rows):
                x = np.frombuffer(sets[k].as_buffer(), np.uint64)
                if d[k] == a[k]:
                    held, leader = (a[k], s[k]), x
                    continue
                assert held == (a[k], s[k]), "the leader comes first"
                if 100 * min(len(x), len(leader)) < percent * max(len(x), len(leader)):
                    continue
                at = np.minimum(np.searchsorted(leader, x), len(leader) - 1)
                if similar(int((leader[at] == x).sum()), len(x), len(leader), percent):
                    out.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out, pa.int64())),
                                              batch.column("leader").take(pa.array(out, pa.int64()))], ["src", "dst"])

    return run


def _check_blocks(percent: int):
    def run(batches):
        for t in by_group(batches, ["key", "i", "j"], 4096):
            starts = group_starts(t, ["key", "i", "j"])
            for a, b in zip(starts, [*starts[1:], t.num_rows]):
                src, dst = _block_links(t.slice(a, b - a), percent)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return run


def _block_links(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join different components, no more than connect them."""
    docs, comp, blk = (t.column(c).to_numpy() for c in ("doc_id", "component", "b"))
    none = np.zeros(0, np.int64)
    if (comp == comp[0]).all():
        return none, none
    cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("elements").combine_chunks()]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    docs, comp, blk, n, sets = docs[order], comp[order], blk[order], n[order], [sets[i] for i in order]
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    often = np.bincount(at, minlength=len(value)) > 1
    column = np.cumsum(often) - 1
    keep = often[at]
    row, at = row[keep], column[at[keep]]
    by_column = np.argsort(at, kind="stable")
    row, at = row[by_column], at[by_column]
    k, width = len(n), int(often.sum())
    shared = np.zeros((k, k), np.float32)
    step = max(1, min(4096, (16 << 20) // max(1, k)))
    for c in range(0, width, step):
        lo, hi = np.searchsorted(at, [c, c + step])
        m = np.zeros((k, step), np.float32)
        m[row[lo:hi], at[lo:hi] - c] = 1
        shared += m @ m.T
    _, comp_at = np.unique(comp, return_inverse=True)
    roots = Roots(int(comp_at.max()) + 1)
    src, dst = [], []
    for x in range(k):
        y = np.arange(x + 1, k)
        y = y[(100 * n[x] >= percent * n[y]) & (comp[y] != comp[x])]
        if cross:
            y = y[blk[y] != blk[x]]
        y = y[similar(shared[x, y].astype(np.int64), n[x], n[y], percent)]
        y = y[roots.root[comp_at[y]] != roots.root[comp_at[x]]]
        if not len(y):
            continue
        _, first = np.unique(roots.root[comp_at[y]], return_index=True)
        y = y[first]
        roots.join(np.full(len(y), comp_at[x]), comp_at[y])
        src.append(np.full(len(y), docs[x]))
        dst.append(docs[y])
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def block_tasks(members: DataFrame) -> DataFrame:
    """Rows ``(key, doc_id, n_shingles, component)`` dealt to tasks ``(key, i, j)`` with their block ``b``.

    Any two members of different components meet in exactly one task.  A bucket over the bounds is cut
    into blocks by a hash of the id: its largest component by itself, all others together.
    """
    weight = F.greatest("n_shingles", F.lit(BLOCK_SHINGLES // BLOCK_MEMBERS))
    n = lambda w: F.ceil(w / F.lit(BLOCK_SHINGLES)).cast("int")
    large = (members.groupBy("key", "component").agg(F.sum(weight).alias("w"))
             .groupBy("key").agg(F.sum("w").alias("_all"), F.max(F.struct("w", "component")).alias("_top"))
             .filter(F.col("_all") > BLOCK_SHINGLES)
             .select("key", F.col("_top.component").alias("_main"), n(F.col("_top.w")).alias("_n"),
                     n(F.col("_all") - F.col("_top.w")).alias("_rest")))
    at, whole = F.xxhash64("doc_id"), F.col("_main").isNull()
    main, last = F.col("component") == F.col("_main"), F.col("_n") + F.col("_rest") - 1
    df = members.join(large, "key", "left").withColumn("b", F.when(whole, 0).when(main, F.pmod(at, "_n")).otherwise(
        F.col("_n") + F.pmod(at, "_rest")).cast("int"))
    meets = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.when(main, F.col("_n")).otherwise(0), last))
    pair = F.explode(F.transform(meets, lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))))
    return df.withColumn("_p", pair).select(*members.columns, "b", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs (doc_id, text)``."""
    node = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    found = written(sketches(docs, size, bands, rows).withColumn("node", node), "sketches")
    some = found.filter("digest is not null and doc_id is not null")
    classes = written(some.groupBy("node").agg(F.min("doc_id").alias("first_id")), "classes")
    # of every set the keys of one row; then nodes take the place of documents
    firsts = (some.join(classes, "node").filter("doc_id = first_id")
              .groupBy("node").agg(F.first("keys").alias("keys"), F.max("n_shingles").alias("n_shingles")))
    members = firsts.select(F.col("node").alias("doc_id"), "n_shingles", F.explode("keys").alias("key"))
    leaders = (members.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("_last"))
               .filter("leader < _last").drop("_last"))
    buckets = written(members.join(leaders, "key"), "buckets")
    pairs = buckets.filter("doc_id <> leader").select("leader", "doc_id").distinct()
    # the texts of the first ids; a bucket's nodes are among their sets
    wanted = buckets.select(F.col("doc_id").alias("node")).distinct().join(classes, "node").select(F.col("first_id").alias("_first")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(_sets(texts.join(wanted, texts["doc_id"] == wanted["_first"], "left_semi"), size)
                   .join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets")

    split = (pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("_k"))
             .select("leader", F.ceil(F.col("_k") / F.lit(LEADER_ROWS)).cast("int").alias("_n")))
    dealt = pairs.join(split, "leader").select(
        "leader", F.pmod(F.xxhash64("doc_id"), "_n").cast("int").alias("salt"), "doc_id")
    heads = split.select("leader", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("salt"),
                         F.col("leader").alias("doc_id"))
    with_sets = dealt.union(heads).join(sets, "doc_id").withColumn("_member", F.col("doc_id") != F.col("leader"))
    several_texts = (some.groupBy("doc_id").agg(F.min("node").alias("dst"), F.max("node").alias("_z")).filter("dst < _z").drop("_z"))
    own = some.join(several_texts, "doc_id").filter("node <> dst").select(F.col("node").alias("src"), "dst").distinct()
    links = written(grouped(with_sets, ["leader", "salt"], _check_leaders(percent), "src long, dst long",
                            ["_member"]).union(own), "links")

    nodes = connected_components(links)
    placed = (buckets.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")))
    mark = F.xxhash64("doc_id")
    several = (placed.groupBy("key")
               .agg(F.min("component").alias("_a"), F.max("component").alias("_z"), F.count(F.lit(1)).alias("_k"),
                    F.bit_xor(mark).alias("_x"), F.sum(mark % 1_000_000_007).alias("_s"))
               .filter("_a < _z").groupBy("_k", "_x", "_s").agg(F.min("key").alias("key")).select("key"))
    undecided = written(placed.join(several, "key"), "undecided")
    tasks = block_tasks(undecided).join(sets, "doc_id")
    more = written(grouped(tasks, ["key", "i", "j"], _check_blocks(percent), "src long, dst long"), "links")
    nodes = written(connected_components(links.union(more)), "components")

    placed = classes.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = (some.select("doc_id", "node").distinct().join(placed.join(least, "component").select("node", "component_id"), "node")
             .groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    return (found.select("doc_id", "n_shingles").join(named, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
