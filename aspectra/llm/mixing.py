"""Operator 9: mixing sources to target weights, in DataFrame expressions only.

Each source's words, its documents in a pseudorandom order, are packed into blocks of ``BLOCK``
words.  The output is a row of slots, one block each, dealt to shards of ``SHARD_SLOTS``.  Every slot
draws its source with the targets' probabilities, so a shard's counts are a multinomial draw.  Slots
beyond a source's quota are handed to the sources that were drawn too seldom, and a source's last slots
are cut, which makes the totals exact: each source gives its target, rounded, to the word.  The n-th slot of a source takes block perm(n mod blocks) of its pass n div blocks, where perm
is a keyed permutation of the source's block numbers, another one for each pass, computed for each
slot alone (swap-or-not rounds).  Slots and blocks are joined by source and block number.

A source has at most two passes, and a pass holds each block once, so no document is taken more than
twice.  All draws are hashes of ids and a fixed seed: reruns agree.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share 150 % of all words; a
target stops at twice its source's size, the rest is shared by weight among the others.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source;
rows are told apart by ``doc_id`` and size within a source, and rows that agree in these are
interchangeable; an empty table, or one without words, takes nothing; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK, SHARD_SLOTS = 128, 8192
ROUNDS = 16
SEED = 20_240_229
_BUCKETS = 4096
_GRID = 4096


def running(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over the rows before this one in its group, in two levels.

    ``bucket`` rises with ``order``; only a bucket's rows, and a group's bucket totals, meet in a task.
    """
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(group, bucket, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(bases, [group, bucket]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in"))


def in_interval(points: DataFrame, at: str, intervals: DataFrame, total: int) -> DataFrame:
    """``points`` joined to the interval ``[lo, lo + n)`` that holds ``at``, by cells of a grid."""
    width = max(1, -(-total // _GRID))
    cells = F.sequence(F.expr(f"lo div {width}"), F.expr(f"(lo + n - 1) div {width}"))
    by_cell = intervals.filter("n > 0").withColumn("_cell", F.explode(cells))
    return (points.withColumn("_cell", F.expr(f"{at} div {width}")).join(by_cell, "_cell")
            .filter(f"{at} >= lo and {at} < lo + n").drop("_cell"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes (source, source_size)`` with ``sid`` (rank, from 0), weight and ``target``.

    One row per source; the targets are the level at which min(weight * level, 2 * size) fills 150 %.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("sid", F.lit(len(WEIGHTS))) + 1)
    every = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "sid")
    df = ranked.withColumn("weight", weight.cast("double")).withColumn("_cap", F.lit(2.0) * F.col("source_size"))
    df = df.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    full = F.lit(1.5) * F.sum("source_size").over(every)
    capped_before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_level", (full - capped_before) / open_weight)
    at_cap = F.col("_level") >= F.col("_ratio")
    level = F.min(F.when(~at_cap, F.struct("_ratio", "sid", "_level"))).over(every)["_level"]
    return df.withColumn("target", F.when(at_cap, F.col("_cap")).otherwise(F.col("weight") * level)).select(
        "source", "sid", "source_size", "weight", "target")


@dataclass
class Mix:
    """``sized``: the documents' ids, sizes and places; ``sources``; ``slots (shard, slot, sid, epoch,
    block)``; ``taken (sid, place, epoch, start, n)``: word ranges of documents that the slots take."""
    sized: DataFrame
    sources: DataFrame
    slots: DataFrame
    taken: DataFrame


def plan(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    raw = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
                  .withColumn("_order", F.xxhash64("doc_id", F.lit(seed))), "sized")
    sources = source_targets(raw.groupBy("source").agg(F.sum("size").alias("source_size")))
    # slots: blocks that hold the target, with two more as each pass has a short one; at most two passes
    sources = (sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
               .withColumn("quota", F.least(F.ceil(F.col("target") / F.lit(block)).cast("long") + 2, F.lit(2) * F.col("blocks"))))
    sources = written(sources, "sources")

    sized = raw.join(sources.select("source", "sid"), raw["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    sized = sized.withColumn("_bucket", F.shiftrightunsigned("_order", 52).bitwiseXOR(F.lit(_BUCKETS // 2)))
    sized = written(running(sized, "sid", "_bucket", ["_order", "doc_id", "size"], "size", "place")
                    .drop("_bucket", "_order"), "placed")

    slots = written(_slots(spark, sources, shard_slots, seed), "slots")
    times = (slots.groupBy("sid", "block", "epoch").agg(F.count(F.lit(1)).alias("times"))
             .join(_cuts(slots, sources, block), ["sid", "block", "epoch"], "left"))
    spans = (sized.filter("size > 0")
             .select("sid", "place", "size", F.explode(F.sequence(F.expr(f"place div {block}"),
                                                                  F.expr(f"(place + size - 1) div {block}"))).alias("block"))
             .withColumn("start", F.greatest(F.lit(0), F.col("block") * block - F.col("place")))
             .withColumn("n", F.least("size", (F.col("block") + 1) * block - F.col("place")) - F.col("start")))
    left = F.col("keep") - (F.col("place") + F.col("start") - F.col("block") * block)
    taken = (spans.join(times, ["sid", "block"])
             .withColumn("n", F.when(F.col("keep").isNull(), F.col("n")).otherwise(F.greatest(F.least("n", left), F.lit(0))))
             .filter("n > 0").select("sid", "place", "epoch", "start", "n", "times"))
    return Mix(sized, sources, slots, taken)


def _cuts(slots: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """``(sid, block, epoch, keep)``: the last slots of each source, cut so that its words meet the target.

    The slots hold less than three full blocks more than the target, so the last six are enough.
    """
    last = Window.partitionBy("sid").orderBy(F.desc("epoch"), F.desc("slot"))
    short = F.col("blocks") * block - F.col("source_size")
    held = slots.join(sources.select("sid", "blocks", "source_size", "target"), "sid")
    held = held.withColumn("_len", F.when(F.col("block") == F.col("blocks") - 1, F.lit(block) - short).otherwise(F.lit(block)))
    excess = held.groupBy("sid").agg((F.sum("_len") - F.round(F.first("target")).cast("long")).alias("_excess"))
    few = held.withColumn("_nth", F.row_number().over(last)).filter(F.col("_nth") <= 6).join(excess, "sid")
    before = Window.partitionBy("sid").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.least("_len", F.greatest(F.col("_excess") - F.coalesce(F.sum("_len").over(before), F.lit(0)), F.lit(0)))
    return few.withColumn("_cut", cut).filter("_cut > 0").select("sid", "block", "epoch", (F.col("_len") - F.col("_cut")).alias("keep"))


def _slots(spark, sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    total = sources.agg(F.sum("quota")).first()[0] or 0
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    quotas = sources.select("sid", "blocks", "quota", start("quota").alias("lo"), F.col("quota").alias("n"))
    drawn = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {shard_slots}").alias("shard"),
                                      F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(total, 1))).alias("_u"))
    drawn = in_interval(drawn, "_u", quotas.select("sid", "lo", "n"), total).select("slot", "shard", "sid")
    # the draw of each shard, and where a source's slots of a shard start among its slots of all shards
    draws = drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    places = running(draws.withColumn("_wide", F.expr("shard div 4096")), "sid", "_wide", ["shard"], "n", "before")
    inside = Window.partitionBy("shard", "sid").orderBy("slot")
    numbered = (drawn.withColumn("_k", F.row_number().over(inside) - 1)
                .join(places.select("shard", "sid", "before"), ["shard", "sid"])
                .select("slot", "shard", "sid", (F.col("before") + F.col("_k")).alias("index")))
    # slots beyond a quota go to the places that the other sources were not drawn for
    got = sources.select("sid", "quota").join(draws.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").select(
        "sid", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    got = got.select("*", F.greatest(F.col("got") - F.col("quota"), F.lit(0)).alias("over"),
                     F.greatest(F.col("quota") - F.col("got"), F.lit(0)).alias("under"))
    got = written(got.select("*", start("over").alias("over_lo"), start("under").alias("lo")), "quotas")
    held = numbered.join(got.select("sid", "quota", "over_lo"), "sid")
    kept = held.filter("index < quota").select("slot", "shard", "sid", "index")
    moved = held.filter("index >= quota").select("slot", "shard", (F.col("index") - F.col("quota") + F.col("over_lo")).alias("_e"))
    moved = in_interval(moved, "_e", got.select("sid", "got", "lo", F.col("under").alias("n")), max(total, 1)).select(
        "slot", "shard", "sid", (F.col("got") + F.col("_e") - F.col("lo")).alias("index"))
    keyed = sources.select("sid", "source", "blocks", F.explode(F.expr("array(0L, 1L)")).alias("epoch"))
    keyed = keyed.select("sid", "blocks", "epoch", F.xxhash64("source", "epoch", F.lit(seed + 2)).alias("key"))
    named = kept.union(moved).join(sources.select("sid", F.col("blocks").alias("_b")), "sid").select(
        "slot", "shard", "sid", F.expr("index div _b").alias("epoch"), F.expr("index % _b").alias("_x"))
    return named.join(keyed, ["sid", "epoch"]).select("shard", "slot", "sid", "epoch",
                                                      permuted("_x", "blocks", "key").alias("block"))


def permuted(x: str, n: str, key: str):
    """Where the keyed permutation of 0..n-1 sends ``x``: rounds that swap pairs x, k - x (mod n) or not."""
    partner = f"pmod(pmod(xxhash64({key}, i), {n}) - a, {n})"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {x}, (a, i) -> "
                  f"if(xxhash64({key}, i, greatest(a, {partner})) % 2 = 0, a, {partner}))")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``: the words the mix takes of each document."""
    m = plan(docs, **options)
    words = m.taken.groupBy("sid", "place").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    size = m.sized.join(m.sources.select("sid", "source_size", "target"), "sid")
    return (size.filter("size > 0").join(words, ["sid", "place"], "left")
            .unionByName(size.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, with their columns: a row for each pass that takes any of its words.

    A document taken whole keeps its text; of one taken in part the words taken stay, in order, joined
    by single spaces.  ``n_chars``, if it is a column, is the length of the new text.
    """
    m = plan(docs, **options)
    ranges = m.taken.groupBy("sid", "place", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("_ranges"), F.sum("n").alias("_n"))
    rows = (m.sized.filter("size > 0").join(ranges, ["sid", "place"])
            .groupBy("doc_id", "source", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("_n", "_ranges"))).alias("_copies")))
    # rows that agree in id, source and size are interchangeable: the k-th of them takes the k-th copy
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumn("_size", size).filter("_size > 0")
    same = Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))
    out = out.withColumn("_k", F.row_number().over(same)).alias("d").join(
        rows.alias("r"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id"))
        & F.col("d.source").cast("string").eqNullSafe(F.col("r.source")) & (F.col("_size") == F.col("r.size")))
    out = out.filter("_k <= size(_copies)").withColumn("_c", F.element_at("_copies", F.col("_k")))
    words = F.split(F.regexp_replace(F.regexp_replace("d.text", rf"^{GAP}|{GAP}$", ""), GAP, " "), " ")
    part = F.array_join(F.flatten(F.transform("_c._ranges", lambda r: F.slice(
        F.col("_words"), r["start"].cast("int") + 1, r["n"].cast("int")))), " ")
    whole = F.col("_c._n") == F.col("_size")
    out = out.withColumn("_words", F.when(~whole, words)).withColumn("_text", F.when(whole, F.col("d.text")).otherwise(part))
    cols = [F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars" else F.col(f"d.{c}") for c in docs.columns]
    return out.select(*cols)
