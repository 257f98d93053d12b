"""Operator 7: benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, names (capitalised words inside a sentence) and
units (after a number) are replaced by typed placeholders, other words by their hash without case and
punctuation.  Windows of five tokens of documents and benchmark items are joined by hash, as templates
and as the words themselves without case, so a copy is found whatever the letter case of its names is, and
however few plain words it has.

A shared window puts the item beside the document at one alignment, on which tokens are compared one by
one: those of the window, and the ``WINDOW`` tokens on either side of it (there also runs of two and more
words that moved by one word), so a changed, added or missing word costs about one token and not all the
windows that hold it.  The same number or name of the item must always stand for
the same word of the document; on an alignment where it does not, the tokens holding it are not counted
and the rest is.  Beside a window a number or name counts if the windows exchange it likewise, or if it is
unchanged and in none of them.  A document holds an item if at least ``percent`` % of the item's tokens
are found on its alignments; a shorter quotation is none.

The benchmark's window hashes are sent to the tasks as a filter if there are at most
``FILTER_WINDOWS`` of them; beyond that all windows of the documents enter the join.

Defined results: null and empty texts hold nothing; an item with fewer than five tokens is one window
of all its tokens, compared with document windows of the same length; an item without words, or of fewer
than five tokens that are all numbers, names and units, cannot be found, and one without a template window
(at least three plain words; all of them, if shorter) is found only by shared words; rows with
the same ``doc_id`` are one document, rows with the same ``item_id`` are texts of one item, held if any
of them is; rows
without id are never contaminated or items; empty tables give no item or no row; other columns are
ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm import words as W
from aspectra.llm.tables import written

WINDOW = 5
#: 8 bytes each
FILTER_WINDOWS = 4_000_000

# fixed values: words that stand for a number, and units of measure
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
                "thousand million billion half").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
         "pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour "
         "hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree "
         "degrees meter meters metre metres kilometer kilometers km/h mph hz khz mhz watt watts volt volts").split()

_PLAIN, _NUMBER, _NAME, _UNIT = range(4)
_OUTSIDE = -1
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?:"]] = True
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in "\"')]"]] = True
_PLACEHOLDER = W.constants(4, 11)
_AT, _SIZE, _EXACT = W.constants(64, 12), W.constants(64, 13), W.constants(64, 14)
#: bytes of letters of two-byte UTF-8, by code point, in lower case
_FOLD = np.array([ord(c) for c in (chr(i).lower() if len(chr(i).lower()) == 1 and 128 <= ord(chr(i).lower()) < 2048
                                   else chr(i) for i in range(2048))], dtype=np.uint16)


def _bare_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    data = data[_ALNUM[data] | (data == 32)]
    return np.sort(W.word_spans(data, np.array([0, len(data)]))[0])


_NUMBER_HASH, _UNIT_HASH = _bare_hashes(NUMBER_WORDS), _bare_hashes(UNITS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes with letters of two bytes in lower case (those of one byte are hashed so)."""
    at = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    if not len(at):
        return data
    low = _FOLD[(data[at].astype(np.uint16) & 0x1F) << 6 | (data[at + 1] & 0x3F)]
    data = data.copy()
    data[at], data[at + 1] = low >> 6 | 0xC0, low & 0x3F | 0x80
    return data


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Raw word hash, type and the n + 1 row bounds of the tokens of each row."""
    _, starts, ends = W.word_spans(data, offsets)
    # the letters and digits of each word, and where the words and rows then lie
    keep = _ALNUM[data] | (data <= 32)
    moved = np.cumsum(keep) - keep
    place = np.r_[moved, keep.sum()]
    bare = _folded(data[keep])
    raw, s, e = W.word_spans(bare, place[offsets])
    # words that keep a letter or digit
    has = place[ends] > place[starts]
    starts, ends = starts[has], ends[has]
    first = bare[s]
    second = bare[np.minimum(s + 1, len(bare) - 1)] if len(bare) else first
    last = data[ends - 1]
    last = np.where(_CLOSING[last], data[np.maximum(ends - 2, starts)], last)
    bounds = np.searchsorted(starts, offsets)
    opens = np.ones(len(s), dtype=bool)
    if len(s) > 1:
        opens[1:] = _END[last[:-1]]
    opens[bounds[:-1][bounds[:-1] < len(s)]] = True
    kind = np.zeros(len(s), np.int8)
    capital = (first >= 65) & (first <= 90) & (e > s + 1) & ~((second >= 65) & (second <= 90))
    kind[capital & ~opens] = _NAME
    number = ((first >= 48) & (first <= 57)) | _among(raw, _NUMBER_HASH)
    kind[number] = _NUMBER
    if len(s) > 1:
        after = np.r_[False, number[:-1]]
        after[bounds[:-1][bounds[:-1] < len(s)]] = False
        kind[after & _among(raw, _UNIT_HASH)] = _UNIT
    return raw, kind, bounds


def windows(raw: np.ndarray, kind: np.ndarray, bounds: np.ndarray, size: int, exact: bool):
    """Key, first token and row of every window of ``size`` tokens, of the words or of the template.

    Template windows need enough plain words, and exact ones of less than ``WINDOW`` tokens one.
    """
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = kind == _PLAIN
    token = raw if exact else np.where(plain, raw, _PLACEHOLDER[kind])
    key = np.full(n, (_EXACT if exact else _SIZE)[size])
    for k in range(size):
        key += token[k:k + n] * _AT[k]
    count = np.r_[0, np.cumsum(plain)]
    row = W.rows_of(bounds)[:n]
    least = int(size < WINDOW) if exact else min(3, size)
    at = np.flatnonzero((count[size:] - count[:n] >= least) & (row == W.rows_of(bounds)[size - 1:]))
    return W.mix(key[at]), at, row[at]


def _rows(id_column: pa.Array, raw, kind, bounds, size, key, at, row, id_name: str, extra=None) -> pa.RecordBatch:
    """Window rows: key, id, position in the row, and the raw tokens with their types, also of the tokens around."""
    span = size + 2 * WINDOW
    flat = at[:, None] + np.arange(-WINDOW, size + WINDOW)
    inside = ((flat >= bounds[row][:, None]) & (flat < bounds[row + 1][:, None])).reshape(-1)
    flat = np.clip(flat, 0, max(len(raw) - 1, 0)).reshape(-1)
    lists = np.arange(len(at) + 1, dtype=np.int32) * span
    cols = {"key": pa.array(key.view(np.int64)), id_name: id_column.take(pa.array(row)),
            "pos": pa.array(at - bounds[row]),
            "raw": pa.ListArray.from_arrays(pa.array(lists), pa.array(np.where(inside, raw[flat].view(np.int64), 0))),
            "kind": pa.ListArray.from_arrays(pa.array(lists), pa.array(np.where(inside, kind[flat], _OUTSIDE)))}
    return pa.RecordBatch.from_pydict(cols | (extra or {}))


_ROW = "key long, {} long, pos long, raw array<long>, kind array<tinyint>"
_ITEM_ROW = _ROW.format("item_id") + ", version long, n_tokens long, size int"


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch, data, offsets in W.chunks(batches):
            raw, kind, bounds = tokens(data, offsets)
            n = np.diff(bounds)
            for size, exact in product(range(1, window + 1), (False, True)):
                key, at, row = windows(raw, kind, bounds, size, exact)
                of = (n[row] >= window) if size == window else (n[row] == size)
                key, at, row = key[of], at[of], row[of]
                yield _rows(batch.column("item_id"), raw, kind, bounds, size, key, at, row, "item_id",
                            {"version": batch.column("version").take(pa.array(row)), "n_tokens": pa.array(n[row]),
                             "size": pa.array(np.full(len(at), size, np.int32))})

    return items.withColumn("version", F.xxhash64("text")).mapInArrow(run, _ITEM_ROW)


def _doc_windows(docs: DataFrame, sizes: list[int], wanted) -> DataFrame:
    def run(batches):
        for batch, data, offsets in W.chunks(batches):
            raw, kind, bounds = tokens(data, offsets)
            for size, exact in product(sizes, (False, True)):
                key, at, row = windows(raw, kind, bounds, size, exact)
                if wanted is not None:
                    hit = _among(key, wanted.value)
                    key, at, row = key[hit], at[hit], row[hit]
                # unfiltered windows of a chunk are handed on in parts: each carries its surroundings
                for k in range(0, len(key), 65_536):
                    part = slice(k, k + 65_536)
                    yield _rows(batch.column("doc_id"), raw, kind, bounds, size, key[part], at[part], row[part], "doc_id")

    return docs.mapInArrow(run, _ROW.format("doc_id"))


def _agreeing(pos, size):
    """Of an item window and a document window: the tokens that agree, in the window and around it."""
    def token(s, i):
        return F.struct((pos + i - WINDOW).alias("at"), s["raw"].alias("raw"), s["doc_raw"].alias("doc_raw"),
                        (s["kind"] > _PLAIN).alias("slot"), ((i >= WINDOW) & (i < size + WINDOW)).alias("window"),
                        ((s["kind"] != _OUTSIDE) & (s["doc_kind"] != _OUTSIDE)
                         & ((s["raw"] == s["doc_raw"]) | (s["kind"] > _PLAIN) & (s["kind"] == s["doc_kind"])))
                        .alias("agrees"))

    def beside(moved):
        # runs of two and more words around the window that moved by one word
        same = F.zip_with("raw", moved, lambda a, b: a == b)
        return F.transform(F.arrays_zip("kind", "raw", same.alias("same")), lambda s, i: F.struct(
            (pos + i - WINDOW).alias("at"), s["raw"].alias("raw"), s["raw"].alias("doc_raw"),
            (s["kind"] > _PLAIN).alias("slot"), F.lit(False).alias("window"),
            ((s["kind"] != _OUTSIDE) & ((i < WINDOW) | (i >= size + WINDOW)) & s["same"]
             & (F.get(same, i - 1) | F.get(same, i + 1))).alias("agrees")))

    none, n = F.array(F.lit(0).cast("long")), size + 2 * WINDOW - 1
    both = F.concat(F.transform(F.arrays_zip("kind", "raw", "doc_kind", "doc_raw"), token),
                    beside(F.concat(none, F.slice("doc_raw", F.lit(1), n))),
                    beside(F.concat(F.slice("doc_raw", F.lit(2), n), none)))
    return F.transform(F.filter(both, lambda t: t["agrees"]), lambda t: t.dropFields("agrees"))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 80) -> DataFrame:
    """``(doc_id, item_id, n_found, n_tokens)``: the items each document holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    bench = written(_item_windows(items, window).dropDuplicates(["item_id", "version", "key", "pos"]), "windows")
    keys = bench.select("key").distinct()
    wanted, sizes = None, list(range(1, window + 1))
    held = keys.limit(FILTER_WINDOWS + 1).count()
    if held <= FILTER_WINDOWS:
        found = np.array([r.key for r in keys.collect()], dtype=np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(found))
        sizes = [r.n for r in bench.select(F.col("size").alias("n")).distinct().collect()] or [window]
    one = ["doc_id", "item_id", "version", "n_tokens"]
    hits = (_doc_windows(docs, sorted(sizes), wanted)
            .select("key", "doc_id", F.col("pos").alias("doc_pos"), F.col("raw").alias("doc_raw"),
                    F.col("kind").alias("doc_kind"))
            .join(bench, "key")
            .select(*one, (F.col("doc_pos") - F.col("pos")).alias("shift"),
                    _agreeing(F.col("pos"), F.col("size")).alias("tokens")))
    lines = hits.groupBy(*one, "shift").agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"))
    # what the slots in windows stand for, and the words that do not always stand for the same
    pair = lambda t: F.struct(t["raw"], t["doc_raw"])
    lines = lines.withColumn("pairs", F.array_distinct(F.transform(
        F.filter("tokens", lambda t: t["slot"] & t["window"]), pair)))
    lines = lines.withColumn("words", F.array_distinct(F.transform("pairs", lambda p: p["raw"])))
    lines = lines.withColumn("torn", F.when(F.size("pairs") == F.size("words"), F.slice("words", 1, 0)).otherwise(
        F.filter("words", lambda w: F.size(F.filter("pairs", lambda p: p["raw"] == w)) > 1)))
    counted = F.filter("tokens", lambda t: ~t["slot"] | ~F.array_contains("torn", t["raw"]) & (
        t["window"] | F.array_contains("pairs", pair(t))
        | (t["raw"] == t["doc_raw"]) & ~F.array_contains("words", t["raw"])))
    best = lines.withColumn("places", F.array_distinct(F.transform(counted, lambda t: t["at"]))).groupBy(*one).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_found"))
    of = F.struct("n_found", "n_tokens")
    return (best.filter(F.col("n_found") * 100 >= F.col("n_tokens") * percent).groupBy("doc_id", "item_id")
            .agg(F.max_by(of, F.col("n_found") / F.col("n_tokens")).alias("_best"))
            .select("doc_id", "item_id", "_best.n_found", "_best.n_tokens"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 80) -> DataFrame:
    """``(doc_id, contaminated, n_items, items, overlap)`` for every row of ``docs``.

    ``items`` lists the item ids held, ascending and comma-joined; ``overlap`` is the largest share of
    an item's tokens found among them (0 without any).
    """
    found = leaks(docs, items, window, percent).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")), ",").alias("items"),
        F.max(F.col("n_found") / F.col("n_tokens")).alias("overlap"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = leaks(docs, items).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
