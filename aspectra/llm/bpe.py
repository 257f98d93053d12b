"""Operator 11: byte-level BPE by folds of ranked merges in Spark higher-order functions.

A text is cut into the matches of the vocabulary's pattern.  The byte array of a match is folded: every
step finds the lowest rank of any adjacent pair in a literal rank map and merges that pair everywhere,
until no pair has a rank.  The tokens under way are the characters of one string (token i is character
65536 + i), so that a merge is a linear ``replace``.

Distinct matches are counted over all documents, and the most frequent ones (``KNOWN`` at most, of
``KNOWN_BYTES`` at most) are folded once; this dictionary of bounded size goes to the tasks, which look
matches up in Arrow batches.  All other matches are folded where they stand, so no word is left out and
nothing that grows with the corpus is sent anywhere.  Decoding concatenates the binary pieces of the ids.

The rank map is an array of small maps, found by a hash of the pair, because a look-up in one Spark map
reads all its keys.  Ranks are taken to be those of BPE training, where a piece comes from two pieces of
lower rank; pieces that no merges make are looked up whole.

Defined results: null texts are empty and have no ids; other columns are ignored; repeated rows each give
a row; an empty table gives an empty result; ``doc_id`` may be null.  A match of n bytes takes at most n
steps of n look-ups each.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.tables import written

#: matches that a task works on at once (one text at least)
AT_ONCE = 1 << 18
#: words of the dictionary: it bounds what is sent to the tasks, not what is encoded
KNOWN = 1 << 19
KNOWN_BYTES = 48
BUCKETS = 1 << 14
_FIRST = 0x10000
_LEVELS = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token(i: int) -> str:
    return chr(_FIRST + i)


def bucket(*key: Column) -> Column:
    return F.hash(*key).bitwiseAND(F.lit(BUCKETS - 1))


def bucketed(pairs: DataFrame, *key: Column) -> Column:
    """The strings ``(k, v)`` of a bounded table as a literal: an array of small maps, placed by a hash of ``key``."""
    small = (pairs.groupBy(bucket(*(key or (F.col("k"),))).alias("b"))
             .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("m")))
    found = small.toArrow()
    slots = ["{}"] * BUCKETS
    for b, m in zip(found.column("b").to_pylist(), found.column("m").to_pylist()):
        slots[b] = m
    return F.from_json(F.lit(f"[{','.join(slots)}]"), "array<map<string,string>>")


def looked_up(table: Column, key: Column) -> Column:
    return F.get(table, bucket(key))[key]


def merges(ranks: dict[bytes, int]) -> tuple[list[tuple[bytes, bytes, int]], dict[bytes, int]]:
    """The pair ``(left, right, rank)`` that makes each piece, and the pieces that no merges make."""
    made, never = [], {}
    for piece, rank in ranks.items():
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank_at = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            low, i = min(rank_at)
            if low >= rank:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            made.append((*parts, rank))
        elif len(parts) > 2:
            never[piece] = rank
    return made, never


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces and ranks of a file of base64 pieces."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no rank for the bytes {missing[:5]}")
    return ranks


def rank_pieces(ranks: dict[bytes, int]) -> pa.Array:
    """The piece of each rank."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.large_binary())


class Vocabulary:
    """A file of base64 pieces and ranks as literal maps; ``pattern`` cuts the texts."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pieces = rank_pieces(ranks)
        self.pattern = spark_pattern(spark, pattern)
        self.bytes = "".join(token(ranks[bytes([b])]) for b in range(256))
        made, never = merges(ranks)
        pairs = [(token(ranks[a]) + token(ranks[b]), token(rank) + token(ranks[a]) + token(ranks[b])) for a, b, rank in made]
        self.ranks = bucketed(spark.createDataFrame(pairs, "k string, v string"), F.substring("k", 1, 1), F.substring("k", 2, 1))
        whole = [(p.hex().upper(), token(rank)) for p, rank in never.items()]
        self.whole = bucketed(spark.createDataFrame(whole, "k string, v string")) if whole else None

    def fold(self, word: Column) -> Column:
        """The tokens of one match."""
        raw = F.encode(word, "UTF-8")
        start = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, range(256))), self.bytes)

        def lowest(s):
            """The lowest merge of the tokens of ``s``: the new token and the pair, null if there is none."""
            return let(F.split(s, ""), lambda t: F.array_min(F.zip_with(
                t, F.slice(t, 2, F.size(t)), lambda a, b: F.get(self.ranks, bucket(a, b))[F.concat(a, b)])))

        def step(now, _):
            return F.when(now["done"], now).otherwise(let(lowest(now["s"]), lambda best: F.struct(
                F.coalesce(F.replace(now["s"], F.substring(best, 2, 2), F.substring(best, 1, 1)), now["s"]).alias("s"),
                best.isNull().alias("done"))))

        steps = F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - 1, F.lit(1)))
        folded = F.aggregate(steps, F.struct(start.alias("s"), F.lit(False).alias("done")), step, lambda now: now["s"])
        return folded if self.whole is None else F.coalesce(looked_up(self.whole, F.hex(raw)), folded)

    def matches(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))


@functools.cache
def _class(name: str) -> frozenset[str]:
    """The characters of a Unicode class as the tiktoken library sees it."""
    import tiktoken

    one = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(bytes(one.encode_ordinary(every)).decode())


def spark_pattern(spark: SparkSession, pattern: str) -> str:
    r"""``pattern`` for Spark's regular expressions, with the Unicode classes of the tiktoken library.

    ``\s`` is Unicode white space there; ``\p{L}`` and ``\p{N}`` of a newer Unicode than the JVM's
    get the characters that the JVM lacks.
    """
    row = spark.range(1).select(F.explode(F.array(F.lit("L"), F.lit("N"))).alias("name"))
    every = F.expr("array_join(transform(filter(sequence(1, 1114111), c -> c < 55296 or c > 57343), "
                   "c -> decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')), '')")
    seen = {r["name"]: set("".join(r["found"])) for r in row.select("name", F.when(
        F.col("name") == "L", F.regexp_extract_all(every, F.lit(r"\p{L}+"), F.lit(0))).otherwise(
        F.regexp_extract_all(every, F.lit(r"\p{N}+"), F.lit(0))).alias("found")).collect()}
    for name, known in seen.items():
        theirs = _class(rf"\p{{{name}}}")
        if known - theirs:
            raise ValueError(f"the JVM's class {name} holds characters that the tokenizer's lacks")
        if theirs - known:
            extra = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _runs(theirs - known))
            low = min(map(ord, theirs - known))
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}[\x{{{low:x}}}-\x{{10FFFF}}&&[{extra}]]]")
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def _runs(chars: set[str]) -> list[list[int]]:
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return runs


def slices(batches, column: str):
    """Slices of whole rows with at most AT_ONCE elements in a list column (one row at least)."""
    for batch in batches:
        offsets, i = np.asarray(batch.column(column).offsets), 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + AT_ONCE, side="right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def token_ids(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and ids of strings of tokens, each a character of four bytes."""
    if isinstance(strings, pa.ChunkedArray):
        strings = pa.concat_arrays(strings.chunks) if strings.num_chunks else pa.array([], pa.string())
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].reshape(-1, 4).astype(np.int32) if data else np.zeros((0, 4), np.int32)
    ids = ((b[:, 0] & 7) << 18 | (b[:, 1] & 63) << 12 | (b[:, 2] & 63) << 6 | b[:, 3] & 63) - _FIRST
    return (offsets - offsets[0]) // 4, ids


def known_words(docs: DataFrame, voc: Vocabulary) -> pa.Table:
    """``(word, tokens)``: the most frequent matches of all ``docs``, folded."""
    counts = written(docs.select(F.explode(voc.matches(F.col("text"))).alias("word"))
                     .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.octet_length("word") <= KNOWN_BYTES)
                     .select("word", F.floor(F.log(F.col("n").cast("double")) * _LEVELS).cast("int").alias("level")), "matches")
    least, total = 1 << 30, 0
    for level, n in sorted(map(tuple, counts.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > KNOWN:
            break
        least = level
    often = counts.filter(F.col("level") >= least)
    return often.select("word", voc.fold(F.col("word")).alias("tokens")).toArrow()


def places(values: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each value in ``known`` (distinct), -1 for none.

    The table is built of the distinct values, which are fewer than ``known`` and stay in the processor's cache.
    """
    coded = values.dictionary_encode()
    found = pc.index_in(known, coded.dictionary)
    at = np.full(len(coded.dictionary), -1, np.int32)
    at[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid())
    return at[coded.indices.to_numpy()]


def _split(docs: DataFrame, voc: Vocabulary, known: pa.Array) -> DataFrame:
    """``(doc_id, at, rest)``: each match as its place in the dictionary, -1 if it is the next one of ``rest``."""

    def rows(batches):
        for batch in slices(batches, "found"):
            lists = batch.column("found")
            bounds = np.asarray(lists.offsets).astype(np.int64)
            values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
            bounds -= bounds[0]
            at = places(values, known)
            missing = np.flatnonzero(at < 0)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(at)),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, bounds).astype(np.int32)), values.take(pa.array(missing)))],
                ["doc_id", "at", "rest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), voc.matches(F.col("text")).alias("found")).mapInArrow(
        rows, "doc_id long, at array<int>, rest array<string>")


def _ids(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and ids of the rows of a batch ``(doc_id, at, rest)`` whose ``rest`` is tokens; ``known``: as of ``token_ids``."""
    lists, rest = batch.column("at"), batch.column("rest").flatten()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    at = lists.values.to_numpy()[bounds[0]:bounds[-1]].astype(np.int64)
    bounds -= bounds[0]
    places, known_ids = known
    more, more_ids = token_ids(rest)
    starts = np.r_[places[:-1], more[:-1] + len(known_ids)]
    length = np.r_[np.diff(places), np.diff(more)]
    unknown = np.flatnonzero(at < 0)
    at[unknown] = len(places) - 1 + np.arange(len(unknown))
    n = length[at]
    ends = np.r_[0, np.cumsum(n)]
    where = np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])
    return ends[bounds], np.concatenate([known_ids, more_ids])[where]


def _folded(docs: DataFrame, voc: Vocabulary) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    table = known_words(docs, voc)
    words = pa.concat_arrays([pa.array([], pa.string()), *table.column("word").chunks])
    parts = _split(docs, voc, words).select("doc_id", "at", F.transform("rest", voc.fold).alias("rest"))
    return parts, token_ids(table.column("tokens"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs (doc_id, text)``."""
    parts, known = _folded(docs, Vocabulary(docs.sparkSession, path, pattern))

    def rows(batches):
        for batch in slices(batches, "at"):
            bounds, ids = _ids(batch, known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return parts.mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(bounds: np.ndarray, ids: np.ndarray, pieces: pa.Array) -> list[bytes]:
    """The concatenated pieces of each row of ids."""
    joined = pieces.take(pa.array(ids, pa.int64()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(ids) + 1]
    data = memoryview(joined.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(offsets[bounds[:-1]].tolist(), offsets[bounds[1:]].tolist())]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` for every row ``(doc_id, ids)``; bytes that are not UTF-8 become U+FFFD."""
    pieces = rank_pieces(read_ranks(path))

    def rows(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            texts = decoded(np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py(),
                            lists.flatten().to_numpy(), pieces)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(errors="replace") for t in texts], pa.string())],
                                             ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(rows, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row: of the ids, and of the bytes they decode to."""
    voc = Vocabulary(docs.sparkSession, path, pattern)
    parts, known = _folded(docs, voc)
    pieces = voc.pieces

    def rows(batches):
        for batch in slices(batches, "at"):
            bounds, ids = _ids(batch, known)
            packed = memoryview(ids.astype("<u4")).cast("B")
            ends = (bounds * 4).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in decoded(bounds, ids, pieces)], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return parts.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
