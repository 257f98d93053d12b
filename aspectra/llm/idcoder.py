"""Operator 2: token ids in a binary format of adaptively coded, checksummed blocks.

Ids are coded by a 64-bit range coder.  Three predictions are mixed for each id: the id that last
followed the two preceding ids (order 2) or, without one, the preceding id (order 1), and the
segment's id frequencies (order 0).  The weight of the former against order 0 is learned while coding,
separately for each situation (which of them exist, whether they agree, whether the last one was
right).  Every block of ``BLOCK_IDS`` ids starts from the same fresh state and has its own CRC-32, so
it is decoded alone.  All blocks of a segment are coded in step, one numpy operation for all of them.

File format: a Parquet table of segments ``(part, seq, n_docs, n_ids, payload)`` in document order.
A payload is, little-endian: the magic ``IDM1``; uint32 counts of documents, ids, distinct ids,
buckets' total bits and blocks; uint32 CRC-32 of the rest up to the blocks; one byte per document (1:
it has an id), int64 document ids, int64 document lengths; uint32 distinct ids by falling frequency;
uint16 bucket frequencies; then for each block uint32 CRC-32, ids and 32-bit words; then all words.

Defined results: null and empty texts hold the end id alone; documents are ordered by ``doc_id``
(null first), equal ids by a hash of the text, and each row is its own document; other columns are
ignored; an empty table gives no segment and no row.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm import words as W
from aspectra.llm.tables import arrow_batches
from aspectra.session import scratch_path

END_ID = 2
BLOCK_IDS = 2048
SEGMENT_IDS = 8 << 20
#: words, and runs of letters or marks, whose ids a task remembers (about 60 bytes each)
CACHE_WORDS, CACHE_PIECES = 2_000_000, 1_000_000
#: ids that are remembered for each of them on the average; where they have more, a task forgets them sooner
_IDS_A_WORD = 8
#: text bytes whose ids are found at once
TEXT_BYTES = 1 << 20

# ---------------------------------------------------------------- the model and the coder

_MAGIC = b"IDM1"
#: blocks coded in step, half as many more at most
LANES = 4096
_STEPS = 64  # steps whose ids are laid out at once
_SLOTS = 10  # log2 of the slots of a block's table
_FULL = np.uint64(12)  # bits of the probability of a hit
_TOTAL = 14  # bits of the bucket frequencies
_U32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)
_ONE = np.uint64(1)
#: ids of higher rank are never predicted
_PREDICTED = 65_534
# Probabilities of a hit in 1 / 4096, at 2 * situation + (whether the last prediction was right).
# Situations: no prediction; order 1 alone; order 2, order 1 says otherwise; both agree.
_START = np.array([0, 0, 1200, 1200, 1200, 1200, 2400, 2400], np.uint16)
_HIT, _MISS = 4064, 32  # where a probability moves
_THIRD, _TWO_THIRDS = np.uint32(-(-(1 << 32) // 3)), np.uint32(-(-(2 << 32) // 3))


def _buckets(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each rank below ``n``; first rank and bits of each bucket: four to a power of two."""
    rank = np.arange(max(n, 1), dtype=np.int64)
    bits = np.maximum(np.floor(np.log2(rank + 0.5)).astype(np.int64) - 2, 0)
    bits[:8] = 0
    head = rank >> bits << bits
    first, bucket = np.unique(head, return_inverse=True)
    return bucket, first.astype(np.uint64), bits[first].astype(np.uint64)


class _Lanes:
    """The adaptive state of many blocks side by side.

    A block's table has a slot for each hash of the preceding id, which holds four ids (rank + 1, 0 for
    none) of 16 bits: the last one that followed (order 1), and the last one that followed for each of
    three hashes of the id before that (order 2).
    """

    def __init__(self, n: int, n_ranks: int):
        lane = np.arange(n, dtype=np.int64)
        self.table = np.zeros(n << _SLOTS + 2, np.uint16)
        self.chance = np.tile(_START, n)
        self.at_slot, self.at_state = lane << _SLOTS + 2, lane << 3
        self.prev = np.zeros(n, np.uint32)
        self.field = np.ones(n, np.uint8)
        self.right = np.zeros(n, bool)
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.all_predicted = n_ranks <= _PREDICTED

    def shorten(self, n: int) -> None:
        for k in ("at_slot", "at_state", "prev", "field", "right", "low", "range"):
            setattr(self, k, getattr(self, k)[:n])

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id (rank + 1, 0 for none) and the part of the range that a hit takes."""
        hashed = self.prev * np.uint32(0x9E3779B1)
        hashed >>= 32 - _SLOTS
        hashed <<= 2
        self.one = self.at_slot + hashed
        self.two = self.one + self.field
        one, two = self.table.take(self.one, mode="wrap"), self.table.take(self.two, mode="wrap")
        has = two > 0
        guess = np.where(has, two, one)
        situation = (guess > 0).view(np.uint8) + has.view(np.uint8)
        has &= one == two
        situation += has.view(np.uint8)
        situation += situation
        situation += self.right.view(np.uint8)
        self.state = self.at_state + situation
        self.now = self.chance.take(self.state, mode="wrap")
        part = self.range >> _FULL
        part *= self.now
        return guess, part

    def narrow(self, hits: np.ndarray, part: np.ndarray) -> None:
        """All lanes but ``hits``, whose prediction was right, take the range above ``part``."""
        low = self.low.take(hits)
        self.low += part
        self.range -= part
        self.low[hits] = low
        self.range[hits] = part.take(hits)

    def learn(self, miss: np.ndarray, token: np.ndarray) -> None:
        """``token``: rank + 1 of the id just coded."""
        now = self.now.view(np.int16)
        # a sixteenth of the way up or down, rounded down; 0 stays 0
        up = now + ((_HIT - now) >> 4)
        down = now - (np.maximum(now - (_MISS - 15), 0) >> 4)
        self.chance[self.state] = np.where(miss, down, up).view(np.uint16)
        kept = (token if self.all_predicted else token * (token <= _PREDICTED)).astype(np.uint16)
        self.table[self.one] = kept
        self.table[self.two] = kept
        # the place in a slot for the id that has just become the one before the last
        hashed = self.prev * np.uint32(0x85EBCA6B)
        self.field = (hashed >= _THIRD).view(np.uint8) + (hashed >= _TWO_THIRDS).view(np.uint8)
        self.field += 1
        self.prev = token
        self.right = ~miss

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Shift out the top 32 bits where the range has become short; those lanes and their words."""
        at = (self.range <= _LOW32).nonzero()[0]
        if not len(at):
            return at, at
        low, size = self.low.take(at), self.range.take(at)
        rest = low & _LOW32
        size = np.minimum(size, (_LOW32 + _ONE) - rest)  # no carry into the words already out
        self.low[at] = rest << _U32
        self.range[at] = size << _U32
        return at, (low >> _U32).astype(np.uint32)


class _Out:
    """The words of all lanes in the order in which they come."""

    def __init__(self, n: int):
        self.kind = np.min_scalar_type(max(n - 1, 0))
        self.lanes, self.words = [np.zeros(0, self.kind)], [np.zeros(0, np.uint32)]
        self.n = n

    def put(self, lanes, words) -> None:
        if len(lanes):
            self.lanes.append(lanes.astype(self.kind))
            self.words.append(words)

    def by_lane(self) -> list[np.ndarray]:
        lanes = np.concatenate(self.lanes)
        words = np.concatenate(self.words).take(np.argsort(lanes, kind="stable"))
        return np.split(words, np.cumsum(np.bincount(lanes, minlength=self.n))[:-1])


def _bucket_table(freq: np.ndarray):
    ends = np.cumsum(freq)
    return (ends - freq).astype(np.uint64), freq.astype(np.uint64), np.repeat(np.arange(len(freq)), freq)


def _lanes_at(lengths: np.ndarray) -> list[int]:
    """The number of blocks that have an id at each step; ``lengths`` fall."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]))).tolist()


def _lane_groups(lengths: np.ndarray):
    """About LANES blocks each, none of them much smaller: a step costs nearly as much for a few blocks."""
    n = len(lengths)
    groups = max(1, round(n / LANES)) if n else 0
    for k in range(groups):
        yield slice(k * n // groups, (k + 1) * n // groups)


def encode_blocks(ranks: np.ndarray, lengths: np.ndarray, freq: np.ndarray, n_ranks: int) -> list[np.ndarray]:
    """The words of each block; ``lengths`` fall, ``ranks`` holds the blocks one after another."""
    bucket, first_rank, bits = _buckets(n_ranks)
    starts, sizes, _ = _bucket_table(freq)
    # of each rank: what its part of the range is multiplied by, and by what the range is divided
    tables = starts[bucket], sizes[bucket], bits[bucket], np.arange(len(bucket), dtype=np.uint64) - first_rank[bucket]
    begin = np.cumsum(lengths) - lengths
    return [w for g in _lane_groups(lengths) for w in _encode_group(ranks, begin[g], lengths[g], tables)]


def _encode_group(ranks, begin, lengths, tables) -> list[np.ndarray]:
    starts, sizes, bits, offsets = tables
    lanes, out = _Lanes(len(lengths), len(starts)), _Out(len(lengths))
    for step, n in enumerate(_lanes_at(lengths)):
        if n < len(lanes.prev):
            _flush(lanes, out, n)
        if step % _STEPS == 0:
            by_step = ranks.take(begin[:n] + np.arange(step, step + _STEPS)[:, None], mode="clip")
        rank = by_step[step % _STEPS, :n]
        token = rank + np.uint32(1)
        guess, part = lanes.predict()
        miss = token != guess
        hits = (~miss).nonzero()[0]
        lanes.narrow(hits, part)
        out.put(*lanes.settle())
        if len(hits) < n:
            # for all lanes, as most of them miss; the hits get their own back
            low, size = lanes.low.take(hits), lanes.range.take(hits)
            lanes.range >>= np.uint64(_TOTAL)
            lanes.low += starts.take(rank) * lanes.range
            lanes.range *= sizes.take(rank)
            lanes.range >>= bits.take(rank)
            lanes.low += offsets.take(rank) * lanes.range
            lanes.low[hits], lanes.range[hits] = low, size
            out.put(*lanes.settle())
        lanes.learn(miss, token)
    _flush(lanes, out, 0)
    del lanes, by_step
    return out.by_lane()


def _flush(lanes: _Lanes, out: _Out, n: int) -> None:
    """End the lanes from ``n`` on: two words fix a number in the last interval."""
    ended = np.arange(n, len(lanes.prev))
    out.put(ended, (lanes.low[ended] >> _U32).astype(np.uint32))
    out.put(ended, (lanes.low[ended] & _LOW32).astype(np.uint32))
    lanes.shorten(n)


def decode_blocks(words: list[np.ndarray], lengths: np.ndarray, freq: np.ndarray, n_ranks: int) -> np.ndarray:
    """The ranks of all blocks, one after another; ``lengths`` fall."""
    _, first_rank, bits = _buckets(n_ranks)
    starts, sizes, bucket_at = _bucket_table(freq)
    tables = tuple(x[bucket_at] for x in (starts, sizes, bits, first_rank))
    parts = [_decode_group(words[g], lengths[g], tables, n_ranks) for g in _lane_groups(lengths)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint32)


def _decode_group(words, lengths, tables, n_ranks) -> np.ndarray:
    starts, sizes, bits, firsts = tables
    longest = int(lengths[0])
    out, by_step = np.empty((len(lengths), longest), np.uint32), np.empty((_STEPS, len(lengths)), np.uint32)
    lanes = _Lanes(len(lengths), n_ranks)
    size = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate([*words, np.zeros(2, np.uint32)])
    at_word = np.cumsum(size) - size
    # how far the coded number lies above the low end
    above = (flat[at_word].astype(np.uint64) << _U32) | flat[at_word + 1]
    at_word += 2

    def settle():
        moved, _ = lanes.settle()
        if len(moved):
            at = at_word.take(moved)
            above[moved] = (above.take(moved) << _U32) | flat.take(at)
            at_word[moved] = at + 1

    for step, n in enumerate(_lanes_at(lengths)):
        if n < len(lanes.prev):
            lanes.shorten(n)
            above, at_word = above[:n], at_word[:n]
        guess, part = lanes.predict()
        miss = above >= part
        hits = (~miss).nonzero()[0]
        held = above.take(hits)
        above -= part
        above[hits] = held
        lanes.narrow(hits, part)
        settle()
        token = guess.astype(np.uint32)
        if len(hits) < n:
            # for all lanes, as most of them miss; the hits get their own back
            low, size, held = lanes.low.take(hits), lanes.range.take(hits), above.take(hits)
            lanes.range >>= np.uint64(_TOTAL)
            slot = (above // lanes.range).view(np.int64)
            start = starts.take(slot, mode="clip")
            start *= lanes.range
            lanes.range *= sizes.take(slot, mode="clip")
            lanes.range >>= bits.take(slot, mode="clip")
            above -= start
            rest = above // lanes.range
            found = firsts.take(slot, mode="clip") + rest
            rest *= lanes.range
            above -= rest
            lanes.low += start
            lanes.low += rest
            lanes.low[hits], lanes.range[hits], above[hits] = low, size, held
            kept = token.take(hits)
            token = found.astype(np.uint32)
            token += np.uint32(1)
            token[hits] = kept
            settle()
        lanes.learn(miss, token)
        by_step[step % _STEPS, :n] = token
        if (step + 1) % _STEPS == 0 or step + 1 == longest:
            at = step - step % _STEPS
            out[:, at:step + 1] = by_step[:step + 1 - at].T
    del lanes
    out -= np.uint32(1)
    if (lengths[:-1] == longest).all():
        return out.ravel()[:int(lengths.sum())]
    return np.concatenate([row[:n] for row, n in zip(out, lengths.tolist())])


# ---------------------------------------------------------------- segments

def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of whole documents."""
    distinct, inverse, count = _distinct(ids)
    order = np.argsort(-count, kind="stable")
    rank_of = np.zeros(int(inverse.max(initial=0)) + 1, np.uint32)
    rank_of[distinct[order] if inverse is ids else order] = np.arange(len(order))
    bucket, _, _ = _buckets(len(distinct))
    freq = np.bincount(bucket, weights=count[order] if len(order) else None)
    freq = np.maximum((freq * ((1 << _TOTAL) - len(freq)) // max(1, len(ids))).astype(np.int64), 1)
    freq[0] += (1 << _TOTAL) - freq.sum()
    n_blocks = -(-len(ids) // BLOCK_IDS)
    sizes = np.full(n_blocks, BLOCK_IDS, np.int64)
    if n_blocks:
        sizes[-1] = len(ids) - (n_blocks - 1) * BLOCK_IDS
    blocks = []
    for g in _lane_groups(sizes):  # what is coded is kept as bytes, so that one group's arrays are held at a time
        part = inverse[g.start * BLOCK_IDS:g.stop * BLOCK_IDS]
        blocks += [w.astype("<u4").tobytes() for w in encode_blocks(rank_of.take(part), sizes[g], freq, len(distinct))]
    head = b"".join([np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
                     np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<i8").tobytes(),
                     distinct[order].astype("<u4").tobytes(), freq.astype("<u2").tobytes()])
    table = b"".join(struct.pack("<III", zlib.crc32(w), n, len(w) // 4) for w, n in zip(blocks, sizes.tolist()))
    return b"".join([_MAGIC, struct.pack("<IIIII", len(doc_ids), len(ids), len(distinct), _TOTAL, n_blocks),
                     struct.pack("<I", zlib.crc32(head)), head, table, *blocks])


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, what each id has its rank by (the id, or where that is large its place), and their counts."""
    top = int(ids.max(initial=0)) + 1
    if top > 1 << 22:
        distinct, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
        return distinct, inverse, count
    count = np.zeros(top, np.int64)
    for k in range(0, len(ids), 1 << 20):  # bincount copies what it counts as 64-bit numbers
        count += np.bincount(ids[k:k + (1 << 20)], minlength=top)
    distinct = np.flatnonzero(count)
    return distinct, ids, count[distinct]


def unpack(segment: bytes | pa.Buffer) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a segment; raises ValueError where a checksum fails."""
    segment = memoryview(segment)
    if segment[:4] != _MAGIC:
        raise ValueError("not an id segment")
    n_docs, n_ids, n_ranks, _, n_blocks = struct.unpack_from("<IIIII", segment, 4)
    crc, = struct.unpack_from("<I", segment, 24)
    n_buckets = len(_buckets(n_ranks)[1])
    at = 28
    parts = []
    for count, kind in ((n_docs, "u1"), (n_docs, "<i8"), (n_docs, "<i8"), (n_ranks, "<u4"), (n_buckets, "<u2")):
        parts.append(np.frombuffer(segment, kind, count, at))
        at += parts[-1].nbytes
    if zlib.crc32(segment[28:at]) != crc:
        raise ValueError("the segment's header is damaged")
    has, doc_ids, lengths, distinct, freq = parts
    table = np.frombuffer(segment, "<u4", 3 * n_blocks, at).reshape(-1, 3).astype(np.int64)
    at += 12 * n_blocks
    words = []
    for k, (sum_, _, n) in enumerate(table):
        words.append(np.frombuffer(segment, "<u4", n, at))
        at += 4 * int(n)
        if zlib.crc32(words[-1]) != sum_:
            raise ValueError(f"block {k} is damaged")
    ids = np.zeros(n_ids, np.uint32)
    ends = np.cumsum(table[:, 1])
    for g in _lane_groups(table):
        ranks = decode_blocks(words[g], table[g, 1], freq.astype(np.int64), n_ranks)
        into = ids[int(ends[g.start] - table[g.start, 1]):int(ends[g.stop - 1])]
        for k in range(0, len(ranks), 1 << 20):  # take copies its indices as 64-bit numbers
            into[k:k + (1 << 20)] = distinct.take(ranks[k:k + (1 << 20)])
        del ranks
    return [int(d) if h else None for d, h in zip(doc_ids, has)], lengths, ids


# ---------------------------------------------------------------- ids of texts

# a word of these letters and closing marks is two pieces of the tokenizer, its letters and its marks,
# and no normalisation but lower case touches it: A-Z, a-z and the letters of U+00C0 to U+00FF
_OTHER, _LETTER, _MARK, _GAP = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b".,!?*$%#&|;:")] = _MARK
_KIND[32] = _GAP


def _cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words with a space after each: which are letters and closing marks, and where the marks of those start."""
    kind = _KIND.take(data)
    two = np.flatnonzero(data[:-1] == 0xC3)
    after = data[two + 1]
    two = two[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
    kind[two] = kind[two + 1] = _LETTER
    before = np.r_[np.uint8(_GAP), kind[:-1]]
    bad = np.flatnonzero((kind == _OTHER) | ((kind == _LETTER) & (before == _MARK)) | ((kind == _MARK) & (before == _GAP)))
    simple = np.ones(len(starts), bool)
    simple[np.searchsorted(starts, bad, side="right") - 1] = False
    cut = np.flatnonzero((kind == _MARK) & (before == _LETTER))
    return simple, cut[simple[np.searchsorted(starts, cut, side="right") - 1]]


# fixed values: the settings of a tokenizer under which the ids of a text are those of its words, in lower case
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> np.ndarray:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = np.zeros(256, "<u4")
    letters[plain] = plain
    rest = np.flatnonzero(letters == 0)
    letters[rest] = 256 + np.arange(len(rest))
    return letters


def _spread(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The spans of ``flat`` that start ``at`` and have ``n`` elements, one after another."""
    total = np.r_[0, np.cumsum(n)]
    return flat[np.repeat(at - total[:-1], n) + np.arange(total[-1])]


class _Known:
    """Ids of words or pieces by their hash: a table of open addresses, and spans of one array, which starts with END_ID.

    ``find`` numbers the entries from 1; number 0 stands for a hash that is not there, and for the end id.
    """

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.bits = 12
        self.table = np.zeros(1 << self.bits, np.int32)
        self.size = 1
        self.keys = np.zeros(1, np.uint64)
        self.at, self.n = np.zeros(1, np.int32), np.ones(1, np.int32)
        self.flat, self.used = np.full(1, END_ID, np.uint32), 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the entry of each key."""
        place = self._place(keys)
        entry = self.table.take(place)
        other = ((self.keys.take(entry) != keys) & (entry > 0)).nonzero()[0]
        place = place.take(other)
        while len(other):
            place = (place + 1) & ((1 << self.bits) - 1)
            e = self.table.take(place)
            entry[other] = e
            on = (self.keys.take(e) != keys.take(other)) & (e > 0)
            other, place = other[on], place[on]
        return entry

    def full(self, new: int) -> bool:
        """Whether ``new`` more would be too many; then all are forgotten."""
        if self.size == 1 or (self.size - 1 + new <= self.most and self.used <= _IDS_A_WORD * self.most):
            return False
        self._clear()
        return True

    def _enter(self, entry: np.ndarray) -> None:
        place = self._place(self.keys[entry])
        while len(entry):
            free = self.table.take(place) == 0
            self.table[place[free]] = entry[free]
            on = self.table.take(place) != entry
            entry, place = entry[on], (place[on] + 1) & ((1 << self.bits) - 1)

    def add(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """``keys`` are distinct and new."""
        first, self.size = self.size, self.size + len(keys)
        if self.size > len(self.keys):
            room = self.size + self.size // 4
            self.keys, self.at, self.n = (np.concatenate([x[:first], np.zeros(room - first, x.dtype)])
                                          for x in (self.keys, self.at, self.n))
        self.keys[first:self.size] = keys
        self.at[first:self.size] = self.used + np.cumsum(n) - n
        self.n[first:self.size] = n
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat[:start], np.empty(len(ids) + start // 4, np.uint32)])
        self.flat[start:self.used] = ids
        if 2 * self.size > len(self.table):
            self.bits = (2 * self.size).bit_length()
            self.table = np.zeros(1 << self.bits, np.int32)
            first = 1
        self._enter(np.arange(first, self.size, dtype=np.int32))

    def found(self, keys: np.ndarray, make) -> np.ndarray:
        """The number of the entry of each key; ``make(places)`` gives lengths and ids of those that are new."""
        entry = self.find(keys)
        new = (entry == 0).nonzero()[0]
        if len(new):
            u, first = np.unique(keys[new], return_index=True)
            if self.full(len(u)):
                new = np.arange(len(keys))
                u, first = np.unique(keys, return_index=True)
            self.add(u, *make(new[first]))
            entry[new] = self.find(keys[new])
        return entry


class Ids:
    """The ids of texts, word by word where the tokenizer's settings allow it, else text by text.

    A tokenizer of those settings drops white space and never joins across it, so the ids of a text are
    those of its words; distinct words are encoded once and remembered, and so are the pieces of new words.
    Texts that may hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.by_word = settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _PRE_TOKENIZER
        self.special = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.words, self.pieces = _Known(CACHE_WORDS), _Known(CACHE_PIECES)

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, simple: np.ndarray) -> list[list[int]]:
        """The ids of pieces; those that are not simple are whole words."""
        low = W.LOWER.take(data)
        two = (low[:-1] == 0xC3).nonzero()[0] + 1
        # U+00C0 to U+00DE; of the letters after them none has another lower case
        two = two[(low[two] >= 0x80) & (low[two] <= 0x9E) & (low[two] != 0x97)]
        low[two] += 32
        mapped = self.letters.take(low).tobytes().decode("utf-32-le")
        tokenize, out = self.tokenize, [[]] * len(start)
        for k, a, b in zip(simple.nonzero()[0].tolist(), start[simple].tolist(), end[simple].tolist()):
            out[k] = [t.id for t in tokenize(mapped[a:b])]
        raw, other = data.tobytes(), (~simple).nonzero()[0]
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[other].tolist(), end[other].tolist())]
        for k, e in zip(other.tolist(), self.tokenizer.encode_batch(words, add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _of_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids; words are cut into pieces, and distinct pieces encoded once."""
        length = end - start
        base = np.cumsum(length + 1) - length - 1
        text = np.full(int(base[-1] + length[-1]) + 1, 32, np.uint8)
        text[_spread(np.arange(len(text)), base, length)] = _spread(data, start, length)
        simple, cuts = _cuts(text, base)
        h, s, e = W.word_spans(text, np.r_[0, cuts, len(text)])

        def encode(i):
            ids = self._encode(text, s[i], e[i], simple[np.searchsorted(base, s[i], side="right") - 1])
            return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint32)

        entry = self.pieces.found(h, encode)
        n = self.pieces.n.take(entry)
        return np.add.reduceat(n, np.searchsorted(s, base)), _spread(self.pieces.flat, self.pieces.at.take(entry), n)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row closed by END_ID, and the number of each row."""
        if not self.by_word:
            return self._whole(data, offsets)
        h, start, end = W.word_spans(data, offsets)
        bounds = np.searchsorted(start, offsets)
        # the end id is one more word of every row, entry 0
        entry = np.insert(self.words.found(h, lambda i: self._of_words(data, start[i], end[i])), bounds[1:], 0)
        word_n = self.words.n.take(entry)
        row_bounds = bounds + np.arange(len(bounds))
        total = np.r_[0, np.cumsum(word_n, dtype=np.int64)]
        ids = _spread(self.words.flat, self.words.at.take(entry), word_n)
        lengths = total[row_bounds[1:]] - total[row_bounds[:-1]]
        return self._special(data, offsets, ids, lengths)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = data.tobytes(), offsets.tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        ids = [np.array([*e.ids, END_ID], np.uint32) for k in range(0, len(texts), 256)
               for e in self.tokenizer.encode_batch(texts[k:k + 256], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _special(self, data, offsets, ids, lengths):
        mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|"
        rows = np.unique(np.searchsorted(offsets, mark, side="right") - 1)
        if not len(rows):
            return ids, lengths
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for r in rows:
            text = data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace")
            parts[r] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_LOADED: dict[str, Ids] = {}

SEGMENT = "part int, seq int, n_docs long, n_ids long, payload binary"


def _write_segments(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        # a worker keeps its words between tasks
        if path not in _LOADED:
            _LOADED[path] = Ids(path)
        coder = _LOADED[path]
        part, seq = TaskContext.get().partitionId(), 0
        docs, lengths = [], []
        ids, held = np.zeros(0, np.uint32), 0

        def segment():
            W.release_memory()
            n = np.concatenate(lengths)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_docs": pa.array([len(n)], pa.int64()), "n_ids": pa.array([held], pa.int64()),
                "payload": pa.array([pack(docs, n, ids[:held])], pa.binary())})

        for batch, data, offsets in W.chunks(batches, max_bytes=TEXT_BYTES):
            x, n = coder.of(data, offsets)
            docs += batch.column("doc_id").to_pylist()
            lengths.append(n)
            if held + len(x) > len(ids):
                # one array is filled; pages of it that hold nothing yet take no memory
                ids = np.concatenate([ids[:held], np.empty(max(len(x), SEGMENT_IDS // 4), np.uint32)])
            ids[held:held + len(x)] = x
            held += len(x)
            if held >= SEGMENT_IDS:
                yield segment()
                W.release_memory()
                seq += 1
                docs, lengths, held = [], [], 0
        if docs:
            yield segment()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """The ids of ``docs (doc_id, text)`` in ascending ``doc_id`` order, as segments under ``path``."""
    ordered = (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    with arrow_batches(docs.sparkSession, 4 * TEXT_BYTES):
        ordered.mapInArrow(_write_segments(tokenizer_path), SEGMENT).write.parquet(path)


def read(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the segments."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                docs, n, ids = unpack(batch.column("payload")[k].as_buffer())
                end = np.cumsum(n)
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((end - n).tolist(), end.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, pa.int64()), "start": pa.array(batch.column("before")[k].as_py() + end - n),
                    "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())})
                del ids, raw
                W.release_memory()

    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = (segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_in"))
              .join(before, "part").select("part", "seq", (F.col("_base") + F.col("_in")).alias("before")))
    return segments.join(places, ["part", "seq"]).select("payload", "before").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write(docs, path, tokenizer_path)
    return read(spark.read.schema(SEGMENT).parquet(path))
