"""Words of whole texts as 64-bit hashes, computed over Arrow text buffers with numpy.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``
(``[^\\x20\\x09-\\x0D]+``); A-Z count as a-z.  Two different words share a hash with a
probability of about 2**-64, so n distinct words collide somewhere with about n**2 / 2**65.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: text bytes worked on at once; a longer text is cut between words
PIECE = 2 << 20
_POSITIONS = 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (every input bit reaches every output bit)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers for ``seed``."""
    i = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(i + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))) | np.uint64(1)


#: a random number for each byte at each position, at 256 * position + byte
_BYTE_AT = mix(constants(_POSITIONS * 256, 1))
_FAR = constants(4096, 2)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text",
           max_bytes: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of at most ``max_bytes`` of text (one row at least), with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            i = j


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end between words."""
    a = 0
    while a < len(data):
        b = a + PIECE
        while b < len(data):
            gap = np.flatnonzero(_SPACE[data[b:b + 4096]])
            if len(gap):
                b += int(gap[0])
                break
            b += 4096
        b = min(b, len(data))
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (byte positions) of every word, in order; no word spans two rows."""
    if len(data) <= PIECE:
        return _spans(data, offsets[:-1])
    parts = []
    for a, b in _pieces(data, offsets):
        inside = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        h, s, e = _spans(data[a:b], inside)
        parts.append((h, s + a, e + a))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _spans(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE.take(data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = row_starts[row_starts < len(data)]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    last = word.copy()
    last[:-1] &= first[1:] | ~word[1:]
    length = np.flatnonzero(last) + 1 - starts
    begin = np.cumsum(length) - length
    place = np.arange(begin[-1] + length[-1]) - np.repeat(begin, length)
    far = np.flatnonzero(place >= _POSITIONS) if length.max() > _POSITIONS else None
    place = (place & (_POSITIONS - 1)) << 8
    place += LOWER.take(data)[word]
    value = _BYTE_AT.take(place)
    if far is not None:
        where = far - np.repeat(begin, length)[far]
        value[far] *= _FAR[(where // _POSITIONS) % len(_FAR)]
    h = np.add.reduceat(value, begin)
    h += length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), starts, starts + length


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the n + 1 positions where the words of each row start."""
    h, starts, _ = word_spans(data, offsets)
    return h, np.searchsorted(starts, offsets)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element, from the n + 1 bounds of the rows."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def unique_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their number (or summed weight)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(weights[order], head) if len(k) else weights[:0]


def release_memory() -> None:
    """Return what numpy has freed to the system: glibc keeps it, and a worker lives on between tasks."""
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
