"""Operator 3: language identification by known words, backing off to shorter character n-grams.

Words are runs of letters, in lower case.  A word of the model adds its log frequency in each
language; an unseen word is scored by its character n-grams of the longest size of which the model
knows any (5, 4, 3, 2, then 1; word edges count as a character), by the mean of their log
frequencies.  The language with the largest sum wins; ``score`` is its softmax share.

The model is fitted on labelled rows only: at most about ``FIT_ROWS`` per language, chosen by a hash
of ``doc_id``.  It holds every word and n-gram of these rows; the bound on rows bounds the table that
every task receives (8 bytes a feature and 4 for each language).

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; with no
labelled row, or no feature known to the model, every language is equally likely and the first by
code point wins (``und``, score 0, if there is no language at all); ties go to the first language by code
point; each row is judged by its text alone, so equal rows agree; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm import words as W

SIZES = (5, 4, 3, 2, 1)
FIT_ROWS = 4_000
UNKNOWN = "und"

_EDGE = np.uint64(1)
_LETTER: list[np.ndarray] = []
_CHAR = W.constants(64, 21)
_GRAM = W.constants(8, 22)


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all rows and the n + 1 bounds of the rows."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    bounds = np.r_[0, np.cumsum(pc.utf8_length(low).to_numpy())].astype(np.int64)
    data, _ = W.text_bytes(low)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), bounds


@dataclass
class Words:
    """The words of some rows: hashes, code point spans and rows; ``letters`` marks rows with any."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    points: np.ndarray


def words_of(column: pa.Array) -> Words:
    points, bounds = _code_points(column)
    letter = _letters()[points]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = bounds[:-1][bounds[:-1] < len(points)]
    first[at] = letter[at]
    start = np.flatnonzero(first)
    where = np.flatnonzero(letter)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, points)
    of = np.cumsum(first[where]) - 1
    place = where - start[of]
    value = W.mix(points[where].astype(np.uint64) * _CHAR[place & 63] + (place >> 6).astype(np.uint64))
    begin = np.searchsorted(where, start)
    length = np.diff(np.append(begin, len(where)))
    h = W.mix(np.add.reduceat(value, begin) + length.astype(np.uint64))
    return Words(h, start, start + length, np.searchsorted(bounds, start, side="right") - 1, points)


def grams(words: Words, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the chosen words (edges count as a character), and each one's word."""
    length = words.end[which] - words.start[which] + 2
    n = np.maximum(length - size + 1, 0) if size > 1 else length - 2
    of = np.repeat(np.arange(len(which)), n)
    skip = 0 if size > 1 else 1
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + skip
    base = words.start[which][of] - 1 + place
    h = np.full(len(of), _GRAM[size], np.uint64)
    for k in range(size):
        at = base + k
        edge = (at < words.start[which][of]) | (at >= words.end[which][of])
        c = words.points[np.clip(at, 0, max(len(words.points) - 1, 0))].astype(np.uint64) + np.uint64(2)
        h = W.mix(h + np.where(edge, _EDGE, c) * _CHAR[k])
    return h, of


def _fit_counts(langs: list[str]):
    """Rows ``(size, h, lang, n)``: word (size 0) and n-gram counts of each language."""
    def run(batches):
        for batch, _, _ in W.chunks(batches, max_bytes=1 << 20):
            w = words_of(batch.column("text"))
            lang = pc.index_in(batch.column("lang"), pa.array(langs)).to_numpy().astype(np.int64)[w.row]
            every = np.arange(len(w.hash))
            for size in (0, *SIZES):
                h, of = (w.hash, every) if size == 0 else grams(w, every, size)
                for k in range(len(langs)):
                    u, n = np.unique(h[lang[of] == k], return_counts=True)
                    if len(u):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(u), size, np.int32)), pa.array(u.view(np.int64)),
                             pa.array(np.full(len(u), k, np.int32)), pa.array(n)], ["size", "h", "lang", "n"])

    return run


@dataclass
class Model:
    """Sorted hashes of each n-gram size (0: words) and their log frequencies by language."""
    langs: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def find(self, size: int, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        keys = self.keys[size]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (position), its share, and whether there is a letter, for each row."""
        w = words_of(column)
        total = np.zeros((len(column), len(self.langs)))
        at = self.find(0, w.hash)
        known = at >= 0
        self._add(total, w.row[known], self.logs[0][at[known]])
        left = np.flatnonzero(~known)
        for size in SIZES:
            if not len(left):
                break
            h, of = grams(w, left, size)
            at = self.find(size, h)
            hit = at >= 0
            number = np.bincount(of[hit], minlength=len(left))
            per_word = np.zeros((len(left), len(self.langs)))
            self._add(per_word, of[hit], self.logs[size][at[hit]])
            some = number > 0
            self._add(total, w.row[left[some]], per_word[some] / number[some, None])
            left = left[~some]
        has = np.bincount(w.row, minlength=len(column)) > 0
        share = np.exp(total - total.max(axis=1, keepdims=True))
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best] / share.sum(axis=1), has

    @staticmethod
    def _add(total: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(row, weights=values[:, k], minlength=len(total))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of ``labelled (doc_id, text, lang)``; the driver holds no more than its bounded features."""
    labelled = labelled.filter("lang is not null and text is not null")
    rows = labelled.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in rows)
    if not langs:
        return Model([], {}, {})
    share = F.create_map(*[x for r in rows for x in (F.lit(r["lang"]), F.lit(min(1.0, fit_rows / r["count"])))])
    chosen = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
                             < share[F.col("lang")] * (1 << 20))
    counts = (chosen.select("text", "lang").mapInArrow(_fit_counts(langs), "size int, h long, lang int, n long")
              .groupBy("size", "h").agg(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}")
                                          for k in range(len(langs))]))
    keys, logs = {}, {}
    got = counts.toArrow()
    size = got.column("size").to_numpy()
    h = got.column("h").to_numpy().view(np.uint64)
    n = np.stack([got.column(f"n{k}").to_numpy() for k in range(len(langs))], axis=1)
    for s in (0, *SIZES):
        mine = np.flatnonzero(size == s)
        mine = mine[np.argsort(h[mine])]
        c = n[mine].astype(np.float64)
        keys[s] = h[mine]
        logs[s] = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * (len(c) + 1))).astype(np.float32)
    return Model(langs, keys, logs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs (doc_id, text, ...)`` as ``(doc_id, lang_pred, score)``, a row for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        names = pa.array([*m.langs, UNKNOWN])
        for batch, _, _ in W.chunks(batches):
            if m.langs:
                best, score, has = m.score(batch.column("text"))
            else:
                best, score, has = (np.zeros(batch.num_rows, t) for t in (int, float, bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), names.take(pa.array(np.where(has, best, len(m.langs)).astype(np.int64))),
                 pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def held_out(doc_id="doc_id", folds: int = 5):
    """Whether the crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; held-out rows are not learned from."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which a language is identified, with all their columns; ``lang`` is that language.

    Rows predicted ``und`` (null texts and texts without a letter) are rejected.  Where no row is labelled
    there is nothing to predict: rows with a letter stay as they are.
    """
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("lang")

    def run(batches):
        m = held.value
        for batch, _, _ in W.chunks(batches):
            if m.langs:
                best, _, keep = m.score(batch.column("text"))
                batch = batch.set_column(at, batch.schema.field(at), pa.array(m.langs).take(pa.array(best)).cast(batch.schema.field(at).type))
            else:
                keep = np.bincount(words_of(batch.column("text")).row, minlength=batch.num_rows) > 0
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
