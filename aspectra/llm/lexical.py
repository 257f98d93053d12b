"""Operator 13: ranked lexical search over norm buckets, with exact integer scores.

A document becomes an impact vector: for each of the queries' terms it holds, the square root of the
term's weight times its impact; a query holds the square root of the weight times its count, so that
their inner product is the score.  Each task orders its vectors by length, longest first, and cuts
them into buckets.  For a query with the threshold t (its tenth best score so far)

* a bucket whose longest vector has ``|q| * |d| < t`` is pruned (Cauchy-Schwarz);
* inside, the query's heaviest coordinates are multiplied out and the rest is bounded by the product of
  the remaining lengths; vectors whose bound stays below t are passed over;
* survivors are scored again in 64-bit integers and enter the ten best of the task.

First only the longest vectors of all are searched, which gives every task a threshold to start from;
then all of them.  No document is shuffled: tasks return ten rows a query, and these are ranked.
Bounds are widened by more than the rounding of doubles, so nothing is pruned that could be ranked.

Terms are compared by 64-bit hashes (``words.py``).  Texts are reduced to the terms of the queries, if
these are up to ``SHIPPED`` distinct ones; if more, postings keep all terms.  Queries are worked on in
blocks of about ``BLOCK_TERMS`` terms; only one block's vectors are on the driver and in a task.

Defined results: every row of the documents is a document, also where ids repeat; rows of the queries
with equal id and text are one query; null texts hold no term; equal scores go by ascending ``doc_id``, null
first; only scores above 0 are ranked; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm import words
from aspectra.llm.tables import written

BEST = 10
#: distinct query terms that are sent to the tasks (8 bytes each)
SHIPPED = 1 << 22
#: distinct (query, term) pairs of a block
BLOCK_TERMS = 1 << 18
#: vectors and postings of a bucket
BUCKET_DOCS, BUCKET_POSTINGS = 2048, 1 << 20
#: about so many of the longest vectors give the first thresholds
LONGEST = 8192
#: coordinates of a query that are multiplied out before the rest is bounded
FOCUS = 12
_SLACK = 1e-7

#: bytes of terms in lower case, all others as a space
_TERM = np.full(256, 32, dtype=np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TERM[_a:_b] = words.LOWER[_a:_b]

_POSTINGS = "doc_id long, n long, terms array<long>, tfs array<int>"


def _term_counts(batches, vocabulary: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray, tuple]]:
    """Per slice of rows: its batch, the terms of each row, and (row, term, tf) of distinct terms, by row."""
    if vocabulary is not None:
        seen = np.zeros(1 << 22, dtype=bool)
        seen[(vocabulary & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    for batch, data, offsets in words.chunks(batches):
        h, bounds = words.word_hashes(_TERM.take(data), offsets)
        n, row = np.diff(bounds), words.rows_of(bounds)
        if vocabulary is not None and len(h):
            maybe = np.flatnonzero(seen[(h & np.uint64(len(seen) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(vocabulary, h[maybe]), max(len(vocabulary) - 1, 0))
            maybe = maybe[vocabulary[at] == h[maybe]] if len(vocabulary) else maybe[:0]
            h, row = h[maybe], row[maybe]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        yield batch, n, (row[first], h[first], np.diff(np.r_[first, len(h)]))


def postings(docs: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` for every row; of ``vocabulary`` only, if given."""

    def rows(batches):
        for batch, n, (row, term, tf) in _term_counts(batches, vocabulary):
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(term.view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _POSTINGS)


def _document_frequencies(found: DataFrame) -> DataFrame:
    """``(term, df)``: counted in the tasks first."""

    def counts(batches):
        for batch in batches:
            term, n = np.unique(_flat(batch.column("terms"))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], ["term", "df"])

    return found.select("terms").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n + 1 bounds and the values of a list column."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return offsets - offsets[0], lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]


class Queries:
    """A block of queries as vectors over its own terms; small enough for the driver and a task."""

    def __init__(self, rows: pa.Table, total: int, n_docs: int):
        """``rows (item_id, mark, terms, counts, dfs)``."""
        self.item_id = rows.column("item_id").to_pylist()
        self.mark = rows.column("mark").to_pylist()
        bounds, terms = _flat(rows.column("terms").combine_chunks())
        count, df = (_flat(rows.column(c).combine_chunks())[1] for c in ("counts", "dfs"))
        self.total, self.n_docs = total, n_docs
        self.terms, at = np.unique(terms.view(np.uint64), return_inverse=True)
        self.weight = np.zeros(len(self.terms), dtype=np.int64)
        self.weight[at] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()]
        self.root = np.sqrt(self.weight.astype(np.float64))
        self.at, self.factor, self.values = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            value = self.root[at[a:b]] * count[a:b]
            order = np.argsort(-value, kind="stable")
            self.at.append(at[a:b][order])
            self.values.append(value[order])
            self.factor.append(count[a:b][order].astype(np.int64) * self.weight[at[a:b][order]])
        self.norm = np.array([math.sqrt(float(v @ v)) for v in self.values])
        self.least = np.zeros(len(self.item_id), dtype=np.int64)

    def vectors(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the rows of ``batch``, and term number and impact of their postings in this block."""
        bounds, terms = _flat(batch.column("terms"))
        tf = _flat(batch.column("tfs"))[1].astype(np.int64)
        row = words.rows_of(bounds)
        terms = terms.view(np.uint64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        mine = np.flatnonzero((self.terms[at] == terms) & (self.weight[at] > 0))
        at, tf, row = at[mine], tf[mine], row[mine]
        lengths, which = np.unique(batch.column("n").to_numpy(), return_inverse=True)
        m = np.array([25 + 75 * int(n) * self.n_docs // self.total for n in lengths], dtype=np.int64)[which]
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
        return np.searchsorted(row, np.arange(batch.num_rows + 1)), at, impact

    def measured(self, found: DataFrame) -> DataFrame:
        """``(doc_id, norm, at, impact)`` of the documents that hold a term of the block."""

        def rows(batches):
            for batch in batches:
                bounds, at, impact = self.vectors(batch)
                part = self.root[at] * impact
                norm = np.sqrt(np.bincount(words.rows_of(bounds), part * part, batch.num_rows))
                offsets = pa.array(bounds.astype(np.int32))
                out = pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(norm), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(impact))], ["doc_id", "norm", "at", "impact"])
                yield out.filter(pa.array(norm > 0))

        return found.mapInArrow(rows, "doc_id long, norm double, at array<int>, impact array<long>")

    def search(self, vectors: DataFrame) -> DataFrame:
        """``(item_id, mark, doc_id, score)``: the ten best of each task and query."""
        schema = "item_id long, mark long, doc_id long, score long"
        in_order = vectors.sortWithinPartitions(F.desc("norm"))

        def best(batches):
            top = Best(self.least)
            for batch in batches:
                start, (bounds, _) = 0, _flat(batch.column("at"))
                while start < batch.num_rows:
                    stop = int(np.searchsorted(bounds, bounds[start] + BUCKET_POSTINGS, side="right")) - 1
                    stop = min(max(stop, start + 1), start + BUCKET_DOCS, batch.num_rows)
                    self._bucket(batch.slice(start, stop - start), top)
                    start = stop
            yield top.rows(self.item_id, self.mark)

        return in_order.mapInArrow(best, schema)

    def _bucket(self, batch: pa.RecordBatch, top: Best) -> None:
        norm = batch.column("norm").to_numpy()
        live = np.flatnonzero(self.norm * norm.max() * (1 + _SLACK) >= top.least)
        if not len(live):
            return
        bounds, at = _flat(batch.column("at"))
        impact = _flat(batch.column("impact"))[1]
        order = np.argsort(at, kind="stable")
        row, exact = words.rows_of(bounds)[order], impact[order]
        value = self.root[at[order]] * exact
        ends = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        ids = batch.column("doc_id")
        for i in live.tolist():
            terms, values = self.at[i], self.values[i]
            inner, outer = np.zeros(len(norm)), norm * norm
            for t, q in zip(terms[:FOCUS].tolist(), values[:FOCUS].tolist()):
                a, b = ends[t], ends[t + 1]
                inner[row[a:b]] += q * value[a:b]
                outer[row[a:b]] -= value[a:b] ** 2
            rest = values[FOCUS:]
            rest = math.sqrt(float(rest @ rest))
            bound = inner + rest * (np.sqrt(np.maximum(outer, 0)) + _SLACK * norm)
            left = np.flatnonzero(bound * (1 + _SLACK) >= max(top.least[i], 1))
            if not len(left):
                continue
            place = np.full(len(norm), -1)
            place[left] = np.arange(len(left))
            score = np.zeros(len(left), dtype=np.int64)
            for t, f in zip(terms.tolist(), self.factor[i].tolist()):
                a, b = ends[t], ends[t + 1]
                where = place[row[a:b]]
                mine = where >= 0
                score[where[mine]] += f * exact[a:b][mine]
            top.add(i, score, left, ids)


class Best:
    """The best documents of each query so far, and the score that the next one must reach."""

    def __init__(self, least: np.ndarray):
        self.least = least.copy()
        self.kept: list[list[tuple[int, int, int]]] = [[] for _ in least]

    def add(self, i: int, score: np.ndarray, rows: np.ndarray, ids: pa.Array) -> None:
        good = np.flatnonzero(score >= max(self.least[i], 1))
        if len(good) > 4 * BEST:  # more than can stay, unless they tie
            good = good[score[good] >= -np.partition(-score[good], BEST - 1)[BEST - 1]]
        if not len(good):
            return
        named = ids.take(pa.array(rows[good])).to_pylist()
        new = [(-s, d is not None, d or 0) for s, d in zip(score[good].tolist(), named)]
        self.kept[i] = sorted(self.kept[i] + new)[:BEST]
        if len(self.kept[i]) == BEST:
            self.least[i] = max(self.least[i], -self.kept[i][-1][0])

    def rows(self, item_id: list, mark: list) -> pa.RecordBatch:
        found = [(item_id[i], mark[i], d if named else None, -s) for i, rows in enumerate(self.kept) for s, named, d in rows]
        kind = [("item_id", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], type=t) for k, (_, t) in enumerate(kind)],
                                          schema=pa.schema(kind))


def _ranked(found: DataFrame) -> DataFrame:
    best = Window.partitionBy("item_id", "mark").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= BEST)


def _query_terms(items: DataFrame) -> DataFrame:
    """``(item_id, mark, term, count)`` of the distinct queries."""
    one = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def rows(batches):
        for batch, _, (row, term, tf) in _term_counts(batches, None):
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(which), batch.column("mark").take(which), pa.array(term.view(np.int64)),
                 pa.array(tf.astype(np.int64))], ["item_id", "mark", "term", "count"])

    return (one.withColumn("mark", F.xxhash64("text")).mapInArrow(rows, "item_id long, mark long, term long, count long"))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ten best rows of ``docs`` for each query of ``items``."""
    spark = docs.sparkSession
    asked = written(_query_terms(items), "asked")
    pairs, distinct = asked.agg(F.count(F.lit(1)), F.count_distinct("term")).first()
    vocabulary = None
    if distinct <= SHIPPED:
        terms = asked.select("term").distinct().toArrow().column("term").to_numpy()
        vocabulary = np.sort(terms.view(np.uint64))
    found = written(postings(docs, vocabulary), "postings")
    n_docs, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not total or not pairs:
        return none
    weighted = asked.join(_document_frequencies(found), "term")
    n_blocks = -(-pairs // BLOCK_TERMS)
    block = F.pmod(F.xxhash64("item_id", "mark"), F.lit(n_blocks))
    rows = (weighted.groupBy("item_id", "mark").agg(F.collect_list(F.struct("term", "count", "df")).alias("t"))
            .select("item_id", "mark", F.col("t.term").alias("terms"), F.col("t.count").alias("counts"),
                    F.col("t.df").alias("dfs"), block.alias("block")))
    rows = written(rows, "queries")
    out = none
    for b in range(n_blocks):
        mine = rows.filter(F.col("block") == b).toArrow()
        if mine.num_rows:
            out = out.union(_search_block(found, Queries(mine, total, n_docs)))
    return out


def _search_block(found: DataFrame, queries: Queries) -> DataFrame:
    vectors = written(queries.measured(found), "vectors")
    n = vectors.count()
    share = max(0.0, 1 - LONGEST / max(n, 1))
    long = vectors.agg(F.percentile_approx("norm", share, 1000)).scalar()
    first = _ranked(queries.search(vectors.filter(F.col("norm") >= long))).filter(F.col("rank") == BEST)
    least = {(r["item_id"], r["mark"]): r["score"] for r in first.collect()}
    queries.least = np.array([least.get(k, 0) for k in zip(queries.item_id, queries.mark)], dtype=np.int64)
    return _ranked(queries.search(vectors)).select("item_id", "rank", "doc_id", "score")


#: the same scores by a join of all postings
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sizes AS (SELECT r, doc_id, len(t) AS n FROM docs WHERE len(t) > 0),
all_docs AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, all_docs GROUP BY term, n_docs),
asked AS (
  SELECT item_id, text, term, count(*) AS c FROM (
    SELECT item_id, text, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, text, term),
scored AS (
  SELECT item_id, text, s.r, doc_id,
         CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes s ON s.r = tf.r, all_docs
  GROUP BY item_id, text, s.r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
