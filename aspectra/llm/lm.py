"""Operator 1: a hashed maximum-entropy language model, trained by distributed gradient updates.

The next token is predicted in two steps, its class and then itself within the class:

* the ``HEAD`` most frequent tokens (the end of a text among them) fill classes of ``MEMBERS`` by
  falling frequency; both steps are log-linear in features of the context;
* every other word, known or not, is in one of ``TAIL`` classes by its last two bytes.  A class is split
  by the digits of the words' hash into ranges, each digit log-linear in the class of the preceding
  token; within a range the word is log-linear in its frequency there and in a weight of its own for
  each word that precedes it in the training text (``pair_weights``).

Features of the context of the other steps are the preceding token (bigram), the class of the one before
it (skip), and both classes (trigram), each hashed to a row of a weight table; there, a word outside the
head counts as its class.  The context of a token is so one of a bounded number, and the gradient over all
training tokens is the gradient over the counts of (context, token), which are gathered from the whole
training text.  A round sends the weights to tasks that hold a part of the counts, sums their gradients
and curvatures, and takes a step.

Scoring looks the context's class probabilities up once for each distinct context of a batch and adds
the words' terms.  Word frequencies and the weights of pairs are too many to send to every task: each
batch sends the words of its documents outside the head, and what precedes them, by ranges of their hash
to tasks that hold that range of the frequencies.  A range has all occurrences of its words, so the
weights of its pairs, which no other range shares, are found there and stay there.  The number of
ranges grows with the words and tokens; a word sent has at most a share of 1 / HEAD of all tokens.

Tokens: words without white space, A-Z as a-z, by 64-bit hash, and one end per text.

Defined results: a null or empty text is its end alone; rows without ``doc_id`` are held out; rows
that agree in ``doc_id`` and text get equal rows; without training rows every token is unknown, scored
by untrained (uniform) classes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm import words as W
from aspectra.llm.tables import grouped, written

HEAD, MEMBERS, TAIL = 512, 16, 64
#: rows of the class and of the member weight table
CLASS_ROWS, MEMBER_ROWS = 8192, 16384
#: bits and ways of a digit of a range, rows of the digits' weight table
BITS = 3
WAYS, DIGIT_ROWS = 1 << BITS, 16384
#: weights whose gradients are summed in one row
BLOCK = 1 << 15
ROUNDS, PARTS, PRIOR = 8, 8, 2.0
#: distinct words and training tokens of a hash range; distinct keys a task holds before it hands them on
BUCKET_WORDS, BUCKET_TOKENS, HELD = 1 << 18, 1 << 21, 1_000_000
#: text worked on at once, and text whose words are sent together
CHUNK, SENT = 2 << 20, 8 << 20
#: steps for the weights of a range's pairs, or until none changes by more
PAIR_ROUNDS, PAIR_CHANGE = 30, 1e-3
_UNIFORM = 1e-4


@dataclass
class Model:
    """``head``: word hash to rank, as sorted hashes and ranks from 1 (0 is the end)."""
    head: np.ndarray
    rank: np.ndarray
    count: np.ndarray  # of each head rank, the end's first
    total: int = 0
    distinct: int = 0
    #: bits of a range; tokens and words outside the head of each class and range
    bits: int = 0
    tail_total: np.ndarray = field(default_factory=lambda: np.zeros((TAIL, 1)))
    tail_distinct: np.ndarray = field(default_factory=lambda: np.zeros((TAIL, 1)))
    classes: np.ndarray | None = None
    members: np.ndarray | None = None
    digits: np.ndarray = field(default_factory=lambda: np.zeros((0, WAYS), np.float32))  # of ranges, if there are several

    heads = HEAD // MEMBERS
    n_classes = HEAD // MEMBERS + TAIL
    symbols = HEAD + TAIL  # one more stands for what comes before the first token

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < HEAD, symbol // MEMBERS, symbol - HEAD + self.heads)

    def symbols_of(self, data: np.ndarray, offsets: np.ndarray):
        """Symbols of the tokens of each row (an end after each), their word hash (0: end), the bounds."""
        h, start, end = W.word_spans(data, offsets)
        bounds = np.searchsorted(start, offsets)
        symbol = HEAD + tail_class(data, start, end)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            symbol = np.where(self.head[at] == h, self.rank[at], symbol)
        return (np.insert(symbol, bounds[1:], 0), np.insert(h, bounds[1:], np.uint64(0)),
                bounds + np.arange(len(bounds)))

    def contexts(self, symbol: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The context of each token: the symbol before it and the class of the one before that."""
        one = np.empty_like(symbol)
        one[1:] = symbol[:-1]
        one[bounds[:-1]] = self.symbols
        two = np.empty_like(symbol)
        two[1:] = self.class_of(one)[:-1]
        first = np.zeros(len(symbol), bool)
        first[bounds[:-1]] = True
        two[first | np.r_[False, first[:-1]]] = self.n_classes
        return one * (self.n_classes + 1) + two

    def split(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two = np.divmod(context, self.n_classes + 1)
        c1 = np.where(one == self.symbols, self.n_classes, self.class_of(one))
        return one, two, c1

    def class_features(self, context: np.ndarray) -> np.ndarray:
        one, two, c1 = self.split(context)
        return _hashed(one * 0, 1, [one, two, c1 * 1000 + two], CLASS_ROWS)

    def member_features(self, context: np.ndarray, cls: np.ndarray) -> np.ndarray:
        one, two, _ = self.split(context)
        return _hashed(cls, self.heads, [cls * 4096 + one, cls * 4096 + two], MEMBER_ROWS)

    def class_logs(self, context: np.ndarray) -> np.ndarray:
        """Natural log probability of every class in each context."""
        return np.log(_UNIFORM / self.n_classes + (1 - _UNIFORM) * softmax(self.classes[self.class_features(context)].sum(1)))

    def member_logs(self, context: np.ndarray, cls: np.ndarray) -> np.ndarray:
        p = softmax(self.members[self.member_features(context, cls)].sum(1))
        return np.log(_UNIFORM / MEMBERS + (1 - _UNIFORM) * p)

    def before(self, context: np.ndarray) -> np.ndarray:
        """The class of the token before."""
        return self.split(context)[2]

    def leaves(self, symbol: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of the class and range of words outside the head."""
        return ((symbol - HEAD) << self.bits) + _bucket(h, self.bits)

    def digit_steps(self, leaf: np.ndarray):
        """Of each digit, from the first: its level, the nodes it is chosen at, and the choices."""
        for level in range(self.bits // BITS):
            upto = leaf >> (self.bits - BITS * (level + 1))
            yield level, upto >> BITS, upto & (WAYS - 1)

    def digit_bias(self, level: int, node: np.ndarray) -> np.ndarray:
        """Logarithms of the frequencies of the choices at nodes; these are not trained."""
        n = self.tail_total.reshape(TAIL << (BITS * level), WAYS, -1).sum(axis=2)
        return np.log(n + 0.5)[node]

    def digit_features(self, level: int, node: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = (node * (self.n_classes + 1) + before) * 16 + level
        return _hashed(at, 0, [at], DIGIT_ROWS)[:, 1:]

    def digit_logs(self, before: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log probability of a class's ranges after a class."""
        log = np.zeros(len(leaf))
        for level, node, digit in self.digit_steps(leaf):
            p = softmax(self.digit_bias(level, node) + self.digits[self.digit_features(level, node, before)].sum(1))
            log += np.log(_UNIFORM / WAYS + (1 - _UNIFORM) * p[np.arange(len(leaf)), digit])
        return log


def tail_class(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    last = W.LOWER[data[end - 1]].astype(np.uint64)
    before = np.where(end - start > 1, W.LOWER[data[np.maximum(end - 2, 0)]], 0).astype(np.uint64)
    return (W.mix(last * np.uint64(256) + before) % np.uint64(TAIL)).astype(np.int64)


def _hashed(bias: np.ndarray, biases: int, features: list[np.ndarray], rows: int) -> np.ndarray:
    """Table rows of each context, one column each: its bias, and its hashed features past the biases."""
    salt = W.constants(len(features), 31)
    return np.stack([bias, *[biases + (W.mix(f.astype(np.uint64) * s + s) % np.uint64(rows - biases)).astype(np.int64)
                             for f, s in zip(features, salt)]], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Held:
    """Summed counts by key (with a value that depends on the key alone), handed on when there are many."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, *columns: np.ndarray) -> None:
        """Keys, counts, values."""
        self.parts.append(columns)
        self.n += len(columns[0])

    def full(self) -> bool:
        """Whether many distinct keys are held."""
        if self.n > HELD:
            self.add(*self.take())
        return self.n > HELD // 2

    def take(self) -> list[np.ndarray]:
        if not self.parts:
            return []
        keys, counts, values = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.parts, self.n = [], 0
        return [keys[head], np.add.reduceat(counts[order], head), values[order][head]] if len(keys) else []


def word_counts(docs: DataFrame) -> DataFrame:
    """``(h, cls, n)`` of every word of ``docs``; the row with a null ``h`` counts the texts."""
    def run(batches):
        held, texts = _Held(), 0

        def out():
            for k, n, cls in filter(None, [held.take()]):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(cls), pa.array(n)], ["h", "cls", "n"])

        for batch, data, offsets in W.chunks(batches, max_bytes=CHUNK):
            texts += batch.num_rows
            h, start, end = W.word_spans(data, offsets)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.add(u, n, tail_class(data, start[first], end[first]).astype(np.int32))
            if held.n > HELD:
                yield from out()
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()),
                                          pa.array([texts], pa.int64())], ["h", "cls", "n"])

    return docs.select("text").mapInArrow(run, "h long, cls int, n long").groupBy("h").agg(
        F.max("cls").alias("cls"), F.sum("n").alias("n"))


def start_model(counts: DataFrame) -> Model:
    """The model's classes and frequencies; the weights are zero."""
    texts = counts.filter("h is null").agg(F.sum("n")).first()[0] or 0
    words = counts.filter("h is not null")
    top = words.orderBy(F.desc("n"), "h").limit(HEAD - 1).collect()
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    count = np.zeros(HEAD, np.int64)
    count[0] = texts
    count[1:len(top) + 1] = [r.n for r in top]
    order = np.argsort(h)
    m = Model(h[order], order + 1, count)
    size = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    m.total = (size[0] or 0) + texts
    m.distinct = size[1] + (texts > 0)
    ranges = max(m.distinct / BUCKET_WORDS, (m.total - count.sum()) / BUCKET_TOKENS, 1)
    m.bits = BITS * math.ceil(math.log2(ranges) / BITS)
    m.tail_total, m.tail_distinct = np.zeros((2, TAIL, 1 << m.bits))
    at = range_of(m.bits)
    for r in words.groupBy("cls", at.alias("at")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        m.tail_total[r.cls, r.at] += r.n
        m.tail_distinct[r.cls, r.at] += r.v
    for r, k in zip(top, _bucket(h, m.bits)):
        m.tail_total[r.cls, k] -= r.n
        m.tail_distinct[r.cls, k] -= 1
    # the biases start at the frequencies, the other weights at zero
    m.classes = np.zeros((CLASS_ROWS, m.n_classes), np.float32)
    m.members = np.zeros((MEMBER_ROWS, MEMBERS), np.float32)
    heads = m.count.reshape(m.heads, MEMBERS)
    m.classes[0] = np.log(np.r_[heads.sum(axis=1), m.tail_total.sum(axis=1)] + 0.5)
    m.members[:m.heads] = np.log(heads + 0.01)
    m.digits = np.zeros((DIGIT_ROWS if m.bits else 0, WAYS), np.float32)
    return m


def event_counts(docs: DataFrame, held_model) -> DataFrame:
    """``(part, key, n)``: how often each token symbol follows each context, in PARTS parts.

    Keys below zero: how often a range of a class follows a class.
    """
    def run(batches):
        m, held = held_model.value, _Held()

        def out():
            for k, n, _ in filter(None, [held.take()]):
                yield pa.RecordBatch.from_arrays([pa.array(k // m.symbols % PARTS), pa.array(k), pa.array(n)],
                                                 ["part", "key", "n"])

        for _, data, offsets in W.chunks(batches, max_bytes=CHUNK):
            symbol, h, bounds = m.symbols_of(data, offsets)
            context = m.contexts(symbol, bounds)
            k, n = np.unique(context * m.symbols + symbol, return_counts=True)
            held.add(k, n, n)
            if m.bits:
                tail = symbol >= HEAD
                k, n = np.unique(-1 - m.leaves(symbol[tail], h[tail]) * (m.n_classes + 1) - m.before(context[tail]),
                                 return_counts=True)
                held.add(k, n, n)
            if held.full():
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "part long, key long, n long").groupBy("part", "key").agg(
        F.sum("n").alias("n"))


def _packed(events: DataFrame) -> DataFrame:
    """One row for each part: its keys and counts as bytes.  Keys are bounded by contexts x symbols."""
    def run(batches):
        part, keys, counts = None, [], []

        def row():
            return pa.RecordBatch.from_pydict({"part": pa.array([part]), "keys": pa.array(
                [np.concatenate(keys).tobytes()]), "counts": pa.array([np.concatenate(counts).tobytes()])})

        for batch in batches:
            p = batch.column("part").to_numpy()
            cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else []
            for a, b in zip(cuts, [*cuts[1:], len(p)]):
                if part is not None and p[a] != part:
                    yield row()
                    keys, counts = [], []
                part = int(p[a])
                keys.append(batch.column("key").to_numpy()[a:b])
                counts.append(batch.column("n").to_numpy()[a:b])
        if part is not None:
            yield row()

    return events.repartition("part").sortWithinPartitions("part", "key").mapInArrow(
        run, "part long, keys binary, counts binary")


def _gradient(m: Model, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gradient and curvature of all weights, the tables one after the other, over some counts."""
    g1, h1 = np.zeros((2, *m.classes.shape))
    g2, h2 = np.zeros((2, *m.members.shape))
    g3, h3 = np.zeros((2, *m.digits.shape))
    cut = np.searchsorted(key, 0)  # keys rise, so that the reversed ones below zero do
    leaf, before = np.divmod(-1 - key[:cut][::-1], m.n_classes + 1)
    w = n[:cut][::-1].astype(float)
    for level, node, digit in m.digit_steps(leaf):
        order = np.lexsort((before, node))
        node, past, case = node[order], before[order], (node * (m.n_classes + 1) + before)[order]
        first = np.flatnonzero(np.r_[True, case[1:] != case[:-1]]) if len(case) else case
        bias = m.digit_bias(level, node[first])
        _ascend(g3, h3, case, digit[order], w[order], lambda _: m.digit_features(level, node[first], past[first]),  # noqa: B023
                m.digits, bias)
    key, n = key[cut:], n[cut:]
    for a in range(0, len(key), 1 << 18):
        context, symbol = np.divmod(key[a:a + (1 << 18)], m.symbols)
        w = n[a:a + (1 << 18)].astype(float)
        cls = m.class_of(symbol)
        _ascend(g1, h1, context, cls, w, m.class_features, m.classes)
        inner = np.flatnonzero(symbol < HEAD)
        pair = context[inner] * m.heads + cls[inner]
        _ascend(g2, h2, pair, symbol[inner] % MEMBERS, w[inner],
                lambda p: m.member_features(p // m.heads, p % m.heads), m.members)
    return np.array([np.r_[g1.ravel(), g2.ravel(), g3.ravel()], np.r_[h1.ravel(), h2.ravel(), h3.ravel()]], np.float32)


def _ascend(g, h, case, outcome, weight, features, table, bias=0.0) -> None:
    """Add the gradient of the log-likelihood of the outcomes of each case (rising), and its curvature."""
    if not len(case):
        return
    first = np.r_[True, case[1:] != case[:-1]]
    rows = features(case[first])
    p = softmax(table[rows].sum(1).astype(float) + bias)
    width = p.shape[1]
    seen = np.bincount((np.cumsum(first) - 1) * width + outcome, weights=weight, minlength=p.size).reshape(p.shape)
    total = seen.sum(axis=1, keepdims=True)
    up, bend = seen - total * p, total * p * (1 - p)
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        row = rows[order, k]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        g[row[starts]] += np.add.reduceat(up[order], starts, axis=0)
        h[row[starts]] += np.add.reduceat(bend[order], starts, axis=0)


def _summed(batches):
    """Sums of the arrays of each block, from rows sorted by block."""
    block, total = None, None
    for batch in batches:
        for k, b in enumerate(batch.column("block").to_pylist()):
            x = np.frombuffer(batch.column("value")[k].as_buffer(), np.float32).astype(float)
            if b == block:
                total += x
                continue
            if block is not None:
                yield _block_row(block, total)
            block, total = b, x
    if block is not None:
        yield _block_row(block, total)


def _block_row(block: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array(
        [values.astype(np.float32).tobytes()], pa.binary())], ["block", "value"])


def train(events: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Rounds of gradients, each summed over all parts before the driver reads it: one model's size."""
    spark = events.sparkSession
    packed = written(_packed(events), "events").coalesce(PARTS)
    size = model.classes.size + model.members.size + model.digits.size

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def run(batches, held=held):
            total = None
            for batch in batches:
                for k in range(batch.num_rows):
                    key = np.frombuffer(batch.column("keys")[k].as_buffer(), np.int64)
                    n = np.frombuffer(batch.column("counts")[k].as_buffer(), np.int64)
                    x = _gradient(held.value, key, n)
                    total = x if total is None else total + x
            for b in range(0, 0 if total is None else size, BLOCK):
                yield _block_row(b // BLOCK, total[:, b:b + BLOCK])

        parts = packed.mapInArrow(run, "block int, value binary")
        sums = (parts.repartition("block").sortWithinPartitions("block")
                .mapInArrow(_summed, "block int, value binary").collect())
        held.destroy()
        if not sums:
            break
        g, h = np.concatenate([np.frombuffer(r.value, np.float32).reshape(2, -1)
                               for r in sorted(sums, key=lambda r: r.block)], axis=1)
        cut = model.classes.size
        end = cut + model.members.size
        # a step along the gradient, scaled by its curvature and by the features that act together
        model.classes = _step(model.classes, g[:cut], h[:cut], 4)
        model.members = _step(model.members, g[cut:end], h[cut:end], 3)
        model.digits = _step(model.digits, g[end:], h[end:], 1)
    return model


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, together: int) -> np.ndarray:
    """The weights after a step, with a Gaussian prior (PRIOR is its precision)."""
    g, h = g.reshape(w.shape) - PRIOR * w, h.reshape(w.shape)
    return (w + np.clip(g / (h + PRIOR) / together, -1.0, 1.0)).astype(np.float32)


def _local_scores(docs: DataFrame, held_model) -> DataFrame:
    """Per row what needs no word frequencies beyond the head's: counts and sums of log10 terms.

    ``words``: the terms of the base score; ``score``: those of the model; ``tail``: the number of words
    outside the head.  Their own frequencies and weights are still missing from both sums.
    """
    def run(batches):
        m = held_model.value
        log_head = np.log10(m.count + 0.1)
        log_tail = np.log10(m.tail_total + 0.1 * (m.tail_distinct + 1))
        seen = np.full((m.symbols + 1) * (m.n_classes + 1), -1, np.int32)
        table = np.zeros((0, m.n_classes), np.float32)
        for batch, data, offsets in W.chunks(batches, max_bytes=CHUNK):
            symbol, h, bounds = m.symbols_of(data, offsets)
            context = m.contexts(symbol, bounds)
            new = np.unique(context[seen[context] < 0])
            seen[new] = len(table) + np.arange(len(new))
            table = np.concatenate([table, m.class_logs(new).astype(np.float32)])
            cls = m.class_of(symbol)
            log = table[seen[context], cls].astype(float) / math.log(10)
            head = symbol < HEAD
            at = np.flatnonzero(head)
            pair, where = np.unique(context[at] * m.heads + cls[at], return_inverse=True)
            inner = m.member_logs(pair // m.heads, pair % m.heads)
            log[at] += inner[where, symbol[at] % MEMBERS] / math.log(10)
            out = np.flatnonzero(~head)
            leaf = m.leaves(symbol[out], h[out])
            log[out] -= log_tail.ravel()[leaf]
            if m.bits:
                pair, where = np.unique(leaf * (m.n_classes + 1) + m.before(context[out]), return_inverse=True)
                leaf, before = np.divmod(pair, m.n_classes + 1)
                log[out] += m.digit_logs(before, leaf)[where] / math.log(10)
            base = np.zeros(len(symbol))
            base[at] = log_head[symbol[at]]
            row = W.rows_of(bounds)
            per = lambda x: np.bincount(row, weights=x, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(bounds)),
                 pa.array(per(head & (m.count[np.where(head, symbol, 0)] > 0)).astype(np.int64)), pa.array(per(base)),
                 pa.array(per(log)), pa.array(np.ones(batch.num_rows, np.int64))], _SCORED)

    return docs.mapInArrow(run, _SCORED_TYPES)


_SCORED = ["doc_id", "mark", "n_tokens", "n_known", "base", "score", "copies"]
_SCORED_TYPES = "doc_id long, mark long, n_tokens long, n_known long, base double, score double, copies long"


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)


def range_of(bits: int):
    """The same of a column ``h``."""
    return (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("int")


def _tail_words(docs: DataFrame, held_model) -> DataFrame:
    """``(bucket, batch, words)``: for each batch and range of hashes the words outside the head, as bytes.

    A row holds the numbers of words, of tokens and of documents; the words' hashes, tokens and classes; of
    each token the one before it, by 32 bits of its hash, and the document's place in the batch; of each
    document whether it is trained on.  One more row of a batch, of no words, holds the documents' ids, marks
    and whether the id is missing.
    """
    def run(batches):
        m = held_model.value
        name = TaskContext.get().partitionId() << 32
        for batch, data, offsets in W.chunks(batches, max_bytes=SENT):
            symbol, h, bounds = m.symbols_of(data, offsets)
            past = np.empty(len(h), np.uint32)
            past[1:] = h[:-1] >> np.uint64(32)
            past[bounds[:-1]] = 1
            out = np.flatnonzero(symbol >= HEAD)
            row, h, past, cls = W.rows_of(bounds)[out], h[out], past[out], (symbol[out] - HEAD).astype(np.uint8)
            order = np.argsort(h, kind="stable")
            h, row, past, cls = h[order], row[order], past[order], cls[order]
            row = row.astype(_place(batch.num_rows))
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else order
            times = np.diff(np.append(first, len(h))).astype(np.int32)
            learn = np.packbits(batch.column("learn").to_numpy(zero_copy_only=False))
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            buckets = [name % (1 << m.bits)]
            words = [_bytes(np.array([0, 0, len(ids)]), ids, batch.column("mark").to_numpy(), none.astype(np.uint8))]
            cuts = np.searchsorted(_bucket(h[first], m.bits), np.arange((1 << m.bits) + 1))
            ends = np.append(first, len(h))[cuts]
            for k in np.flatnonzero(np.diff(cuts)):
                x, y = slice(cuts[k], cuts[k + 1]), slice(ends[k], ends[k + 1])
                buckets.append(k)
                words.append(_bytes(np.array([x.stop - x.start, y.stop - y.start, len(ids)]), h[first[x]], times[x],
                                    cls[first[x]], past[y], row[y], learn))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(buckets, np.int32)), pa.array(
                np.full(len(buckets), name)), pa.array(words, pa.binary())], ["bucket", "batch", "words"])
            name += 1

    return docs.mapInArrow(run, "bucket int, batch long, words binary")


def _place(docs: int):
    return np.uint16 if docs <= 1 << 16 else np.int32


def _bytes(*arrays: np.ndarray) -> bytes:
    return b"".join(x.tobytes() for x in arrays)


def _arrays(raw, *kinds) -> list[np.ndarray]:
    """Arrays of the given (length, type), one after another past the first three numbers."""
    at, out = 24, []
    for n, kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _tail_scores(counts: DataFrame, tails: DataFrame, held_model) -> DataFrame:
    """The terms that frequencies and pairs add to each row, by range of hashes and summed by batch."""
    bits = held_model.value.bits

    def look_up(batches):
        bucket, keys, freq, names, sent = None, [], [], [], []

        def done():
            if names:
                sums = _looked_up(sent, np.concatenate(keys), np.concatenate(freq), held_model.value, bucket)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums, pa.binary())], ["batch", "sums"])

        for batch in batches:
            t = batch.column("bucket").to_numpy()
            h = batch.column("h").fill_null(0).to_numpy().view(np.uint64)
            n = batch.column("n").fill_null(0).to_numpy()
            is_word = batch.column("words").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else []
            for a, b in zip(cuts, [*cuts[1:], len(t)]):
                if t[a] != bucket:
                    yield from done()
                    bucket, keys, freq, names, sent = t[a], [], [], [], []
                some = a + np.flatnonzero(is_word[a:b])
                keys.append(h[some])
                freq.append(n[some])
                for k in a + np.flatnonzero(~is_word[a:b]):
                    names.append(batch.column("batch")[k].as_py())
                    sent.append(batch.column("words")[k].as_buffer())
        yield from done()

    # of a range first the frequencies (no words), then the batches
    both = counts.filter("h is not null").select(
        range_of(bits).alias("bucket"), "h", "n", F.lit(None).cast("long").alias("batch"),
        F.lit(None).cast("binary").alias("words")).unionByName(
            tails.select("bucket", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("n"), "batch", "words"))
    both = both.withColumn("last", F.col("words").isNotNull())
    sums = grouped(both, ["bucket"], look_up, "batch long, sums binary", ["last"])
    return grouped(sums, ["batch"], _batch_sums, _SCORED_TYPES)


def pair_weights(past: np.ndarray, cls: np.ndarray, times: np.ndarray, base: np.ndarray):
    """The maximum-entropy weights of pairs (sorted by ``past``, then ``cls``) and each pair's log normaliser.

    ``base`` is the word's frequency among the words of its class and range, ``times`` how often it follows
    ``past`` in training.  After ``past`` its probability there is ``base * exp(weight) / z``; pairs never
    seen have the weight 0, so that z is one plus what the seen pairs add, and is known from them alone.
    """
    first = np.flatnonzero(np.r_[True, (past[1:] != past[:-1]) | (cls[1:] != cls[:-1])])
    group = np.cumsum(np.bincount(first, minlength=len(past))) - 1
    n = np.add.reduceat(times, first)[group]
    seen = times > 0
    w = np.where(seen, np.log((times + PRIOR) / (n * base + PRIOR)), 0.0)

    def log_z():
        return np.log1p(np.maximum(np.add.reduceat(base * np.expm1(w), first), -1 + 1e-12))[group]

    z = log_z()
    # both steps raise one concave function: each weight's Newton step for a given z, then z for the weights
    for _ in range(PAIR_ROUNDS):
        share = n * base * np.exp(w - z)
        step = np.clip((times - share - PRIOR * w) / (share + PRIOR), -1.0, 1.0) * seen
        w += step
        z = log_z()
        if np.abs(step).max(initial=0) < PAIR_CHANGE:
            break
    return w, z


def _looked_up(sent: list, keys: np.ndarray, freq: np.ndarray, m: Model, bucket: int) -> list[bytes]:
    """Per document of each batch sent the sums over its words of one range."""
    sizes = [np.frombuffer(raw, np.int64, 3).tolist() for raw in sent]
    parts = [_arrays(raw, (v, np.uint64), (v, np.int32), (v, np.uint8), (n, np.uint32), (n, _place(d)), (-(-d // 8), np.uint8))
             for raw, (v, n, d) in zip(sent, sizes) if v]
    if not parts:
        return [bytes(raw) for raw in sent]
    # the range's words by class
    h, at, word = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    cls = np.concatenate([p[2] for p in parts])[at]
    order = np.argsort(cls, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    h, cls, word = h[order], cls[order], place[word]
    order = np.argsort(keys)
    keys, freq = np.append(keys[order], np.uint64(0)), np.append(freq[order], 0)
    found = np.searchsorted(keys[:-1], h)
    c = np.where(keys[found] == h, freq[found], 0)
    base = (c + 0.1) / (m.tail_total[cls, bucket] + 0.1 * (m.tail_distinct[cls, bucket] + 1))
    # pairs by the word before, then class
    word = np.repeat(word, np.concatenate([p[1] for p in parts]))
    pair = np.concatenate([p[3] for p in parts]).astype(np.uint64)
    pair <<= np.uint64(32)
    pair |= word
    pair, where = np.unique(pair, return_inverse=True)
    where = where.astype(np.uint32)
    times = np.bincount(where, weights=np.concatenate([np.unpackbits(p[5])[p[4]] for p in parts]))
    of = pair.astype(np.uint32)  # the lower half
    w, z = pair_weights(pair >> np.uint64(32), cls[of], times, base[of])
    gain, log, known = (w - z) / math.log(10), np.log10(c + 0.1), c > 0
    out, a, some = [], 0, iter(parts)
    for raw, (v, n, d) in zip(sent, sizes):
        if not v:
            out.append(bytes(raw))
            continue
        row = next(some)[4]
        here = np.flatnonzero(np.bincount(row, minlength=d))
        x, y = word[a:a + n], where[a:a + n]
        sums = [np.bincount(row, weights=t, minlength=d)[here] for t in (log[x], log[x] + gain[y], known[x])]
        out.append(_bytes(np.array([1, len(here), d]), here.astype(np.int32), sums[0], sums[1], sums[2].astype(np.int32)))
        a += n
    return out


def _batch_sums(batches):
    """Of each batch one row per document, summed over the ranges; the ranges come one after another."""
    name, docs, sums = None, None, None

    def rows():
        ids, marks, none = docs
        zero = np.zeros(len(ids), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=none.astype(bool)), pa.array(marks), pa.array(zero), pa.array(sums[2].astype(np.int64)),
             pa.array(sums[0]), pa.array(sums[1]), pa.array(zero)], _SCORED)

    for batch in batches:
        for k, b in enumerate(batch.column("batch").to_pylist()):
            raw = batch.column("sums")[k].as_buffer()
            words, n, size = np.frombuffer(raw, np.int64, 3).tolist()
            if b != name:
                if name is not None:
                    yield rows()
                name, sums = b, np.zeros((3, size))
            if not words:
                docs = _arrays(raw, (size, np.int64), (size, np.int64), (size, np.uint8))
                continue
            place, *terms = _arrays(raw, (n, np.int32), (n, np.float64), (n, np.float64), (n, np.int32))
            for total, x in zip(sums, terms):
                total[place] += x
    if name is not None:
        yield rows()


def held_out(doc_id="doc_id", folds: int = 10):
    """Whether the crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every row of ``docs (doc_id, text)`` scored by the model of those that are not held out.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    docs = docs.withColumn("learn", ~held_out())
    training = docs.filter("learn")
    counts = written(word_counts(training), "words")
    model = start_model(counts)
    held = spark.sparkContext.broadcast(model)
    model = train(event_counts(training, held), model, rounds)
    held = spark.sparkContext.broadcast(model)
    parts = _local_scores(docs, held).unionByName(_tail_scores(counts, _tail_words(docs, held), held))
    rows = parts.groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in _SCORED[2:]])
    # equal rows were summed up: as many rows again
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = lambda c: F.expr(f"{c} div copies")
    size = math.log10(model.total + 0.1 * (model.distinct + 1)) if model.total else math.log10(0.1)
    return rows.select("doc_id", held_out().alias("held_out"), each("n_tokens").alias("n_tokens"),
                       each("n_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
                       (F.col("base") / F.col("copies") - each("n_tokens") * F.lit(size)).alias("base_score"),
                       (F.col("score") / F.col("copies")).alias("score"))
