"""The language model: exact base scores, proper probabilities, and better scores of held-out text."""

import math
from collections import Counter

import numpy as np
import pytest

from aspectra.llm import lm
from helpers import crc_fold, words


def base_scores(docs):
    tokens = {d: [*words(t), None] for d, t in docs}
    count = Counter(w for d, t in tokens.items() if d is not None and not crc_fold(d, 10) for w in t)
    size = math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    return {d: (len(t), sum(count[w] > 0 for w in t), sum(math.log10(count[w] + 0.1) - size for w in t))
            for d, t in tokens.items()}, sum(count.values())


def check_base(got, docs):
    want, total = base_scores(docs)
    for r in got:
        n, known, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9) and r.held_out == (r.doc_id is None or crc_fold(r.doc_id, 10))
        assert math.isfinite(r.score) and r.score <= 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = lm.score(df).collect()
    assert len(got) == len(docs)
    check_base(got, docs)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_WORDS", 8)  # several hash ranges
    text = "the cat sat on the mat and the dog sat on the log"
    docs = [(k, f"{text} w{k}") for k in range(40)] + [
        (100, None), (101, ""), (102, "unseen words only"), (103, "The CAT"), (104, "x " * 30_000), (105, "é ß 日本")]
    df = spark.createDataFrame([(d, t, "m", 1) for d, t in docs], "doc_id long, text string, mark string, score int")
    got = lm.score(df, rounds=3).collect()
    check_base(got, docs)
    again = {r.doc_id: r.score for r in lm.score(df.repartition(3), rounds=3).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-5) for r in got)


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a"), (2, "a")], "doc_id long, text string")
    got = lm.score(df, rounds=2).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 2), (1, 3), (1, 3), (2, 2)]
    assert len({(r.base_score, r.score) for r in got if r.n_tokens == 3}) == 1
    assert lm.score(df.limit(0), rounds=2).collect() == []
    alone = lm.score(df.filter("doc_id is null"), rounds=2).collect()
    assert [(r.train_tokens, r.n_known) for r in alone] == [(0, 0)] and math.isfinite(alone[0].score)


def test_probabilities_add_up_and_gradients_rise():
    rng = np.random.default_rng(0)
    m = lm.Model(np.sort(rng.integers(1, 2 ** 62, 20).astype(np.uint64)), np.arange(1, 21), np.r_[5, np.arange(20, 0, -1), np.zeros(lm.HEAD - 21, int)])
    m.classes = rng.standard_normal((lm.CLASS_ROWS, m.n_classes)).astype(np.float32)
    m.members = rng.standard_normal((lm.MEMBER_ROWS, lm.MEMBERS)).astype(np.float32)
    context = rng.integers(0, (m.symbols + 1) * (m.n_classes + 1), 50)
    assert np.allclose(np.exp(m.class_logs(context)).sum(1), 1, atol=1e-5)
    assert np.allclose(np.exp(m.member_logs(context, context % m.heads)).sum(1), 1, atol=1e-5)
    key = np.unique(rng.integers(0, 30, 400) * 7 * m.symbols + rng.integers(0, 40, 400))
    n = rng.integers(1, 50, len(key))

    def likelihood():
        ctx, symbol = np.divmod(key, m.symbols)
        cls = m.class_of(symbol)
        log = m.class_logs(ctx)[np.arange(len(ctx)), cls]
        log += m.member_logs(ctx, cls % m.heads)[np.arange(len(ctx)), symbol % lm.MEMBERS] * (symbol < lm.HEAD)
        return (log * n).sum()

    seen = [likelihood()]
    for _ in range(4):
        g, h = lm._gradient(m, key, n)
        cut = m.classes.size
        m.classes, m.members = lm._step(m.classes, g[:cut], h[:cut], 4), lm._step(m.members, g[cut:], h[cut:], 3)
        seen.append(likelihood())
    assert seen == sorted(seen)


def test_pair_weights_are_the_maximum_and_normalised():
    rng = np.random.default_rng(1)
    base = rng.dirichlet(np.ones(40))[:30]  # ten words of the class are never seen after any word
    past, word = np.divmod(np.unique(rng.integers(0, 4 * 30, 70)), 30)
    cls, times = np.zeros(len(past), np.uint8), rng.integers(0, 40, len(past)).astype(float)
    w, z = lm.pair_weights(past, cls, times, base[word])
    assert (w[times == 0] == 0).all()
    for k in range(4):
        at = past == k
        full = base.copy()
        full[word[at]] *= np.exp(w[at])
        total = full.sum() + 1 - base.sum()
        assert z[at] == pytest.approx(math.log(total), abs=1e-9)
        slope = times[at] - times[at].sum() * full[word[at]] / total - lm.PRIOR * w[at]
        assert np.abs(slope[times[at] > 0]).max() < 0.2


def test_ranges_add_up_and_their_gradients_rise():
    rng = np.random.default_rng(2)
    m = lm.Model(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(lm.HEAD, int), bits=2 * lm.BITS)
    m.tail_total = rng.integers(0, 50, (lm.TAIL, 64)).astype(float)
    m.digits = rng.standard_normal((lm.DIGIT_ROWS, lm.WAYS)).astype(np.float32)
    m.classes = np.zeros((lm.CLASS_ROWS, m.n_classes), np.float32)
    m.members = np.zeros((lm.MEMBER_ROWS, lm.MEMBERS), np.float32)
    for cls in (0, 7, 63):
        assert np.exp(m.digit_logs(np.full(64, 5), cls * 64 + np.arange(64))).sum() == pytest.approx(1, abs=1e-9)
    case = np.unique(rng.integers(0, lm.TAIL * 64 * 3, 4000))
    leaf, before, n = case // 3, case % 3, rng.integers(1, 50, len(case))
    key = -1 - (leaf * (m.n_classes + 1) + before)
    order = np.argsort(key)
    seen = []
    for _ in range(4):
        seen.append((m.digit_logs(before, leaf) * n).sum())
        g, h = lm._gradient(m, key[order], n[order])
        cut = m.classes.size + m.members.size
        m.digits = lm._step(m.digits, g[cut:], h[cut:], 1)
    assert seen == sorted(seen) and seen[-1] > seen[0] + 1000


@pytest.mark.parametrize("tokens", [1 << 21, 1000])
def test_words_past_the_head_depend_on_the_word_before(spark, monkeypatch, tokens):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", tokens)  # one range of hashes, and several
    rng = np.random.default_rng(3)
    # 1500 rare words with the same ending; each is followed by one other, and frequent words come between
    text = lambda ks, shift: " ".join(f"a{k}xx b{(k + shift) % 1500}xx f{k % 600}" for k in ks)
    docs = [(d, text(rng.integers(0, 1500, 40), 0)) for d in range(600)]
    held = [d for d in range(10_000, 11_000) if crc_fold(d, 10)][:80]
    ks = rng.integers(0, 1500, (40, 40))
    docs += [(d, text(k, 0)) for d, k in zip(held[:40], ks)] + [(d, text(k, 750)) for d, k in zip(held[40:], ks)]
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), rounds=3).collect()
    check_base(got, docs)
    score = {r.doc_id: r.score for r in got}
    pairs = 40 * 40
    assert sum(score[d] for d in held[:40]) > sum(score[d] for d in held[40:]) + 0.7 * pairs
