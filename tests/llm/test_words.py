"""Word hashes over Arrow buffers against ``bytes.split``."""

import numpy as np
import pyarrow as pa

from aspectra.llm import words as W

TEXTS = ["The cat\tsat\n\non the  CAT", "", None, "x" * 300 + " " + "x" * 301, "  ", "é É\x0bž\x0c日本 the", "a", "end"]


def hashed(texts, column=None):
    out = []
    for _, data, offsets in W.chunks([pa.RecordBatch.from_pydict({"text": column or pa.array(texts)})], max_bytes=64):
        h, bounds = W.word_hashes(data, offsets)
        out += [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_words_are_those_of_ascii_split():
    got = hashed(TEXTS)
    want = [(t or "").encode().lower().split() for t in TEXTS]
    assert [len(g) for g in got] == [len(w) for w in want]
    name = {}
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert name.setdefault(b, a) == a
    assert len(set(name.values())) == len(name)


def test_rows_touch_without_a_gap_and_slices_keep_their_rows():
    assert [len(x) for x in hashed(["ab", "cd"])] == [1, 1]
    sliced = pa.array(["skip me", *TEXTS]).slice(1)
    assert hashed(None, sliced) == hashed(TEXTS)
    assert hashed(None, pa.array(TEXTS, pa.large_string())) == hashed(TEXTS)


def test_long_text_is_cut_between_words(monkeypatch):
    text = " ".join(f"word{i % 97}" * (i % 5 + 1) for i in range(5000))
    whole = hashed([text, "tail one"])
    monkeypatch.setattr(W, "PIECE", 1000)
    assert hashed([text, "tail one"]) == whole


def test_far_bytes_of_long_words_count():
    a, b = "y" * 500, "y" * 499 + "z"
    assert len({x for row in hashed([a, b, a + "y"]) for x in row}) == 3


def test_random_texts_of_distinct_words_do_not_collide():
    rng = np.random.default_rng(1)
    words = sorted({bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)).decode() for _ in range(20000)})
    assert len({h for row in hashed([" ".join(words)]) for h in row}) == len(words)
