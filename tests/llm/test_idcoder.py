"""Ids in coded blocks: exact round trips, checksums, and the ids of the tokenizer."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from aspectra.llm import idcoder
from aspectra.llm.queries import vocabulary
from aspectra.llm.tables import arrow_batches

TEXTS = ["The cat's hat, isn't it?! 3.14 <|endoftext|> end", "a<|startoftext|>b <| c", None, "", "  \n\t ",
         "Ünïcode İstanbul naïve—“q” é 日本語 ΑΣ ǅ", "THE THE the", "x" * 3000, "don'T !!..a 12ab|c", "word " * 20_000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def want_rows(tokenizer, rows):
    at, out = 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, idcoder.END_ID]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_cases(spark, tokenizer):
    rows = [(7 * k % 10 + 1, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, part string")
    got = sorted(map(tuple, idcoder.encode(df, vocabulary()).collect()))
    assert got == want_rows(tokenizer, sorted(rows, key=lambda r: r[0]))


def test_small_segments_and_blocks(spark, tokenizer, monkeypatch):
    rows = [(k, TEXTS[k % 9] or "again and again and again") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, idcoder.encode(df, vocabulary()).collect())) == want_rows(tokenizer, rows)


def test_repeated_and_missing_ids(spark, tokenizer):
    df = spark.createDataFrame([(None, "a"), (2, "b b"), (2, "b b"), (1, "c"), (2, "d")], "doc_id long, text string")
    got = idcoder.encode(df, vocabulary()).collect()
    assert sorted(r.start for r in got) == np.cumsum([0] + [n for _, n in sorted((r.start, r.n_tokens) for r in got)])[:-1].tolist()
    assert min(got, key=lambda r: r.start).doc_id is None and len(got) == 5
    assert idcoder.encode(df.limit(0), vocabulary()).collect() == []


def test_whole_small_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, idcoder.encode(docs, vocabulary()).collect())) == want_rows(tokenizer, rows)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 3), (2048, 50), (2049, 50_000), (30_000, 400), (9_000, 200_000)])
def test_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32)
    if n > 5000:
        ids[1000:1500] = ids[:500]
        ids[3000:4000] = 17
    lengths = np.array([n // 3, 0, n - n // 3], np.int64)
    docs, out_lengths, out = idcoder.unpack(idcoder.pack([3, None, -5], lengths, ids))
    assert docs == [3, None, -5] and (out_lengths == lengths).all() and (out == ids).all()


def test_repetition_is_predicted():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 40_000, 64).astype(np.uint32)
    rest = rng.integers(0, 40_000, 8192).astype(np.uint32)
    n = np.array([8192])
    repeated, random = (len(idcoder.pack([1], n, x)) for x in (np.tile(phrase, 128), rest))
    assert repeated * 10 < random < 8192 * 2.2 + 4 * 8192 + 1000  # 16 bits an id, the list of ids, the header


def test_blocks_are_independent_and_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 500, 10_000).astype(np.uint32)
    raw = bytearray(idcoder.pack([1], np.array([10_000]), ids))
    for at in (30, len(raw) // 2, len(raw) - 3):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.unpack(bytes(bad))
    # the same ids in a block give the same bytes wherever the block stands
    block = ids[:2048]
    twice = idcoder.encode_blocks(np.r_[block, block], np.array([2048, 2048]), _freq(500), 500)
    assert (twice[0] == twice[1]).all()
    assert (idcoder.decode_blocks(twice[1:], np.array([2048]), _freq(500), 500) == block).all()


def _freq(n_ranks):
    n = len(idcoder._buckets(n_ranks)[1])
    freq = np.full(n, (1 << 14) // n)
    freq[0] += (1 << 14) - freq.sum()
    return freq


@pytest.mark.parametrize("change", ["no lower case", "another splitting", "byte level"])
def test_other_vocabularies_go_through_the_library(spark, tmp_path, change):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    settings = json.load(open(vocabulary()))
    if change == "no lower case":
        settings["normalizer"]["normalizers"].pop()
    elif change == "another splitting":
        settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S"
    else:
        settings = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    rows = [(k, t) for k, t in enumerate([*TEXTS, "The Cat SAT"])]
    got = sorted(map(tuple, idcoder.encode(spark.createDataFrame(rows, "doc_id long, text string"), str(path)).collect()))
    assert got == want_rows(Tokenizer.from_file(str(path)), rows)
    assert not idcoder.Ids(str(path)).by_word and idcoder.Ids(vocabulary()).by_word


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_words_in_pieces_are_encoded_as_the_library_does(tokenizer, monkeypatch, most):
    monkeypatch.setattr(idcoder, "CACHE_WORDS", most)
    monkeypatch.setattr(idcoder, "CACHE_PIECES", most)
    rng = np.random.default_rng(5)
    parts = ["Été", "naÏve", "strasse", "ß", "ÿÀ", "a×b", "2÷3", "Ā", "é", "x", "END", "...", "!?", ";:", "|", "<", "'", " ", "3", "日"]
    texts = ["".join(parts[i] + (" " if rng.random() < 0.3 else "") for i in rng.integers(0, len(parts), 12)) for _ in range(120)]
    coder = idcoder.Ids(vocabulary())
    calls = []
    tokenize = coder.tokenize
    coder.tokenize = lambda s: calls.append(s) or tokenize(s)
    for k in range(0, len(texts), 30):
        raw = [t.encode() for t in texts[k:k + 30]]
        ids, n = coder.of(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, idcoder.END_ID] for t in texts[k:k + 30]]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
    assert most < 10_000 or len(calls) <= len(set(calls)) + 8  # a piece is encoded once (letters beyond A-Z: once for each case)


def test_letters_and_closing_marks():
    words = [b"cat", b"Cat,.", "été!".encode(), "a×".encode(), b"a.b", b"...", b"b2", "日".encode(), b"\xc3", "é".encode() + b"\xc3."]
    length = np.array([len(w) for w in words])
    starts = np.cumsum(length + 1) - length - 1
    simple, cuts = idcoder._cuts(np.frombuffer(b" ".join(words) + b" ", np.uint8), starts)
    assert simple.tolist() == [True, True, True] + [False] * 7
    assert cuts.tolist() == [starts[1] + 3, starts[2] + 5]


def _peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_whole_segment_is_coded_in_little_memory():
    ids = np.minimum(np.random.default_rng(3).zipf(1.3, idcoder.SEGMENT_IDS), 48_000).astype(np.uint32)
    lengths = np.array([len(ids)], np.int64)
    segment, packing = _peak_mb(lambda: idcoder.pack([1], lengths, ids))
    (docs, n, back), reading = _peak_mb(lambda: idcoder.unpack(pa.py_buffer(segment)))
    assert docs == [1] and n.tolist() == [len(ids)] and (back == ids).all()
    # beside the ids themselves: two tasks run in one executor, next to its JVM
    assert packing < 130 and reading < 130


@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_segments_do_not_depend_on_the_lanes(monkeypatch, lanes):
    ids = np.random.default_rng(4).integers(0, 300, 5 * idcoder.BLOCK_IDS + 7).astype(np.uint32)
    n = np.array([100, len(ids) - 100])
    whole = idcoder.pack([1, 2], n, ids)
    monkeypatch.setattr(idcoder, "LANES", lanes)
    assert idcoder.pack([1, 2], n, ids) == whole
    assert (idcoder.unpack(whole)[2] == ids).all()


def test_remembered_ids_are_bounded_where_words_are_long(tokenizer, monkeypatch):
    monkeypatch.setattr(idcoder, "CACHE_WORDS", 200)
    monkeypatch.setattr(idcoder, "CACHE_PIECES", 200)
    coder = idcoder.Ids(vocabulary())
    most = 0
    for k in range(30):
        texts = ["1234567890-" * 40 + str(k), "aé" * 300 + chr(97 + k % 26)]
        raw = [t.encode() for t in texts]
        ids, n = coder.of(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
        assert ids.tolist() == [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, idcoder.END_ID]]
        most = max(most, len(coder.words.flat))
    assert len(n) == 2 and most < 200 * 8 + 4 * len(ids)


def test_the_session_keeps_its_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sizes = spark.range(40).selectExpr("repeat('x', 1000) AS text").coalesce(1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    with arrow_batches(spark, 8_000):
        small = sizes.collect()
    assert spark.conf.get(key) == before and sum(r.n for r in small) == 40 and max(r.n for r in small) < 20


def test_a_segment_is_coded_in_as_few_steps_as_its_memory_allows(monkeypatch):
    # the time of a step hardly depends on how many blocks take part, so 3,100 blocks are not coded as two halves
    monkeypatch.setattr(idcoder, "BLOCK_IDS", 32)
    steps = []
    predict = idcoder._Lanes.predict
    monkeypatch.setattr(idcoder._Lanes, "predict", lambda self: steps.append(1) or predict(self))
    ids = np.random.default_rng(6).integers(0, 300, 3100 * 32 - 5).astype(np.uint32)
    segment = idcoder.pack([1], np.array([len(ids)]), ids)
    assert len(steps) == 32
    assert (idcoder.unpack(segment)[2] == ids).all() and len(steps) == 64


def test_the_format_is_as_before():
    """Sums of segments that the coder wrote before its tables and steps were changed."""
    for seed, n, top, want in ((0, 300_000, 100_000, "b05c50584172"), (3, 50_000, 3, "80c71b6ee0aa"), (4, 6145, 500, "3af8adf0dca6")):
        ids = np.random.default_rng(seed).integers(0, top, n).astype(np.uint32)
        if n > 10_000:
            ids[n // 2:] = ids[:n - n // 2]
            ids[5000:6000] = ids[4000:5000]
        segment = idcoder.pack([1], np.array([n]), ids)
        assert hashlib.sha256(segment).hexdigest()[:12] == want
        assert (idcoder.unpack(segment)[2] == ids).all()


def test_remembered_ids_are_found_again(monkeypatch):
    rng = np.random.default_rng(8)
    # keys of few places, one of them 0, so that many share one
    keys = np.unique(np.r_[np.uint64(0), rng.integers(0, 1 << 64, 9000, np.uint64), rng.integers(0, 3000, 500, np.uint64)])
    known, made = idcoder._Known(20_000), []

    def make(places):
        made.extend(asked[places].tolist())
        n = asked[places] % np.uint64(4)
        return n.astype(np.int64), np.repeat((asked[places] >> np.uint64(7)).astype(np.uint32), n.astype(np.int64))

    for k in range(12):
        asked = rng.choice(keys[:800 * (k + 1)], 5000)
        entry = known.found(asked, make)
        assert (entry > 0).all() and (known.keys[entry] == asked).all()
        assert (known.n[entry] == asked % np.uint64(4)).all()
        some = known.n[entry] > 0
        assert (known.flat[known.at[entry[some]]] == (asked[some] >> np.uint64(7)).astype(np.uint32)).all()
    assert len(made) == len(set(made)) == known.size - 1
    assert known.n[0] == 1 and known.flat[known.at[0]] == idcoder.END_ID
    few = idcoder._Known(100)
    for k in range(5):
        asked = rng.choice(keys, 90)
        entry = few.found(asked, make)
        assert (few.keys[entry] == asked).all() and few.size <= 101
