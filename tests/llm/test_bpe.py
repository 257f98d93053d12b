"""Operator 11 against the tiktoken library."""

import base64
import hashlib
import random
import struct

import pytest

pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from aspectra.llm import bpe  # noqa: E402
from aspectra.llm.tables import table  # noqa: E402

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    r = random.Random(7)
    letters = "".join(chr(c) for c in (0x41, 0x61, 0xE9, 0x3B1, 0x4E2D, 0x1F600, 0x870, 0x31350, 0x1E4F0, 0x10FFFF, 0xFFFF, 0x85, 0xA0, 0x2028))
    texts = [None, "", " ", "\n\n  \t x", "I'll we've 'S it's", "a" * 5000, "ab" * 700, "  " * 3000, "x\u0000y", "\u0000",
             "don't  stop\r\n\r\n  now   ", "<|endoftext|>", "1234567 ½ ² ٣", "naïve café́", "中文没有空格" * 60, "🙂🙃" * 40, "word " * 4000]
    texts += ["".join(r.choice(letters + " .,'1") for _ in range(r.randrange(1, 60))) for _ in range(150)]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 90))) for _ in range(150)]
    texts += ["".join(chr(r.choice([r.randrange(1, 0x300), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x20000)]))
                      for _ in range(30)) for _ in range(100)]
    return texts


@pytest.mark.parametrize("name", FILES)
def test_ids_and_bytes_are_those_of_the_library(spark, name):
    texts = hard_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(docs, P.path(name), P.PATTERN).persist()
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, P.path(name)).collect()}
    encoded.unpersist()
    one = library(P.path(name))
    for i, text in enumerate(texts):
        assert got[i] == one.encode_ordinary(text or ""), repr(text)[:80]
        assert back[i] == (text or "")


def test_words_outside_the_dictionary_are_folded_where_they_stand(spark, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    texts = ["the zebra of the woods", "the quixotic zebra", "unheardofword " + "q" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(docs, P.path(FILES[0]), P.PATTERN)
    one = library(P.path(FILES[0]))
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: one.encode_ordinary(t) for i, t in enumerate(texts)}


def test_digests_of_the_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    one = library(P.path(FILES[0]))
    got = {r["doc_id"]: r[1:] for r in bpe.digests(docs, P.path(FILES[0]), P.PATTERN).collect()}
    want = {}
    for r in docs.collect():
        ids = one.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                             hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert got == want


def test_defined_cases(spark):
    rows = [(1, "same", "x", 5), (1, "same", "x", 5), (None, "no id", "y", 5), (2, None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.digests(docs, P.path(FILES[0]), P.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in out.collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(0, 2, sha("no id")), (1, 1, sha("same")), (1, 1, sha("same")), (2, 0, sha(""))]
    assert bpe.digests(docs.limit(0), P.path(FILES[0]), P.PATTERN).count() == 0


def test_pieces_that_no_merges_make_are_found_whole(spark, tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}  # nothing makes "abcd" of two pieces
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for p, i in ranks.items()))
    docs = spark.createDataFrame([(1, "abcd abcd abcde")], "doc_id long, text string")
    encoded = bpe.encode(docs, str(path), P.PATTERN)
    assert encoded.first()["ids"] == library(path).encode_ordinary("abcd abcd abcde")


def test_a_file_without_all_bytes_is_refused(spark, tmp_path):
    path = tmp_path / "short.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="no rank"):
        bpe.Vocabulary(spark, str(path), P.PATTERN)


def test_places_are_those_of_the_dictionary():
    import pyarrow as pa

    known = pa.array([" a", "b", "日", "\n"])
    values = pa.array(["x", "b", "日", "b", " a", "a", "日日"]).slice(1)
    assert bpe.places(values, known).tolist() == [1, 2, 1, 0, -1, -1]
    none = pa.array([], pa.string())
    assert bpe.places(none, known).tolist() == [] and bpe.places(values, none).tolist() == [-1] * 6
