"""Secrets: base spans against ``re``, and the Markov models."""

import hashlib
import re

from aspectra.llm import secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
RANDOM = "9fJk2Lq0Zx8Tb7Vn3Wm5Rc1Yd6Ps4GhA"

TEXTS = [
    None, "", "nothing here", "token=abc password : \"hunter2hunter2\" x", "AKIA" + "Z" * 16 + " AKIAAKIA12 AKIAAKIA0123456789",
    "é" * 5 + " API_KEY=abcdefgh" + " a" * 5 + "0123456789abcdef" * 2 + "X", "token=secret=abcdefghijk token=passwd: abcdefghij",
    f"key {RANDOM} end, token={RANDOM}", "Donaudampfschifffahrtsgesellschaft internationalization_of_everything",
    "secret = '" + "ab" * 2000 + "'", "tokens: 12345678 apikey'=  'x.y.z-w=12", "passwd=" + "f" * 40, "ſecret=abcdefgh toKen=abcdefgh",
    "😀 token=abcdefghij 😀 " + "0" * 32,
]


def base(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(t) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def check(got, texts):
    for r in got:
        want = base(texts[r.doc_id])
        listed = [x for x in r.spans.split(",") if x]
        assert [x for x in listed if not x.startswith("markov")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        spans = sorted(tuple(map(int, x.split(":")[1:])) for x in listed)
        for x in listed:
            if x.startswith("markov"):
                a, b = map(int, x.split(":")[1:])
                assert not any(s < b and a < e for s, e in spans if (s, e) != (a, b))


def test_cases_with_the_words_of_a_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts = docs | {-k - 1: t for k, t in enumerate(TEXTS)}
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in texts.items()], "doc_id long, text string, kind string, start int")
    got = secrets.scan(df).collect()
    assert len(got) == len(texts)
    check(got, texts)
    by = {r.doc_id: r for r in got}
    assert sum(r.n_hex for r in got) > 3
    # the random key is found beside the assigned one, ordinary long words are not
    assert by[-8].spans == f"markov:4:36,assign:{42}:{48 + 32}"
    assert by[-9].n_markov == 0 and sum(by[d].n_markov for d in docs) <= 1


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    rows = [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, "token=abcdefgh"), (1, "other"), (2, None)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in got) == [
        (0, 1, "assign:0:14"), (1, 0, ""), (1, 1, "assign:0:14"), (1, 1, "assign:0:14"), (2, 0, "")]
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_text_with_very_many_matches(spark):
    text = "token=abcdefgh\n" * 20_000
    r, = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_assign == 20_000 and r.spans.endswith(f"assign:{15 * 19_999}:{15 * 19_999 + 14}")


def test_log_probabilities_add_up():
    import math

    p = secrets.log_probabilities({0: 3, 1: 5, 70: 2})
    for a in range(3):
        assert abs(sum(math.exp(x) for x in p[a * secrets.STATES:(a + 1) * secrets.STATES]) - 1) < 1e-9


def test_native(spark, sf_dir):
    df = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
