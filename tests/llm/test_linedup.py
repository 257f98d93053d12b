"""Repeated line runs against plain Python and DuckDB."""

import random

import duckdb
import pytest

from aspectra.llm import linedup

SCHEMA = "doc_id long, text string, line string, pos int"


def brute(docs, min_words):
    """Every stretch of lines with min_words words that stood anywhere before goes."""
    lines = {}
    for d, t in sorted(docs.items()):
        raw = (t or "").split("\n")
        lines[d] = [(i, " ".join(x.split())) for i, x in enumerate(raw) if x.split()]
    seen, gone = {}, {d: set() for d in docs}
    for d in sorted(docs):
        s = lines[d]
        for a in range(len(s)):
            words = 0
            for b in range(a, len(s)):
                words += len(s[b][1].split())
                if words >= min_words:
                    name = tuple(x for _, x in s[a:b + 1])
                    if name in seen and seen[name] < (d, a):
                        gone[d].update(range(s[a][0], s[b][0] + 1))
                    seen.setdefault(name, (d, a))
    return {d: (0 if t is None else len(t.split("\n")), len(gone[d]),
                None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]))
            for d, t in docs.items()}


def run(spark, docs, min_words):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs.items()], SCHEMA)
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linedup.drop_repeats(df, min_words).collect()}


@pytest.mark.parametrize("seed,min_words", [(1, 6), (2, 9), (3, 1)])
def test_random_runs(spark, seed, min_words):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(7)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(2, 9))] for _ in range(4)]
    docs = {}
    for d in range(25):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts += rng.choice(blocks) if rng.random() < 0.5 else [rng.choice([*pool, "", f"own {d} {len(parts)}"])]
        docs[d] = "\n".join(parts)
    assert run(spark, docs, min_words) == brute(docs, min_words)


def test_defined_cases(spark):
    passage = "\n".join(f"line {k} of a long passage" for k in range(12))
    docs = {1: None, 2: "", 3: "\n\n", 4: passage, 5: f"before\n{passage}\n\nafter", 6: passage.replace(" ", "\t "),
            7: "\n".join(f"w{i} x" for i in range(60)), 8: passage + "\n" + passage, 9: "short\nshort\nshort"}
    got = run(spark, docs, 50)
    assert got == brute(docs, 50)
    assert run(spark, {1: "\n".join(f"w{i} x" for i in range(20_000))}, 50)[1][:2] == (20_000, 0)
    assert got[4][1] == 0 and got[5][2] == "before\n\nafter" and got[6][2] == "" and got[9][1] == 0


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    text = "a b c\nd e f"
    rows = [(2, text), (1, text), (2, text), (None, text), (2, "other\n" + text)]
    got = linedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 2), (2, 2), (2, 2)]
    assert linedup.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ranks_follow_the_order_of_suffixes(spark):
    df = linedup.lines(spark.createDataFrame([(1, "a\nb\na\nb\na\nb\nc"), (2, "b\na\nb\na\nb")], "doc_id long, text string"))
    ranked, top = linedup.prefix_ranks(df, 4)
    rows = ranked.orderBy("doc_id", "pos").collect()
    seq = {(r.doc_id, r.pos): r.r0 for r in rows}
    assert top == 2
    for k in (1, 2):
        named = {}
        for r in rows:
            key = tuple(seq.get((r.doc_id, r.pos + i)) for i in range(1 << k))
            if r[f"r{k}"] is not None:
                named.setdefault(key, set()).add(r[f"r{k}"])
        assert all(len(v) == 1 for v in named.values())
        assert sorted(named) == sorted(named, key=lambda key: min(named[key]))


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(map(tuple, linedup.drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()))
    assert got == sorted(con.execute(linedup.ORACLE_SQL).fetchall()) and sum(r[2] for r in got) > 0
