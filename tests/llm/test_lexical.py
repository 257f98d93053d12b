"""Operator 13 against the scores of every document."""

import math
import random
import re

import numpy as np
import pytest

from aspectra.llm import lexical
from aspectra.llm.tables import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items):
    """``{(item_id, rank): (doc_id, score)}`` by reading every document for every item."""
    bags = []
    df, total = {}, 0
    for doc_id, text in docs:
        t = terms(text)
        bag = {}
        for x in t:
            bag[x] = bag.get(x, 0) + 1
        for x in bag:
            df[x] = df.get(x, 0) + 1
        total += len(t)
        bags.append((doc_id, len(t), bag))
    n_docs = sum(n > 0 for _, n, _ in bags)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item_id, text in set(items):
        asked = terms(text)
        scores = []
        for doc_id, n, bag in bags:
            m = 25 + 75 * n * n_docs // total if total else 0
            score = sum(weight[t] * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in asked if t in bag)
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        out += [(item_id, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(r, n, vocabulary):
    return [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=r.randrange(0, 40))))
            for i in range(n)]


@pytest.mark.parametrize("focus,bucket", [(12, 2048), (1, 7), (3, 50)])
def test_ranks_and_scores_are_exact(spark, monkeypatch, focus, bucket):
    monkeypatch.setattr(lexical, "FOCUS", focus)
    monkeypatch.setattr(lexical, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(lexical, "LONGEST", 20)
    r = random.Random(focus)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÉTÉ", "naïve", "中文", "x_y", "don't", "A-B"]
    docs, items = made(r, 600, vocabulary), made(r, 25, vocabulary)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                         spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute_force(docs, items)


def test_blocks_of_queries_and_postings_of_all_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    monkeypatch.setattr(lexical, "SHIPPED", 10)
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(120)]
    docs, items = made(r, 200, vocabulary), made(r, 12, vocabulary)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute_force(docs, items)


def test_defined_cases(spark):
    """Ties by id with null first, repeated ids, null and empty texts, case, repeated queries, many equal documents."""
    docs = [(5, "Alpha beta"), (3, "alpha BETA"), (None, "alpha beta"), (3, "alpha gamma"), (7, None), (8, ""), (9, "...,;"),
            *[(100 + i, "same words here") for i in range(40)], (200, "word " * 30_000 + "alpha")]
    items = [(1, "ALPHA beta beta"), (1, "ALPHA beta beta"), (2, "nothing known"), (3, None), (4, "same words"), (None, "gamma")]
    d = spark.createDataFrame([(*x, "z", 1) for x in docs], "doc_id long, text string, item_id string, n int")
    q = spark.createDataFrame([(*x, 4) for x in items], "item_id long, text string, doc_id int")
    got = rows(lexical.search(d, q))
    assert got == brute_force(docs, items)
    assert [x[2] for x in sorted((x for x in got if x[0] == 4), key=lambda x: x[1])] == list(range(100, 110))
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.filter("doc_id = 7"), q)):
        none = lexical.search(a, b)
        assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_the_whole_tables(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    got = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    assert rows(got) == brute_force(docs, items)


def test_buckets_are_pruned(monkeypatch):
    """A bucket whose longest vector cannot reach the threshold is not opened."""
    queries = lexical.Queries.__new__(lexical.Queries)
    queries.norm = np.array([2.0, 1.0])
    batch = lexical.pa.RecordBatch.from_pydict({"norm": [10.0, 9.0]})
    queries._bucket(batch, lexical.Best(np.array([21, 11])))  # would fail on the missing columns
    with pytest.raises(KeyError):
        queries._bucket(batch, lexical.Best(np.array([20, 11])))
