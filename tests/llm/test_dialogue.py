"""Operator 12 against exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from aspectra.llm import dialogue
from aspectra.llm.tables import table

LEGAL = re.compile(r"(s?(ua)+)?\Z")
GAP = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    """The first fault of each row, by the words of the contract."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(GAP)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """Cost and audit, by the best (cost, audit) of each suffix and state."""
    kinds = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def suffix(i, state, inserted):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            kind, initial = kinds[i], rows[i][0][:1]
            edits = [("D", 2, state)]
            if kind not in ("blank", "duplicate"):
                more = 5 if kind == "truncated" else 0
                if (state, initial) in step:
                    edits.append(("K", more, step[state, initial]))
                edits += [("R", 1 + more, step[state, r]) for r in "ua" if (state, r) in step]
            for letter, cost, to in edits:
                c, rest = suffix(i + 1, to, 0)
                found.append((cost + c, letter + rest))
        if inserted < 3:
            for r in "ua":
                if (state, r) in step:
                    c, rest = suffix(i, step[state, r], inserted + 1)
                    found.append((5 + c, "I" + rest))
        return min(found, default=(1 << 30, ""))

    return suffix(0, "", 0)


def exhaustive(rows):
    """The same from all audits of up to three inserts, each read literally."""
    kinds, found = faults(rows), []
    for n in range(4):
        for audit in map("".join, itertools.product("DIKR", repeat=len(rows) + n)):
            if audit.count("I") != n:
                continue
            options = [("", 0)]
            at = 0
            for letter in audit:
                if letter == "I":
                    options = [(s + r, c + 5) for s, c in options for r in "ua"]
                    continue
                kind, role = kinds[at], rows[at][0]
                at += 1
                if letter == "D":
                    options = [(s, c + 2) for s, c in options]
                elif kind in ("blank", "duplicate"):
                    options = []
                else:
                    more = 5 * (kind == "truncated")
                    options = [(s + x, c + more + (letter == "R")) for s, c in options
                               for x in ("ua" if letter == "R" else [role[:1] or "-"])]
            found += [(c, audit) for s, c in options if LEGAL.match(s)]
    return min(found)


def result(rows, turns):
    """The whole row of results of one conversation after damage."""
    kinds = faults(rows)
    cost, audit = best(tuple(rows))
    lines, role, left = [], "", iter(rows)
    for e in audit:
        own = ("", "") if e == "I" else next(left)
        if e != "D":
            role = own[0] if e == "K" else {"": "user", "s": "user", "u": "assistant", "a": "user"}[role[:1]]
            lines.append(f"{role}:{own[1]}")
    known = {t for t in turns if t is not None}
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (max(known) - min(known) + 1 - len(known) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else x
        role, text = name(role), name(text)
        dealt = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if dealt == 0:
            continue
        text = "" if dealt == 1 else re.sub("[.!?]", "", text) if dealt == 2 else text
        out += [(conv, turn, "user" if dealt == 4 else role, text)] * (2 if dealt == 3 else 1)
    return out


def expected(rows, hurt):
    out = {conv: (0, 0, 0, 0, 0, 0, "", EMPTY) for conv, *_ in rows}
    groups = {}
    for conv, turn, role, text in (damage(rows) if hurt else rows):
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role, text, turn))
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        out[conv] = result([(r[2], r[3]) for r in held], [r[4] for r in held])
    return out


def some_rows(r, n, texts=("Hi.", "What?", "cut off", "Yes!", " ", "", "Sure. ", "No. Really")):
    roles = ["user", "assistant", "system", "tool", "user", "assistant", ""]
    return [(r.choice(roles), r.choice(texts) + (str(r.randrange(9)) + "." if r.random() < 0.5 else "")) for _ in range(n)]


def test_the_reference_search_is_exhaustive():
    r = random.Random(3)
    for _ in range(60):
        rows = tuple(some_rows(r, r.randrange(0, 4)))
        assert best(rows) == exhaustive(rows), rows


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_chunks_settle_on_the_costs_of_one_search(chunk):
    r = random.Random(chunk)
    for _ in range(40):
        n = r.randrange(1, 40)
        codes = np.array([r.choice([0, 1, 2, 3, 5, 6, 8, 9, 1, 2]) for _ in range(n)])
        end = np.array(r.choice([[0, 10, 5, 0], [3, 0, 4, 1], [0, 1, 0, 6]]))
        whole = dialogue.backward(codes[None, :], end[None, :])
        runs = dialogue._lanes([codes[a:a + chunk] for a in range(0, n, chunk)])
        costs, ends, passes = dialogue.settle(runs, end)
        assert passes <= len(runs)
        for k in range(len(runs)):
            true = whole[k * chunk:(k + 1) * chunk + 1, 0]
            gap = true - costs[:len(true), k]
            assert (gap == gap[0, 0]).all()


def check(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repaired(df).collect()}
    assert got == expected(rows, True)


def test_random_conversations(spark):
    r = random.Random(11)
    rows = []
    for conv in range(300):
        order = r.sample(range(30), r.randrange(1, 12))
        rows += [(conv, t if r.random() < 0.95 else None, *x) for t, x in zip(order, some_rows(r, len(order)))]
    rows += [(None, 1, "user", "Anybody?"), (None, 2, None, None), (999, None, None, None), (-1, 5, "user", "x")]
    check(spark, rows)


def test_large_conversations_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "CHUNK", 16)
    r = random.Random(5)
    rows = [(7, t, *x) for t, x in enumerate(some_rows(r, 900, texts=[f"{w} {i}." for i in range(200) for w in ("a", "b")] + ["open"] * 40))]
    rows += [(8, t, "user", "Same again.") for t in range(300)]  # one role only
    rows += [(9, 3, "assistant", "Equal rows.")] * 400  # all equal
    rows += [(10, t, ("user", "assistant")[t % 2], f"Fine {t}.") for t in range(300)]
    rows += [(11, t, ("user", "assistant")[t % 2], f"cut {t}") for t in range(300)]  # all to be deleted
    rows += [(c, t, *x) for c in range(100, 140) for t, x in enumerate(some_rows(r, 5))]
    import sys

    sys.setrecursionlimit(20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_rows_are_those_of_the_digest(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    rows = dialogue.damaged(df)
    texts = {}
    for r in dialogue.repaired_rows(rows).orderBy("ck", "pos").collect():
        texts.setdefault(r["ck"], []).append(f"{r['role']}:{r['text']}")
    want = {r["ck"]: r["repaired_sha256"] for r in dialogue.repair(rows).collect()}
    assert {k: hashlib.sha256("\n".join(texts.get(k, [])).encode()).hexdigest() for k in want} == want


def test_the_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repaired(df).collect()}
    assert got == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], True)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", "x", 3)], "conv_id long, turn long, role string, text string, ck string, part int")
    assert dialogue.repaired(df).count() == 1
    none = dialogue.repaired(df.limit(0))
    assert none.count() == 0 and none.columns == ["conv_id", *dialogue._RESULT_NAMES]
