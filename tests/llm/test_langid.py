"""Language identification: held-out accuracy and defined cases."""

import numpy as np
import pyarrow as pa

from aspectra.llm import langid
from helpers import crc_fold

SCHEMA = "doc_id long, text string, lang string, score int"


def test_held_out_accuracy_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(lang) and all(r.held_out == crc_fold(r.doc_id, 5) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


TRAIN = [(k, t, lang, 1) for k, (t, lang) in enumerate(
    [("the cat and the dog and the bird", "en"), ("der hund und die katze und das haus", "de")] * 12)]
CASES = [(100, None, None, 1), (101, "", "en", 1), (102, "12 ... !?", "en", 1), (103, "the and the", None, 1),
         (104, "und und das", None, 1), (105, "UND DAS", "xx", 1), (106, "hundkatze", None, 1), (107, "é", None, 1),
         (108, "the " * 50_000, None, 1), (None, "the cat", "en", 1)]


def test_defined_cases(spark):
    df = spark.createDataFrame([*TRAIN, *CASES, CASES[4]], SCHEMA)
    got = langid.identify(df).collect()
    assert len(got) == len(TRAIN) + len(CASES) + 1
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert by[103].lang_pred == "en" and by[104].lang_pred == by[106].lang_pred == "de" and by[108].lang_pred == "en"
    assert sum(r.doc_id == 104 for r in got) == 2 and by[None].held_out
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 100) == [103, 104, 104, 105, 106, 107, 108]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, 1), (2, "12", None, 1)], SCHEMA)
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    assert [r.doc_id for r in langid.keep_identified(df).collect()] == [1]
    assert langid.identify(df.limit(0)).collect() == []


def test_labels_of_held_out_rows_and_of_the_row_itself_are_not_used(spark):
    a = spark.createDataFrame([*TRAIN, *CASES], SCHEMA)
    swapped = [(d, t, "zz" if d is None or crc_fold(d, 5) else lang, s) for d, t, lang, s in [*TRAIN, *CASES]]
    b = spark.createDataFrame(swapped, SCHEMA)
    key = lambda r: (r.doc_id or -1, r.lang_pred, round(r.score, 9))
    assert sorted(map(key, langid.identify(a).collect())) == sorted(map(key, langid.identify(b).collect()))


def test_backoff_takes_the_longest_known_grams():
    keys = {0: np.zeros(0, np.uint64)} | {n: np.zeros(0, np.uint64) for n in langid.SIZES}
    w = langid.words_of(pa.array(["ab"]))
    every = np.arange(1)
    assert [len(langid.grams(w, every, n)[0]) for n in (5, 4, 3, 2, 1)] == [0, 1, 2, 3, 2]
    logs = {n: np.zeros((0, 2)) for n in (0, *langid.SIZES)}
    for size, best in ((1, 0), (3, 1)):
        h = np.sort(langid.grams(w, every, size)[0])
        keys[size], logs[size] = h, np.tile([-1.0, -9.0] if best == 0 else [-9.0, -1.0], (len(h), 1))
    m = langid.Model(["aa", "bb"], keys, logs)
    assert m.score(pa.array(["ab"]))[0][0] == 1  # size 3 is known, so size 1 is not asked
    keys[3], logs[3] = np.zeros(0, np.uint64), np.zeros((0, 2))
    assert m.score(pa.array(["ab"]))[0][0] == 0


def by_hand(rows):
    """The scores by plain counting: known words first, else the n-grams of the longest size with a known one."""
    import itertools
    import math

    def letters(text):
        return ["".join(g) for alpha, g in itertools.groupby((text or "").lower(), str.isalpha) if alpha]

    def pieces(word, size):
        if size == 0:
            return [word]
        edged = word if size == 1 else f"\0{word}\0"
        return [edged[i:i + size] for i in range(len(edged) - size + 1)]

    langs = sorted({lang for d, _, lang in rows if lang is not None and not crc_fold(d, 5)})
    counts = {s: {} for s in range(6)}
    for d, text, lang in rows:
        if lang is None or text is None or crc_fold(d, 5):
            continue
        for word in letters(text):
            for s in range(6):
                for x in pieces(word, s):
                    counts[s].setdefault(x, [0] * len(langs))[langs.index(lang)] += 1
    total = {s: [sum(c[k] for c in counts[s].values()) for k in range(len(langs))] for s in counts}
    log = lambda s, x, k: math.log((counts[s][x][k] + 0.5) / (total[s][k] + 0.5 * (len(counts[s]) + 1)))
    out = {}
    for d, text, _ in rows:
        sums = [0.0] * len(langs)
        for word in letters(text):
            for s in (0, 5, 4, 3, 2, 1):
                known = [x for x in pieces(word, s) if x in counts[s]]
                if known:
                    for k in range(len(langs)):
                        sums[k] += sum(log(s, x, k) for x in known) / len(known)
                    break
        top = max(sums)
        shares = [math.exp(v - top) for v in sums]
        out[d] = (langs[sums.index(top)], 1 / sum(shares)) if letters(text) else ("und", 0.0)
    return out


def test_scores_against_plain_counting(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(10 ** 7 + i, t, None) for i, t in enumerate(["zzqx vrrk", "the zzq der", "x", "Étion dans", "", None, "12 34"])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for d, (lang, score) in by_hand(rows).items():
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-4, d
