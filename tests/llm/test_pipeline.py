"""The pipeline's stages one after another, and the library without its optional parts."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from aspectra.llm import langid, queries
from aspectra.llm.tables import table
from helpers import similar_components, words

ROOT = Path(__file__).resolve().parents[2]


def test_stages_over_a_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append({r.doc_id: r for r in docs.collect()} if "doc_id" in docs.columns else None)
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
            seen[-1] = (seen[-1], rows)
    (_, identified), (before, deduped), (_, clean), (before_mix, mixed) = seen[:4]
    assert len(identified) == len(seen[0][0])  # every text of the table has letters
    predicted = {r.doc_id: r.lang_pred for r in langid.identify(table(spark, sf_dir, "documents")).collect()}
    assert {r.doc_id: r.lang for r in identified} == predicted
    comp, _ = similar_components({d: r.text for d, r in before.items()}, 5)
    assert sorted(r.doc_id for r in deduped) == sorted(d for d in comp if comp[d] == d)
    assert 0 < len(clean) < len(deduped)
    size = {d: len(words(r.text)) for d, r in before_mix.items()}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.1 and all(taken[d] <= 2 * size[d] for d in taken)
    # the ids of each mixed text, in order, with no gap
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    want = sorted((r.doc_id, zlib.crc32(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()))
                  for r in mixed)
    got = sorted(map(tuple, rows), key=lambda r: r[1])
    assert sorted((r[0], r[3]) for r in got) == want
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert [r[0] for r in got] == sorted(r[0] for r in got)


@pytest.mark.parametrize("rows", [
    [], [(None, None, None, None, None)],
    [(1, None, "en", "s", 0), (1, "", "en", None, 0), (2, "the cat sat", "en", "s", 11), (2, "the cat sat", "en", "s", 11),
     (3, "THE CAT sat", None, "t", 11), (None, "free text here", "en", None, 14), (4, "12", "en", "s", 2)]])
def test_stages_on_odd_rows(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.columns == out.columns
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= {2, None} and (not rows or len(rows) == 1 or 2 in ids or None in ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


@pytest.mark.parametrize("gone", [("aspectra.llm",), ("corpus_pipeline",), ("aspectra.llm", "corpus_pipeline")])
def test_the_entry_works_without_the_optional_parts(tmp_path, gone):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "spark-warehouse", "__pycache__"))
    if "aspectra.llm" in gone:
        shutil.rmtree(copy / "aspectra" / "llm")
    if "corpus_pipeline" in gone:
        (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), 'op5_license_scan' in e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    n, pipeline, licenses = out.stdout.split()
    assert int(n) > 100 and pipeline == "False"
    assert licenses == str("aspectra.llm" not in gone)


def test_every_operator_has_a_query():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.ORACLES) <= set(names)


def test_of_rows_with_one_id_the_first_stays(spark, sf_dir):
    rows = [(4, "z y x w v u", "en", "s", 1), (4, "a b c d e f", "en", "t", 2), (4, "a b c d e f", "de", "s", 2),
            (5, "z y x w v u", "en", "s", 1), (6, "other words are here now", "en", "s", 1), (None, "a b c d e f", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[2], rows[4], rows[5]], key=str)
