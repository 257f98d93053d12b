"""Every registered query against its DuckDB oracle (the driver's correctness gate).

A missing oracle or an empty result is a failure; only the probabilities of two text models have none.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from aspectra.plans import queries as catalog
from oracle_harness import compare, duck

NO_SQL = {"train_multilabel_probs", "train_focal_text"}
NAMES = sorted(set(catalog.QUERIES) - NO_SQL)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    r = compare(spark, name, sf_dir, con)
    assert r.get("oracle", "x") is not None and r["spark_rows"] > 0, r
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["match"], r


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_probabilities_of_held_out_rows(spark, sf_dir, name):
    rows = E.queries()[name](spark, sf_dir).collect()
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").count()
    assert name not in E.oracle_sql() and 0 < len(rows) < 0.4 * labelled
    assert all(0.0 <= r[c] <= 1.0 for r in rows for c in ("p_quality", "p_toxic"))
    assert len({r["p_quality"] for r in rows}) > len(rows) // 2  # told apart


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "f1_micro", "f1_macro", "f1_weighted", "exact_match"]
    assert df.count() >= 1
