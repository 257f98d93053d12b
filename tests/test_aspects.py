"""Single-scan aspect detection equals one ``rlike`` per aspect with the flat alternation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aspectra.functions.aspects import aspect_hits, is_word_token, java_pattern, trie_pattern
from aspectra.plans import bridge
from aspectra.schema import ASPECTS, DRIVER_LEXICON, NARROW_LEXICON, WIDE_LEXICON

CUSTOM = {  # prefixes of each other, shared stems across aspects, a non-word token, digits and underscores
    "logistica": ["cor", "cores", r"cor\w*", r"R\$", "a_b"],
    "produto": [r"co\w+", "corda", "x1"],
    "atendimento": [r"R\$\w*", "ré", r"é\w*"],
    "preco": ["İzmir", r"Straße\w*"],
}

SENTENCES = ["cor", "Cores e CORDA", "corr", "R$50", "R$ 50", "x1 x12", "a_b a_bc", "Ré é éter", "co", "", None,
             "ação, coração", "acor cores.", "İZMİR izmir İzmir", "STRASSE straßenbahn"]


def _flat(text, lexicon):
    return {a: F.coalesce(F.col(text).rlike(java_pattern(lexicon[a])), F.lit(False)) if lexicon[a] else F.lit(False)
            for a in ASPECTS if a in lexicon}


def _same(df, text, lexicon):
    new = aspect_hits(text, lexicon, [a for a in ASPECTS if a in lexicon])
    old = _flat(text, lexicon)
    got = df.select(*[new[a].alias(a) for a in new]).collect()
    want = df.select(*[old[a].alias(a) for a in old]).collect()
    return got, want


@pytest.mark.parametrize("lexicon", [WIDE_LEXICON, NARROW_LEXICON, DRIVER_LEXICON, CUSTOM],
                         ids=["wide", "narrow", "driver", "custom"])
def test_matches_flat_rlike_on_sentences(spark, lexicon):
    df = spark.createDataFrame([(s,) for s in SENTENCES], "text string")
    got, want = _same(df, "text", lexicon)
    assert got == want


@pytest.mark.parametrize("table,col", [("documents", "text"), ("conversations", "text")])
@pytest.mark.parametrize("lexicon", [WIDE_LEXICON, DRIVER_LEXICON, CUSTOM], ids=["wide", "driver", "custom"])
def test_matches_flat_rlike_on_tables(spark, sf_dir, table, col, lexicon):
    df = bridge.table(spark, sf_dir, table).select(col)
    got, want = _same(df, col, lexicon)
    assert got == want


def test_trie_and_word_tokens():
    assert trie_pattern(["cor", "cores", r"cor\w*"]) == r"cor(?:|\w*|es)"
    assert is_word_token(r"entreg\w*") and is_word_token("ótimo") and not is_word_token(r"R\$")


def test_first_char_guard():
    from aspectra.functions.aspects import _first_char_guard

    assert _first_char_guard(["Cor", r"entreg\w*", "x1"]) == "(?=[Ccex])"
    assert _first_char_guard(["cor", r"\w*ção"]) == ""  # a token may start with any word character


def test_leading_class_token_matches_flat(spark):
    lex = {"logistica": [r"\w*ção", "cor"], "produto": [r"\w+mente"], "atendimento": ["x"], "preco": []}
    df = spark.createDataFrame([("ação e coração",), ("rapidamente",), ("cor",), ("nada",)], "text string")
    got, want = _same(df, "text", lex)
    assert got == want
