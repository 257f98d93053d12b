"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aspectra.llm import bpe, decontam, dialogue, idcoder, itq, langid, lexical, licenses, linedup, lm, minhash, mixing, secrets
from aspectra.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """The tokenizer file: ``ASPECTRA_TOKENIZER``, or the installed public word vocabulary."""
    given = os.environ.get("ASPECTRA_TOKENIZER")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranks() -> tuple[str, str]:
    """The byte-level rank file, ``ASPECTRA_RANKS`` or the installed public one, and its pattern."""
    import public_tokenizers

    return os.environ.get("ASPECTRA_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the maximum-entropy model of those that are not held out."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in coded blocks and read back."""
    return idcoder.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled documents outside the held-out fold."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words and more."""
    return linedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix to target weights takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: pattern spans, and strings that Markov models find random."""
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that documents, or single lines of them, are."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings at cosine 0.95 or more."""
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, by consistent template windows."""
    return decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                  table(spark, sf_dir, "benchmark"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles at 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and the texts they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *ranks())


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the damaged conversations, and the cheapest edits that repair them."""
    return dialogue.repaired(table(spark, sf_dir, "conversations"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = lexical.ORACLE_SQL
ORACLES["op5_license_scan"] = licenses.ORACLE_SQL
ORACLES["op8_line_dedup"] = linedup.ORACLE_SQL
