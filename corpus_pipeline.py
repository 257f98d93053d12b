"""The corpus pipeline: documents through five of the operators of ``aspectra.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm import decontam, idcoder, langid, minhash, mixing
from aspectra.llm.queries import vocabulary
from aspectra.llm.tables import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language, which ``lang`` then names; null texts and texts without a letter go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (five words, 0.8).

    Of rows with one ``doc_id``, which are one document, the first in the order of all columns stays;
    rows without a ``doc_id`` stay.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    # ids are counted first, so that only the few rows of repeated ids are compared
    repeated = left.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    first = (left.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id"))
             .agg(F.min(F.struct(*left.columns)).alias("_first")).select("_first.*"))
    return left.join(repeated, "doc_id", "left_anti").unionByName(first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix to target weights takes them: a row for each pass that takes words of one."""
    return mixing.mixed_documents(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids in coded blocks; a row per document read back from them."""
    return idcoder.encode(docs.select("doc_id", "text"), vocabulary())


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", encode_ids),
]

#: the mix, and the ids of its texts, cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
