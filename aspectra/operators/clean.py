"""Projection and filter operators (P1-P12, S8).  DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.aspects import detect_aspects
from aspectra.functions.text import join_aspects, normalise_label, null_text_to_empty
from aspectra.schema import (DEFAULT_SCHEMA, EMPTY_DISPLAY, KEEP_FLAG, MIN_TEXT_LENGTH,
                             NEGATIVE_SCORES, POSITIVE_SCORES, REMOVE_FLAG, AspectSchema)

TEXT_ALIASES = ("review_text", "review_comment_message")


def text_column(df: DataFrame) -> str:
    """``review_text`` if present, else ``review_comment_message``."""
    for c in TEXT_ALIASES:
        if c in df.columns:
            return c
    return TEXT_ALIASES[1]


def normalize_columns(df: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA,
                      add_missing_sentiments: bool = True) -> DataFrame:
    """Tolerate optional columns at plan-build time.

    * text alias -> ``review_text``
    * absent sentiment columns -> typed null columns
    * absent ``to_remove`` / ``review_score`` stay absent (callers decide)
    """
    tc = text_column(df)
    if tc in df.columns and tc != "review_text":
        df = df.withColumnRenamed(tc, "review_text")
    if add_missing_sentiments:
        for c in schema.sentiment_columns:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def drop_removed(df: DataFrame, flag: str = "to_remove") -> DataFrame:
    """Keep rows whose stripped, lower-cased flag is not 'sim'; null flag kept."""
    if flag not in df.columns:
        return df
    return df.filter(~normalise_label(flag).eqNullSafe(F.lit(REMOVE_FLAG)))


def require_text(df: DataFrame, text: str | None = None) -> DataFrame:
    """Drop rows with null text (``IsNotNull`` reaches the Parquet scan as a pushed filter)."""
    return df.filter(F.col(text or text_column(df)).isNotNull())


def min_text_length(df: DataFrame, text: str | None = None, n: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Keep rows with at least ``n`` code points (no strip)."""
    return df.filter(F.length(F.col(text or text_column(df))) >= n)


def drop_unlabelled(df: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Drop rows where every sentiment column is null; without any such column it raises."""
    cols = [c for c in schema.sentiment_columns if c in df.columns]
    if not cols:
        raise ValueError(f"none of {', '.join(schema.sentiment_columns)} is a column")
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols]))


def score_band(score) -> F.Column:
    """P5: 'neg' for scores 1-2, 'pos' for 4-5, null for 3 / missing."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s.isin(*NEGATIVE_SCORES), F.lit("neg"))
            .when(s.isin(*POSITIVE_SCORES), F.lit("pos")))


def score_band_filter(df: DataFrame, band: str, score: str = "review_score") -> DataFrame:
    """P5: keep one band ('neg' or 'pos')."""
    scores = NEGATIVE_SCORES if band == "neg" else POSITIVE_SCORES
    return df.filter(F.col(score).isin(*scores))


def score_equals(df: DataFrame, k: int, score: str = "review_score") -> DataFrame:
    """Equality filter on the score."""
    return df.filter(F.col(score) == F.lit(k))


def score_in(df: DataFrame, ks, score: str = "review_score") -> DataFrame:
    """P6 for several scores at once (one scan instead of one filter per score)."""
    return df.filter(F.col(score).isin(*[int(k) for k in ks]))


def project_training(df: DataFrame, text: str = "text", labels: str = "labels",
                     key: str | None = "review_id") -> DataFrame:
    """Keep text and labels only (the id is kept when present, to stay aligned)."""
    cols = ([key] if key and key in df.columns else []) + [text, labels]
    return df.select(*cols)


def labelling_sheet(df: DataFrame, aspects_col: str = "aspects", text: str | None = None,
                    schema: AspectSchema = DEFAULT_SCHEMA, lexicon: dict | None = None) -> DataFrame:
    """Id, score, text, ', '-joined aspects, empty sentiment columns, ``to_remove='Não'``."""
    tc = text or text_column(df)
    if aspects_col not in df.columns:
        if lexicon is None:
            raise ValueError("labelling_sheet needs an aspects column or a lexicon")
        df = df.withColumn(aspects_col, detect_aspects(tc, lexicon))
    cols = [F.col("review_id"), F.col("review_score"), F.col(tc).alias("review_text"),
            join_aspects(aspects_col).alias("aspectos_detectados")]
    cols += [F.lit("").alias(c) for c in schema.sentiment_columns]
    cols.append(F.lit(KEEP_FLAG).alias("to_remove"))
    return df.select(*cols)


def rename_text(df: DataFrame, to: str = "text") -> DataFrame:
    """Rename the text column (either alias) to ``to``."""
    return df.withColumnRenamed(text_column(df), to)


def fill_missing_score(df: DataFrame, score: str = "review_score", fill: int = 3) -> DataFrame:
    """P10: missing score -> 3."""
    return df.withColumn(score, F.coalesce(F.col(score), F.lit(fill)))


def fill_missing_label(df: DataFrame, cols=None, display: bool = True,
                       schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Missing sentiment -> '(vazio)' for display or '' for counting."""
    cols = [c for c in (cols or schema.sentiment_columns) if c in df.columns]
    fill = EMPTY_DISPLAY if display else ""
    return df.select(*[F.coalesce(F.col(c), F.lit(fill)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def null_text_to_empty_cols(df: DataFrame, text: str | None = None, key: str = "review_id") -> DataFrame:
    """Id as string, null text -> ''."""
    tc = text or text_column(df)
    return df.withColumn(key, F.col(key).cast("string")).withColumn(tc, null_text_to_empty(tc))
