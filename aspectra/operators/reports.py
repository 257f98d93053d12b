"""Profiling aggregates over review and label tables.

Each report is one partial-aggregating pass (map-side combine, a handful of
output groups) followed by arithmetic on the few aggregated rows.  Totals are
taken with windows over the aggregated rows, never by joining back to the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.aspects import aspect_hits
from aspectra.functions.labels import encode_labels, ui_sentiment
from aspectra.functions.text import bar_text, normalise_label, unicode_strip
from aspectra.operators.clean import text_column
from aspectra.schema import (DEFAULT_SCHEMA, EMPTY_DISPLAY, MIN_TEXT_LENGTH, SENTIMENTS,
                             AspectSchema)


def _rows(pairs: list[tuple[Column, ...]], names: list[str]) -> Column:
    """Array of structs for ``inline``: turns one wide aggregate row into a few rows."""
    return F.array(*[F.struct(*[v.alias(n) for v, n in zip(p, names)]) for p in pairs])


def funnel_counts(df: DataFrame, text: str | None = None, n: int = MIN_TEXT_LENGTH) -> DataFrame:
    """A1: total rows, rows with text, rows with >= n characters; one pass."""
    tc = F.col(text or text_column(df))
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(tc.isNotNull()).alias("with_text"),
                  F.count_if(F.length(tc) >= n).alias("min_length"))


def flag_value_counts(df: DataFrame, flag: str = "to_remove") -> DataFrame:
    """A2: counts of the normalised removal flag, nulls dropped, count descending."""
    v = normalise_label(flag)
    return (df.select(v.alias("value")).filter(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value"))


def sentiment_distribution(df: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """A3: per sentiment column, counts of each stripped value incl. '(vazio)'.

    ``pct`` is the share of retained rows; ``bar`` is ``int(pct / 2)`` blocks.
    """
    cols = [c for c in schema.sentiment_columns if c in df.columns]
    pairs = [(F.lit(c), unicode_strip(F.coalesce(F.col(c), F.lit(EMPTY_DISPLAY)))) for c in cols]
    long = df.select(F.inline(_rows(pairs, ["sentiment_column", "value"])))
    counts = long.groupBy("sentiment_column", "value").agg(F.count(F.lit(1)).alias("n"))
    # every retained row contributes one value per column: the column total is the row count
    total = F.sum("n").over(Window.partitionBy("sentiment_column"))
    pct = F.col("n") * 100.0 / total
    return counts.select("sentiment_column", "value", "n", pct.alias("pct"),
                         bar_text(pct, 2.0).alias("bar"))


def class_counts(df: DataFrame, labels: str | None = "labels",
                 schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """A4/A5: per label count, percent of retained rows (0 if none) and ``int(pct)`` bar.

    One global aggregate (8 sums + row count) then ``inline`` into 8 rows in
    contract order, so labels with zero count are still present.
    """
    if labels is None or labels not in df.columns:
        df = df.withColumn("labels", encode_labels(df.columns, schema))
        labels = "labels"
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.sum(F.get(F.col(labels), i)).cast("bigint").alias(f"c{i}") for i in range(schema.n_labels)]
    wide = df.agg(*aggs)
    pairs = [(F.lit(i), F.lit(lbl), F.col(f"c{i}"), F.col("n_rows"))
             for i, lbl in enumerate(schema.labels)]
    out = wide.select(F.inline(_rows(pairs, ["label_idx", "label", "n", "n_rows"])))
    pct = F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("n_rows")), F.lit(0.0))
    return out.select("label_idx", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                      "n_rows", pct.alias("pct"), bar_text(pct, 1.0).alias("bar"))


def present_labels(counts: DataFrame, position: str = "position") -> DataFrame:
    """Labels with a positive count, in contract order, with their 0-based position.

    ``counts`` has one row per label (k rows), so the unpartitioned window is bounded by k.
    """
    w = Window.orderBy("label_idx")
    return counts.filter(F.col("n") > 0).withColumn(position, (F.row_number().over(w) - 1).cast("int"))


def total_labels(df: DataFrame, labels: str = "labels", schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Sum of all label counts."""
    s = F.aggregate(F.col(labels), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.coalesce(F.sum(s), F.lit(0.0)).cast("bigint").alias("total_labels"))


def imbalance_report(counts: DataFrame) -> DataFrame:
    """Max / smallest-positive ratio and a tier (on the 8-row output of A4).

    Tier: ratio > 10 'severe', > 5 'moderate', else 'ok'; no positive class
    -> 'alert'.  ``n_zero_classes`` reports empty labels separately.
    """
    agg = counts.agg(F.max("n").alias("max_count"),
                     F.min(F.when(F.col("n") > 0, F.col("n"))).alias("min_positive"),
                     F.count_if(F.col("n") == 0).alias("n_zero_classes"))
    ratio = F.try_divide(F.col("max_count").cast("double"), F.col("min_positive").cast("double"))
    tier = (F.when(F.col("min_positive").isNull(), "alert").when(ratio > 10, "severe")
            .when(ratio > 5, "moderate").otherwise("ok"))
    advice = (F.when(tier == "severe", "class weights + focal loss")
              .when(tier == "moderate", "class weights").when(tier == "alert", "classes with 0 examples")
              .otherwise(""))
    return agg.select("max_count", "min_positive", ratio.alias("ratio"), tier.alias("tier"),
                      advice.alias("advice"), "n_zero_classes")


def unlabelled_count(df: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Retained rows whose sentiments are all null."""
    cols = [F.col(c) for c in schema.sentiment_columns if c in df.columns]
    cond = F.coalesce(*cols).isNull() if cols else F.lit(True)
    return df.agg(F.count_if(cond).alias("unlabelled"))


def aspect_coverage(df: DataFrame, lexicon: dict, text: str | None = None,
                    schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """A9 + A10: per aspect, reviews mentioning it and percent of all rows.

    A single aggregate over the regex flags (no explode, no Python).
    """
    hits = aspect_hits(text or text_column(df), lexicon, [a for a in schema.aspects if a in lexicon])
    flags = df.select(*[h.alias(f"tem_{a}") for a, h in hits.items()])
    wide = flags.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.count_if(F.col(f"tem_{a}")).alias(f"c_{a}") for a in hits])
    pairs = [(F.lit(i), F.lit(a), F.col(f"c_{a}"), F.col("n_rows")) for i, a in enumerate(hits)]
    out = wide.select(F.inline(_rows(pairs, ["aspect_idx", "aspect", "n", "n_rows"])))
    return out.select("aspect_idx", "aspect", "n",
                      F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("pct"))


def aspect_presence(df: DataFrame, aspects_col: str = "aspects") -> DataFrame:
    """A10: reviews with at least one aspect and with none."""
    size = F.size(F.col(aspects_col))
    return df.agg(F.count_if(size > 0).alias("with_aspect"), F.count_if(size == 0).alias("without_aspect"))


def score_histogram(df: DataFrame, score: str = "review_score") -> DataFrame:
    """Count by score, sorted by score."""
    return df.groupBy(score).agg(F.count(F.lit(1)).alias("n")).orderBy(score)


def sample_aspect_count(sheet: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA,
                        col: str = "aspectos_detectados") -> DataFrame:
    """Reviews whose joined aspect text contains each aspect name."""
    wide = sheet.agg(*[F.count_if(F.col(col).contains(a)).alias(a) for a in schema.aspects])
    pairs = [(F.lit(i), F.lit(a), F.col(a)) for i, a in enumerate(schema.aspects)]
    return wide.select(F.inline(_rows(pairs, ["aspect_idx", "aspect", "n"])))


def label_state(df: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA, flag: str = "to_remove") -> DataFrame:
    """The labelling tool's record per review: ``struct<categories map, toRemove>``.

    A category is present when its normalised sentiment is one of the UI values;
    it is stored capitalised under the display name.
    """
    entries = []
    for aspect, col in zip(schema.aspects, schema.sentiment_columns):
        v = normalise_label(col) if col in df.columns else F.lit(None).cast("string")
        entries.append(F.when(v.isin(*SENTIMENTS),
                              F.struct(F.lit(schema.category_names[aspect]).alias("key"),
                                       ui_sentiment(v).alias("value"))))
    cats = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    remove = normalise_label(flag).eqNullSafe("sim") if flag in df.columns else F.lit(False)
    return df.select(F.col("review_id").cast("string").alias("review_id"),
                     F.struct(cats.alias("categories"), remove.alias("toRemove")).alias("state"))


def category_count(states: DataFrame, state: str = "state") -> DataFrame:
    """Number of categories with a selection, per review."""
    return states.select("review_id", F.size(F.map_keys(F.col(f"{state}.categories"))).alias("n_categories"))
