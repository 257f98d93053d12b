"""Balanced labelling sample: clean -> detect -> quotas -> fill -> dedupe -> cap -> shuffle -> sheet.

The regex detection runs once over the reviews: one pass over the narrow candidates
(id, score, flags, content hash) keeps, for every quota and score, the few rows that
any of the five sampling steps can take, and the steps choose among these.  The text
is joined back for the final (at most ``target``) rows only: one more read of
the id and text columns, streamed through a broadcast hash join (no shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.aspects import aspect_hits, detect_aspects
from aspectra.operators import clean, sampling
from aspectra.schema import (ASPECTS, QUOTA_ORDER, QUOTAS, SAMPLE_SEED, SAMPLE_TARGET,
                             WIDE_LEXICON)


@dataclass
class SampleResult:
    candidates: DataFrame   # narrow: id, score, tem_* flags, _rowhash
    quota: DataFrame        # W2 output
    fill: DataFrame         # W3 output
    deduped: DataFrame      # W4 output
    final: DataFrame        # W5 + W6 output with row_index
    sheet: DataFrame        # P8 labelling sheet (with row_index)


def detect_candidates(reviews: DataFrame, lexicon: dict = WIDE_LEXICON, key: str = "review_id",
                      score: str = "review_score", text: str | None = None) -> DataFrame:
    """P2 + P3 + X1/X3 flags, projected to the narrow columns the sampler needs."""
    tc = text or clean.text_column(reviews)
    df = clean.min_text_length(clean.require_text(reviews, tc), tc)
    hits = aspect_hits(tc, lexicon, [a for a in ASPECTS if a in lexicon])
    return df.select(key, score, *[h.alias(f"tem_{a}") for a, h in hits.items()],
                     F.xxhash64(F.col(tc)).alias("_rowhash"))


def balanced_sample(reviews: DataFrame, lexicon: dict = WIDE_LEXICON, key: str = "review_id",
                    score: str = "review_score", text: str | None = None, order=QUOTA_ORDER,
                    quotas: dict = QUOTAS, target: int = SAMPLE_TARGET, seed: int = SAMPLE_SEED) -> SampleResult:
    tc = text or clean.text_column(reviews)
    cand = detect_candidates(reviews, lexicon, key, score, tc)
    quota, fill = sampling.quota_and_fill(cand, key, score, order, quotas, target, seed)
    parts = [quota, fill]
    allrows = sampling.concat_samples(parts)
    deduped = sampling.dedupe_by_id(allrows, key)
    capped = sampling.cap_sample(deduped, target, key)
    final = sampling.shuffle_rows(capped, key)
    # join the text back for the final rows only (bounded by the target size)
    small = final.select(key, F.col(score).alias("_score"), F.col("_rowhash").alias("_want"), "row_index")
    texts = reviews.select(key, score, F.col(tc).alias("review_text"))
    # broadcast hash join on the id (<= target rows on the build side); the text hash that tells
    # duplicate ids apart is computed for the matched rows only, not for every review
    full = (texts.join(F.broadcast(small), key)
            .filter((F.xxhash64(F.col("review_text")) == F.col("_want")) & F.col(score).eqNullSafe(F.col("_score")))
            .drop("_want", "_score"))
    # copies that agree in id, score and text are the same sheet row
    full = full.dropDuplicates([key, "row_index"])
    full = full.withColumn("aspects", detect_aspects("review_text", lexicon))
    sheet = clean.labelling_sheet(full, "aspects", "review_text").join(
        F.broadcast(small.select(key, "row_index").distinct()), key)
    return SampleResult(cand, quota, fill, deduped, final, sheet)
