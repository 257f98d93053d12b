"""Catalog: sampling queries (W1-W6, W8, J2, U1, U2, P8, A23, X22) on ``b_reviews``."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.operators import reports, sampling
from aspectra.plans import bridge
from aspectra.plans.registry import r6, register
from aspectra.plans.sample_plan import balanced_sample, detect_candidates
from aspectra.plans.sqlbits import B_REVIEWS, B_SCORES, md5key, rx, with_
from aspectra.schema import ASPECTS, DRIVER_LEXICON, QUOTA_ORDER, QUOTAS

LEX = DRIVER_LEXICON

_FLAGS = ", ".join(f"{rx('review_text', LEX[a])} AS tem_{a}" for a in ASPECTS)
CAND = with_(B_REVIEWS) + f"""
, cb AS (SELECT review_id, review_score, review_text, {_FLAGS},
                CASE WHEN review_score IN (1, 2) THEN 'neg' WHEN review_score IN (4, 5) THEN 'pos' END AS band,
                {md5key('review_id', 42)} AS h
         FROM b_reviews WHERE review_text IS NOT NULL AND length(review_text) >= 20)
"""


def _steps_sql() -> str:
    out, prev = [], []
    for k, aspect in enumerate(QUOTA_ORDER, start=1):
        excl = "".join(f" AND review_id NOT IN (SELECT review_id FROM s{j})" for j in prev)
        out.append(f""", s{k} AS (SELECT review_id, review_score, band, {k} AS step, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY band ORDER BY h, review_id) AS rk
    FROM cb WHERE band IS NOT NULL AND tem_{aspect}{excl}) WHERE rk <= {QUOTAS[aspect] // 2})""")
        prev.append(k)
    out.append(", q AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in prev) + ")")
    return "\n".join(out) + "\n"


SAMPLE = CAND + _steps_sql() + f"""
, f AS (SELECT review_id, review_score, CAST(NULL AS VARCHAR) AS band, 5 AS step, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY review_score ORDER BY {md5key('review_id', '42 + review_score')}, review_id) AS rk
    FROM cb WHERE review_id NOT IN (SELECT review_id FROM q) AND review_score BETWEEN 1 AND 5)
  WHERE rk <= (200 - (SELECT count(*) FROM q)) // 5)
, allr AS (SELECT * FROM q UNION ALL SELECT * FROM f)
, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY step, band NULLS FIRST,
                                   review_score, rk) AS first FROM allr) WHERE first = 1)
, cap AS (SELECT * FROM dd ORDER BY {md5key('review_id', 99)}, review_id LIMIT 200)
, fin AS (SELECT *, CAST(row_number() OVER (ORDER BY {md5key('review_id', 123)}, review_id) - 1 AS INTEGER) AS row_index
          FROM cap)
"""


def _sample(spark, sf):
    return balanced_sample(bridge.b_reviews(spark, sf), LEX)


@register("quota_sample", SAMPLE + "SELECT review_id, CAST(step AS INTEGER) AS step, band FROM q")
def q_quota(spark, sf):
    return _sample(spark, sf).quota.select("review_id", F.col("step").cast("int").alias("step"), "band")


@register("fill_to_target", SAMPLE + "SELECT review_id, review_score FROM f")
def q_fill(spark, sf):
    return _sample(spark, sf).fill.select("review_id", "review_score")


@register("concat_samples", SAMPLE + "SELECT review_id, CAST(step AS INTEGER) AS step FROM allr")
def q_concat(spark, sf):
    s = _sample(spark, sf)
    u = sampling.concat_samples([s.quota, s.fill])
    return u.select("review_id", F.col("step").cast("int").alias("step"))


@register("used_ids", SAMPLE + "SELECT DISTINCT review_id FROM q")
def q_used(spark, sf):
    s = _sample(spark, sf)
    return sampling.used_ids([s.quota.filter(F.col("step") == k) for k in range(1, len(QUOTA_ORDER) + 1)])


@register("exclude_used", SAMPLE + "SELECT review_id FROM cb WHERE review_id NOT IN (SELECT review_id FROM q)")
def q_exclude(spark, sf):
    s = _sample(spark, sf)
    return sampling.exclude_used(s.candidates, s.quota, bounded=True).select("review_id")


@register("dedupe_by_id", SAMPLE + "SELECT review_id, CAST(step AS INTEGER) AS step FROM dd")
def q_dedupe(spark, sf):
    return _sample(spark, sf).deduped.select("review_id", F.col("step").cast("int").alias("step"))


@register("shuffle_rows", SAMPLE + "SELECT review_id, row_index FROM fin")
def q_shuffle(spark, sf):
    return _sample(spark, sf).final.select("review_id", "row_index")


def _sheet_sql() -> str:
    names = "list_filter([" + ", ".join(f"CASE WHEN tem_{a} THEN '{a}' END" for a in ASPECTS) + "], lambda x: x IS NOT NULL)"
    return SAMPLE + f""", sheet AS (
  SELECT c.review_id, c.review_score, c.review_text, array_to_string({names}, ', ') AS aspectos_detectados,
         '' AS logistica_sentimento, '' AS produto_sentimento, '' AS atendimento_sentimento, '' AS preco_sentimento,
         'Não' AS to_remove, fin.row_index
  FROM fin JOIN cb c ON c.review_id = fin.review_id)
"""


@register("labelling_sheet", _sheet_sql() + "SELECT * FROM sheet")
def q_sheet(spark, sf):
    return _sample(spark, sf).sheet


@register("sample_aspect_count", _sheet_sql() + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS aspect_idx, '{a}' AS aspect, CAST(count(*) FILTER (WHERE contains(aspectos_detectados, '{a}')) AS BIGINT) AS n FROM sheet"
    for i, a in enumerate(ASPECTS)) + ")")
def q_sample_aspect_count(spark, sf):
    out = reports.sample_aspect_count(_sample(spark, sf).sheet)
    return out.select(F.col("aspect_idx").cast("int").alias("aspect_idx"), "aspect", "n")


@register("score_histogram_sample", _sheet_sql() + "SELECT review_score, CAST(count(*) AS BIGINT) AS n FROM sheet GROUP BY 1")
def q_sample_hist(spark, sf):
    return reports.score_histogram(_sample(spark, sf).sheet)


@register("cap_sample", CAND + f"SELECT review_id FROM cb ORDER BY {md5key('review_id', 99)}, review_id LIMIT 200")
def q_cap(spark, sf):
    c = detect_candidates(bridge.b_reviews(spark, sf), LEX)
    return sampling.cap_sample(c, 200).select("review_id")


@register("stratified_sample", with_(B_REVIEWS) + f"""
SELECT review_id, lang FROM (SELECT review_id, lang,
  row_number() OVER (PARTITION BY lang ORDER BY {md5key('review_id', 42)}, review_id) AS rk FROM b_reviews) WHERE rk <= 25""")
def q_stratified(spark, sf):
    r = bridge.b_reviews(spark, sf).select("review_id", "lang")
    return sampling.stratified_sample(r, ["lang"], 25).select("review_id", "lang")


@register("distinct_pairs", with_(B_SCORES) + """
SELECT DISTINCT review_id, review_score FROM (SELECT * FROM b_scores UNION ALL SELECT * FROM b_scores)""")
def q_distinct_pairs(spark, sf):
    s = bridge.b_scores(spark, sf)
    return sampling.distinct_pairs(s.unionByName(s))


@register("quota_arithmetic", CAND + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS aspect, {QUOTAS[a]} AS quota, {QUOTAS[a]} // 2 AS half,
        CAST(count(*) FILTER (WHERE tem_{a} AND band = 'neg') AS BIGINT) AS n_neg_avail,
        CAST(count(*) FILTER (WHERE tem_{a} AND band = 'pos') AS BIGINT) AS n_pos_avail,
        CAST(least(count(*) FILTER (WHERE tem_{a} AND band = 'neg'), {QUOTAS[a]} // 2) AS BIGINT) AS n_neg,
        CAST(least(count(*) FILTER (WHERE tem_{a} AND band = 'pos'), {QUOTAS[a]} // 2) AS BIGINT) AS n_pos FROM cb"""
    for a in QUOTA_ORDER) + ")")
def q_quota_arithmetic(spark, sf):
    from aspectra.functions.text import int_div
    from aspectra.operators.clean import score_band

    c = detect_candidates(bridge.b_reviews(spark, sf), LEX).withColumn("band", score_band("review_score"))
    aggs = []
    for a in QUOTA_ORDER:
        aggs += [F.count_if(F.col(f"tem_{a}") & (F.col("band") == "neg")).alias(f"{a}_neg"),
                 F.count_if(F.col(f"tem_{a}") & (F.col("band") == "pos")).alias(f"{a}_pos")]
    wide = c.agg(*aggs)
    rows = reports._rows([(F.lit(a), F.lit(QUOTAS[a]), F.col(f"{a}_neg"), F.col(f"{a}_pos")) for a in QUOTA_ORDER],
                         ["aspect", "quota", "n_neg_avail", "n_pos_avail"])
    out = wide.select(F.inline(rows))
    half = int_div(F.col("quota"), F.lit(2))
    return out.select("aspect", "quota", half.alias("half"), "n_neg_avail", "n_pos_avail",
                      F.least("n_neg_avail", half.cast("bigint")).alias("n_neg"),
                      F.least("n_pos_avail", half.cast("bigint")).alias("n_pos"))


__all__ = ["r6"]
