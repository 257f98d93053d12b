"""Array expressions that turn model outputs into labels.

All are JVM built-ins on the row's own array, so scoring needs no shuffle and
no Python.  They are higher-order functions (``transform``, ``zip_with``),
which bind their input once: Spark evaluates them outside whole-stage codegen,
but they compose safely.  Element-by-element forms would be code-generated,
yet each element reads its input again, and when Spark pushes an inferred
filter (e.g. from ``explode``) down through the projections the substituted
expressions multiply -- a composed scorer grew to megabytes of plan text.
``computed`` ends that: its columns come out of a one-row generator, which the
optimizer neither merges into later projections nor copies into filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.schema import DEFAULT_SCHEMA, POLARITY_DEADBAND, AspectSchema


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with ``cols``, each evaluated once per row however often later expressions read it."""
    return df.select(*[c for c in df.columns if c not in cols],
                     F.inline(F.array(F.struct(*[c.alias(name) for name, c in cols.items()]))))


def sigmoid(logits) -> Column:
    """Element-wise logistic; NaN stays NaN (guarded later)."""
    return F.transform(_c(logits), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double"))))


def threshold_array(schema: AspectSchema = DEFAULT_SCHEMA, thresholds: dict | None = None) -> Column:
    """Per-label thresholds in label order; unknown label -> default (J5 as a literal)."""
    thr = dict(schema.thresholds if thresholds is None else thresholds)
    return F.array(*[F.lit(float(thr.get(lbl, schema.default_threshold))) for lbl in schema.labels])


def apply_thresholds(probs, thresholds: Column | None = None) -> Column:
    """1.0 where ``p > t`` (strict), else 0.0; NaN/null never passes."""
    thr = threshold_array() if thresholds is None else thresholds
    return F.zip_with(
        _c(probs), thr,
        lambda p, t: F.when(~F.isnan(p) & (p > t), F.lit(1.0)).otherwise(F.lit(0.0)))


def resolve_conflicts(bits, probs) -> Column:
    """For each aspect pair keep the higher of Pos/Neg when both set; tie -> Neg."""
    b, p = _c(bits), _c(probs)
    # pairs are (2k, 2k+1): the positive bit yields unless it is strictly higher
    return F.transform(b, lambda x, i: F.when(
        (i % 2 == 0) & (x == 1.0) & (F.get(b, i + 1) == 1.0) & ~(F.get(p, i) > F.get(p, i + 1)),
        F.lit(0.0)).when(
        (i % 2 == 1) & (x == 1.0) & (F.get(b, i - 1) == 1.0) & (F.get(p, i - 1) > F.get(p, i)),
        F.lit(0.0)).otherwise(x))


def detected_labels(bits, probs, schema: AspectSchema = DEFAULT_SCHEMA) -> Column:
    """``array<struct<label, score>>`` of set bits, score descending; ties keep label order."""
    names = F.array(*[F.lit(lbl) for lbl in schema.labels])
    scored = F.transform(_c(probs), lambda p, i: F.struct(
        p.alias("score"), (-i).alias("neg_idx"), F.get(names, i).alias("label"),
        F.get(_c(bits), i).alias("bit")))
    kept = F.filter(scored, lambda s: s["bit"] == 1.0)
    ordered = F.sort_array(kept, asc=False)
    return F.transform(ordered, lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))


def top_k_labels(probs, k: int = 3, schema: AspectSchema = DEFAULT_SCHEMA,
                 thresholds: Column | None = None) -> Column:
    """The ``k`` highest labels with their thresholds (fallback display)."""
    names = F.array(*[F.lit(lbl) for lbl in schema.labels])
    thr = threshold_array(schema) if thresholds is None else thresholds
    scored = F.transform(_c(probs), lambda p, i: F.struct(
        p.alias("score"), (-i).alias("neg_idx"), F.get(names, i).alias("label"),
        F.get(thr, i).alias("threshold")))
    top = F.slice(F.sort_array(scored, asc=False), 1, k)
    return F.transform(top, lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score"),
                                               s["threshold"].alias("threshold")))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda acc, v: acc + v))


def cosine_similarity(a, b) -> Column:
    """X11: cosine of two equal-length vectors (0-norm -> null)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def polarity_from_diff(diff, band: float = POLARITY_DEADBAND) -> Column:
    """``diff > band`` Pos, ``< -band`` Neg, otherwise null (no label)."""
    d = _c(diff)
    return F.when(d > band, F.lit("Pos")).when(d < -band, F.lit("Neg"))


def score_polarity(score, fill: int = 3) -> Column:
    """X14 with P10: missing score -> 3; ``score >= 4`` Pos else Neg."""
    return F.when(F.coalesce(_c(score), F.lit(fill)) >= 4, F.lit("Pos")).otherwise(F.lit("Neg"))


def aspect_polarity_vector(aspects, polarity, schema: AspectSchema = DEFAULT_SCHEMA) -> Column:
    """X15/M2 core: for each aspect in ``aspects`` set its Pos or Neg bit by ``polarity``."""
    a, pol = _c(aspects), _c(polarity)
    bits = []
    for asp in schema.aspects:
        has = F.array_contains(a, F.lit(asp))
        bits.append(F.when(has & (pol == "Pos"), 1.0).otherwise(0.0))
        bits.append(F.when(has & (pol == "Neg"), 1.0).otherwise(0.0))
    return F.array(*bits)


def zeros(n: int = 8) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def safe_prediction(pred, n: int = 8) -> Column:
    """Any failure (null / wrong length) -> all-zero prediction."""
    p = _c(pred)
    return F.when(p.isNotNull() & (F.size(p) == n), p).otherwise(zeros(n))
