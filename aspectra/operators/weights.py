"""Class weights and focal loss.

Both reduce the data to one aggregate row (counts / per-label loss sums) in a
single pass; the per-label arithmetic then runs on 8 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.operators.reports import _rows
from aspectra.schema import DEFAULT_SCHEMA, FOCAL_GAMMA, AspectSchema


def class_weights(df: DataFrame, labels: str = "labels", schema: AspectSchema = DEFAULT_SCHEMA) -> DataFrame:
    """``w_i = sqrt(N / (count_i + 1))``, divided by the smallest weight.

    N is the number of rows given (the trainable rows).
    """
    k = schema.n_labels
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.coalesce(F.sum(F.get(F.col(labels), i)), F.lit(0.0)).alias(f"c{i}") for i in range(k)])
    pairs = [(F.lit(i), F.lit(lbl), F.col(f"c{i}").cast("bigint"), F.col("n_rows"))
             for i, lbl in enumerate(schema.labels)]
    rows = wide.select(F.inline(_rows(pairs, ["label_idx", "label", "n", "n_rows"])))
    raw = F.sqrt(F.col("n_rows") / (F.col("n") + F.lit(1.0)))
    # unpartitioned window over exactly k rows
    w = Window.partitionBy()
    return (rows.withColumn("raw", raw)
            .select("label_idx", "label", "n", "n_rows", (F.col("raw") / F.min("raw").over(w)).alias("weight")))


def weights_array(weights: DataFrame) -> DataFrame:
    """The k weights as one ordered array (a one-row frame)."""
    return weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("label_idx", "weight"))),
                                   lambda s: s["weight"]).alias("alpha"))


def focal_loss(df: DataFrame, logits: str = "logits", targets: str = "targets",
               gamma: float = FOCAL_GAMMA, k: int = 8) -> DataFrame:
    """Mean over rows and labels of ``alpha_i (1 - p_t)^gamma BCE(logit, y)``.

    ``alpha`` are the A11 weights of ``targets`` over the same rows, so the loss is
    ``sum_i alpha_i S_i / (k N)`` with ``S_i`` the per-label loss sums: one pass
    yields both the counts (for alpha) and ``S_i``; no join back to the rows.
    """
    lg, tg = F.col(logits), F.col(targets)

    def term(i):
        x = F.get(lg, i).cast("double")
        y = F.get(tg, i).cast("double")
        bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
        p_t = p * y + (F.lit(1.0) - p) * (F.lit(1.0) - y)
        return F.pow(F.lit(1.0) - p_t, F.lit(gamma)) * bce

    wide = df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.coalesce(F.sum(F.get(tg, i)), F.lit(0.0)).alias(f"c{i}") for i in range(k)],
                  *[F.coalesce(F.sum(term(i)), F.lit(0.0)).alias(f"s{i}") for i in range(k)])
    raw = [F.sqrt(F.col("n_rows") / (F.col(f"c{i}") + F.lit(1.0))) for i in range(k)]
    min_raw = F.least(*raw)
    total = sum((raw[i] / min_raw) * F.col(f"s{i}") for i in range(k))
    return wide.select("n_rows", F.try_divide(total, F.col("n_rows") * F.lit(float(k))).alias("focal_loss"))
