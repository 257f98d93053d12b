"""Bridge views: the driver tables re-shaped as review tables.

Every view is a projection / derivation over a whole driver table, so its work
grows with the data.  Derived values (scores, sentiments, prediction flips)
come from deterministic column expressions, never from row subsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.functions.labels import encode_labels
from aspectra.functions.scoring import computed, sigmoid
from aspectra.operators.clean import drop_removed
from aspectra.schema import DEFAULT_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def b_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews from ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"),
                    "lang", (F.col("doc_id") % 5 + 1).cast("int").alias("review_score"))


def b_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sheet from ``orders``: 4 sentiments with whitespace/case/null traps."""
    o = table(spark, sf_dir, "orders")
    prio = F.substring("o_orderpriority", 1, 1)
    month = F.month("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("review_id"),
        F.when(F.col("o_orderstatus") == "F", "Positivo")
         .when(F.col("o_orderstatus") == "P", "Negativo").alias("logistica_sentimento"),
        F.when(prio == "1", "Positivo").when(prio == "2", " negativo ")
         .when(prio == "3", "Neutro").alias("produto_sentimento"),
        F.when(F.col("o_totalprice") > 450000, "Positivo")
         .when(F.col("o_totalprice") < 30000, "Negativo").alias("atendimento_sentimento"),
        F.when(month == 1, "Positivo").when(month == 7, "Negativo").alias("preco_sentimento"),
        F.when(F.col("o_orderkey") % 17 == 0, " Sim")
         .when(F.col("o_orderkey") % 19 == 0, F.lit(None).cast("string"))
         .otherwise("Não").alias("to_remove"),
    )


def b_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores side table for the sheet (F4 shape): one score per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("review_id"),
                    (F.col("o_custkey") % 5 + 1).cast("int").alias("review_score"))


def encoded_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``b_sheet`` after P1 with the X5 label vector."""
    s = drop_removed(b_sheet(spark, sf_dir))
    return s.select("review_id", *DEFAULT_SCHEMA.sentiment_columns,
                    encode_labels(s.columns).alias("labels"))


def flip_predictions(labels, review_id) -> F.Column:
    """Deterministic prediction: flip bit i when ``(id + 3 i) % 23 == 0``."""
    rid = F.col(review_id) if isinstance(review_id, str) else review_id
    lab = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(lab, lambda y, i: F.when((rid + 3 * i) % 23 == 0, F.lit(1.0) - y).otherwise(y))


def b_preds_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned truth and prediction arrays per review (wide form)."""
    e = encoded_sheet(spark, sf_dir)
    return e.select("review_id", F.col("labels").alias("y_true"),
                    flip_predictions("labels", "review_id").alias("y_pred"))


LOGIT_SCALE, LOGIT_SHIFT = 4.0, -1.7


def label_logits(vector: str = "embedding", n: int = 8) -> F.Column:
    """``n`` logits of a whole vector: component d counts for logit d mod n; scaled so that labels vary."""
    size = F.coalesce(F.size(vector), F.lit(0))
    mine = lambda i: F.when(size > i, F.sequence(i, size - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(
        mine(i), F.lit(0.0), lambda a, d: a + F.get(F.col(vector), d).cast("double")) * LOGIT_SCALE + LOGIT_SHIFT)


def label_truth(label: str = "label", n: int = 8) -> F.Column:
    """0/1 targets from a class: class k sets label k mod n."""
    return F.array(*[F.when(F.col(label) % n == i, 1.0).otherwise(0.0) for i in range(n)])


def b_probs(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """Probability vectors: sigmoid of logits from all embedding dims."""
    e = table(spark, sf_dir, "embeddings")
    scored = computed(e.select("vec_id", "embedding"), probs=sigmoid(label_logits("embedding", n)))
    return scored.select(F.col("vec_id").alias("review_id"), "probs")


def b_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-epoch evaluation log: run = event type, epoch = day rank, f1 = avg(value)/100."""
    ev = table(spark, sf_dir, "events")
    daily = (ev.groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day"))
             .agg(F.round(F.avg("value") / 100.0, 6).alias("f1_macro")))
    # one row per (run, day): small and bounded by runs x days
    w = Window.partitionBy("run").orderBy("day")
    return daily.select("run", F.dense_rank().over(w).cast("int").alias("epoch"), "f1_macro")


def b_text_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews with text, score, vector and probabilities: documents with an embedding."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    sides = lambda pos, neg: F.when(pos, "Positivo").when(neg, "Negativo")
    j = d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(lab, "doc_id", "left")
    return computed(j, probs=sigmoid(label_logits())).select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("review_score"), "embedding", "probs",
        sides(F.col("doc_id") % 3 == 0, F.col("lang") == "de").alias("logistica_sentimento"),
        sides(F.col("quality") == 1, F.col("quality") == 0).alias("produto_sentimento"),
        sides((F.col("toxic") == 0) & (F.col("quality") == 1), F.col("toxic") == 1).alias("atendimento_sentimento"),
        sides(F.col("n_chars") > 3000, F.col("n_chars") < 600).alias("preco_sentimento"),
        F.when(F.col("doc_id") % 17 == 0, " Sim").otherwise("Não").alias("to_remove"))


def b_label_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored label records (F7 shape) from ``labels``: quality -> Produto, toxic -> Atendimento."""
    lab = table(spark, sf_dir, "labels")
    entries = F.array(
        F.when(F.col("quality") == 1, F.struct(F.lit("Produto").alias("key"), F.lit("Positivo").alias("value")))
         .when(F.col("quality") == 0, F.struct(F.lit("Produto").alias("key"), F.lit("Negativo").alias("value"))),
        F.when(F.col("toxic") == 1, F.struct(F.lit("Atendimento").alias("key"), F.lit("Negativo").alias("value"))))
    cats = F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
    remove = (F.col("quality") == 0) & (F.col("toxic") == 1)
    return lab.select(F.col("doc_id").cast("string").alias("review_id"),
                      F.struct(cats.alias("categories"), F.coalesce(remove, F.lit(False)).alias("toRemove")).alias("state"))
