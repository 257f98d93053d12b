"""Structured Streaming jobs.

T1 applies the same stateless scoring expressions as the batch path to a file
stream.  T2 keeps the latest label record per key, with removals and delete-all:
a streaming ``max_by`` aggregation (Spark's state store, checkpointed) emits
updated keys, each batch of them is written to a folder of its own, so a
replayed batch rewrites the same folder, and every few batches the folders are
merged into one.  J3 counts the labelled ids while labels arrive.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.session import drop_path
from aspectra.sources.io import path_exists


def latest_by_key(df: DataFrame, key: str, order: list[str], value_cols: list[str] | None = None) -> DataFrame:
    """T2 (batch): the row with the greatest ``order`` tuple per key (ties broken by later columns).

    ``max_by`` is a partial aggregate: each map task keeps one row per key, so a
    key holding a third of the data costs no more than any other.
    """
    cols = value_cols or [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in cols])


def file_stream(spark: SparkSession, source: str, schema: T.StructType, fmt: str = "parquet",
                options: dict | None = None) -> DataFrame:
    """A file-stream source over a directory, or over one file (its folder + a glob filter)."""
    reader = spark.readStream.schema(schema).format(fmt).options(**(options or {}))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).load(p.getParent().toString())
    return reader.load(source)


def run_available_now(query_builder, await_seconds: int | None = None):
    q = query_builder.trigger(availableNow=True).start()
    if q.awaitTermination(await_seconds) is False:
        q.stop()
        raise TimeoutError(f"the stream did not end within {await_seconds} seconds")
    return q


def stream_score(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
                 sink: str, checkpoint: str, fmt: str = "parquet", skip_blank: Column | None = None,
                 options: dict | None = None):
    """File stream -> stateless scoring -> file sink (availableNow trigger).

    ``transform`` is the same DataFrame function used on batch tables, so the
    stream result equals the batch result on the same input.
    """
    src = file_stream(spark, source, schema, fmt, options)
    if skip_blank is not None:
        src = src.filter(skip_blank)
    out = transform(src)
    w = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    return run_available_now(w)


CLEAR_KEY = "_clear"


def _marked(df: DataFrame, key: str, deleted: Column | None, cleared: Column | None) -> DataFrame:
    """Events with their key as text, ``_deleted`` for removals; delete-all events share one key of their own."""
    clear = F.coalesce(cleared, F.lit(False)) if cleared is not None else F.lit(False)
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    named = F.when(clear, F.lit(CLEAR_KEY)).otherwise(F.concat(F.lit("k:"), F.col(key).cast("string")))
    return df.withColumn("_name", named).withColumn("_deleted", gone).filter("_name is not null")


def _live(state: DataFrame, order: list[str]) -> DataFrame:
    """The records that are neither removed nor older than the last delete-all."""
    at = F.struct(*[F.col(c) for c in order])
    last = state.filter(F.col("_name") == CLEAR_KEY).agg(F.max(at).alias("at")).scalar()
    rows = state.filter((F.col("_name") != CLEAR_KEY) & ~F.col("_deleted"))
    return rows.withColumn("_last", last).filter(F.col("_last").isNull() | (at > F.col("_last"))).drop("_name", "_deleted", "_last")


def latest_state(df: DataFrame, key: str, order: list[str], value_cols: list[str], deleted: Column | None = None,
                 cleared: Column | None = None) -> DataFrame:
    """T2 (batch) with removals: the latest record per key, unless it is a removal or older than the last delete-all.

    ``deleted`` and ``cleared`` are conditions on an event; events without a key are ignored unless they clear.
    """
    kept = list(dict.fromkeys([key, *value_cols, *order]))
    return _live(latest_by_key(_marked(df, key, deleted, cleared), "_name", order, [*kept, "_deleted"]), order).select(key, *value_cols)


def _folders(spark: SparkSession, path: str) -> list[str]:
    if not path_exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
                  if f.isDirectory())


def state_paths(spark: SparkSession, state_path: str) -> list[str]:
    """The folders that hold the state: of each query the newest merged one that is complete, and the batches after it."""
    out = []
    for query in _folders(spark, state_path):
        names = _folders(spark, f"{state_path}/{query}")
        merged = [n for n in names if "-" in n and path_exists(spark, f"{state_path}/{query}/{n}/_SUCCESS")]
        newest = max(merged, default="")
        out += [f"{state_path}/{query}/{n}" for n in names if n == newest or ("-" not in n and n > newest[:12])]
    return out


def read_state(spark: SparkSession, state_path: str, schema: T.StructType, key: str, order: list[str]) -> DataFrame:
    """The current records ``schema``: the latest of each key over all folders, without removed ones (empty without any)."""
    paths = state_paths(spark, state_path)
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(*paths)
    return _live(latest_by_key(rows, "_name", order, [c for c in rows.columns if c != "_name"]), order).select(*schema.fieldNames())


def stream_latest_state(spark: SparkSession, source: str, schema: T.StructType, key: str, order: list[str],
                        value_cols: list[str], state_path: str, checkpoint: str, fmt: str = "parquet",
                        options: dict | None = None, deleted: Column | None = None, cleared: Column | None = None,
                        merge_every: int = 16) -> DataFrame:
    """T2 (stream): keyed latest record, with re-labels, removals and delete-all in one running query.

    The streaming ``max_by`` aggregate (state in the checkpointed state store) emits, per micro-batch,
    the keys that changed with their latest record; a removal is a record of its own, and delete-all events
    share one key.  Each batch is written to a folder named by the checkpoint (a new checkpoint is a new
    query) and the batch: a replayed batch rewrites the same folder, and no query overwrites what another
    has written.  After every ``merge_every`` batches the query's folders are merged into a new one, of
    one record per key, and the old ones go; a read takes the newest complete merged folder and the
    batches after it, so its cost is bounded by the number of keys.

    There is no watermark: a label may change at any time, so the state store keeps one row per key --
    its size is the number of labelled reviews, not the number of events.
    """
    kept = list(dict.fromkeys([key, *value_cols, *order]))
    agg = latest_by_key(_marked(file_stream(spark, source, schema, fmt, options), key, deleted, cleared), "_name", order, [*kept, "_deleted"])
    own = f"{state_path}/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{own}/{batch_id:012d}")
        if (batch_id + 1) % merge_every == 0:
            merge_state(batch.sparkSession, own, agg.schema, order, batch_id)

    w = agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    run_available_now(w)
    return read_state(spark, state_path, T.StructType([agg.schema[c] for c in (key, *value_cols)]), key, order)


def merge_state(spark: SparkSession, own: str, schema: T.StructType, order: list[str], batch_id: int) -> None:
    """One folder with the latest record of each key up to ``batch_id``; the folders it replaces are deleted after it is complete."""
    parent, query = own.rsplit("/", 1)
    paths = [p for p in state_paths(spark, parent) if p.startswith(f"{own}/") and p.rsplit("/", 1)[1][:12] <= f"{batch_id:012d}"]
    rows = spark.read.schema(schema).parquet(*paths)
    name = f"{batch_id:012d}-{uuid.uuid4().hex}"
    latest_by_key(rows, "_name", order, [c for c in schema.fieldNames() if c != "_name"]).select(*schema.fieldNames()).write.parquet(f"{own}/{name}")
    for n in _folders(spark, own):
        if n != name and n[:12] <= f"{batch_id:012d}":
            drop_path(spark, f"{own}/{n}")


def stream_progress(spark: SparkSession, source: str, schema: T.StructType, key: str, dataset: DataFrame, sink: str,
                    checkpoint: str, fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """J3 while labels arrive: per micro-batch ``(batch, new, labelled, total, pct)``.

    The stream of label records is semi-joined with the ids of the dataset; ``dropDuplicates`` keeps the ids
    seen so far in the state store, so a batch counts the ids that are labelled for the first time.
    """
    ids = dataset.select(key).distinct()
    first = file_stream(spark, source, schema, fmt, options).select(key).join(ids, key, "left_semi").dropDuplicates([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.agg(F.count(F.lit(1)).alias("new")).select(F.lit(batch_id).cast("long").alias("batch"), "new")
         .write.mode("overwrite").parquet(f"{sink}/{batch_id:012d}"))

    run_available_now(first.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write))
    done = _folders(spark, sink)
    rows = spark.read.schema("batch long, new long").parquet(*[f"{sink}/{n}" for n in done]) if done else spark.createDataFrame([], "batch long, new long")
    total = dataset.agg(F.count(F.lit(1)).alias("n")).scalar()
    so_far = F.sum("new").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))  # over #batches rows
    counted = rows.select("batch", "new", so_far.alias("labelled"), total.alias("total"))
    pct = F.least(F.coalesce(F.try_divide(F.col("labelled") * 100.0, F.col("total")), F.lit(0.0)), F.lit(100.0))
    return counted.withColumn("pct", pct)


__all__ = ["file_stream", "latest_by_key", "latest_state", "path_exists", "read_state", "stream_latest_state", "stream_progress",
           "stream_score"]
