"""Sources and sinks (S1-S9) and the JVM-side row index.

CSV label sheets hold quoted multi-line text with doubled quotes, so they are
always read with ``multiLine`` and ``escape='"'`` (D9).  Sinks write part files
in parallel; a header is written at the top of each part (Spark's own CSV
convention), so the directory reads back with ``header=True``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.schema import DEFAULT_SCHEMA, KEEP_FLAG, AspectSchema

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType(), True),
    T.StructField("review_score", T.IntegerType(), True),
    T.StructField("review_comment_message", T.StringType(), True),
])

SHEET_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType(), True),
    T.StructField("review_text", T.StringType(), True),
    *[T.StructField(c, T.StringType(), True) for c in DEFAULT_SCHEMA.sentiment_columns],
    T.StructField("to_remove", T.StringType(), True),
])

# pandas' default NA strings (read_csv) that become missing values
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop FileSystem existence check (works for any cluster filesystem)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def resolve_path(spark: SparkSession, paths) -> str:
    """S3: first existing path of an ordered list."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of the paths exist: {paths}")


def _csv_reader(spark: SparkSession, schema: T.StructType | None, mode: str = "FAILFAST"):
    r = (spark.read.option("header", True).option("multiLine", True)
         .option("quote", '"').option("escape", '"').option("mode", mode))
    return r.schema(schema) if schema is not None else r.option("inferSchema", True)


def normalise_na(df: DataFrame, na_values=NA_VALUES, columns=None) -> DataFrame:
    """Configurable NA strings -> null on string columns."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    na = [v for v in na_values if v != ""]
    return df.select(*[F.when(F.col(c).isin(*na), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def read_label_sheet(spark: SparkSession, paths, schema: T.StructType | None = None,
                     na_values=NA_VALUES, mode: str = "FAILFAST") -> DataFrame:
    """S1 (+ S3): labelled sheet CSV with quoted multi-line text (a malformed record fails the read).

    String cells equal to one of ``na_values`` (pandas' default missing-value
    markers such as ``NA`` or ``null``) read as null, as the reference's reader
    does (D8); pass ``na_values=()`` to keep them as text.
    """
    df = _csv_reader(spark, schema, mode).csv(resolve_path(spark, paths))
    return normalise_na(df, na_values) if na_values else df


def read_reviews(spark: SparkSession, paths, fmt: str = "csv", schema: T.StructType | None = REVIEW_SCHEMA,
                 mode: str = "FAILFAST", na_values=NA_VALUES) -> DataFrame:
    """Raw reviews (CSV with the F1 schema, or parquet).

    Quoted multi-line CSV cannot be split inside a file, so each CSV file is
    parsed by one task: at scale keep raw reviews in many files, or in Parquet
    (``fmt="parquet"``, splittable, with column pruning and pushed filters).
    ``mode`` is Spark's CSV parse mode: ``FAILFAST`` (default, as the reference
    errors on a malformed file), ``PERMISSIVE`` or ``DROPMALFORMED``; CSV cells
    equal to one of ``na_values`` read as null (D8).
    """
    path = resolve_path(spark, paths)
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = _csv_reader(spark, schema, mode).csv(path)
    return normalise_na(df, na_values) if na_values else df


def _csv_writer(df: DataFrame, mode: str):
    # Spark's CSV writer trims values by default; labels such as ' negativo ' must survive as written
    return (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_sheet_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Labelling sheet as CSV (standard quoting, quotes doubled)."""
    _csv_writer(df, mode).option("quoteAll", False).csv(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Model comparison table as CSV (model is an ordinary column)."""
    write_sheet_csv(df, path, mode)


def export_columns(df: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA) -> list[str]:
    return ["review_id", "review_text", *schema.sentiment_columns, "to_remove"]


def export_line(schema: AspectSchema = DEFAULT_SCHEMA) -> Column:
    """One export CSV line: id raw, text always quoted with '"' doubled, others raw.

    Every cell is coalesced to '' first: ``concat_ws`` would drop nulls and shift columns.
    """
    cells = [F.coalesce(F.col("review_id").cast("string"), F.lit("")),
             F.concat(F.lit('"'), F.replace(F.coalesce(F.col("review_text"), F.lit("")), F.lit('"'), F.lit('""')),
                      F.lit('"'))]
    cells += [F.coalesce(F.col(c), F.lit("")) for c in schema.sentiment_columns]
    cells.append(F.coalesce(F.col("to_remove"), F.lit(KEEP_FLAG)))
    return F.concat_ws(",", *cells)


def export_header(schema: AspectSchema = DEFAULT_SCHEMA) -> str:
    return ",".join(["review_id", "review_text", *schema.sentiment_columns, "to_remove"])


def write_export_csv(df: DataFrame, path: str, schema: AspectSchema = DEFAULT_SCHEMA, mode: str = "overwrite",
                     exact: bool = False) -> None:
    """S6 sink.

    Default: Spark's parallel CSV writer (fields quoted when needed, quotes
    doubled, header on each part file), which any CSV reader, including
    :func:`read_label_sheet`, reads back to the same values.

    ``exact=True`` writes the byte format of the labelling tool's export (id raw, text always quoted):
    ``path/header`` holds the header line and ``path/lines`` the lines, ordered by id, in part files
    whose names sort in the same order.  Concatenated, header first, they are the tool's file.
    """
    cols = export_columns(df, schema)
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    if not exact:
        _csv_writer(out, mode).option("emptyValue", "").option("lineSep", "\n").csv(path)
        return
    spark = df.sparkSession
    header = spark.createDataFrame([(export_header(schema),)], "value string").coalesce(1)
    header.write.mode(mode).option("lineSep", "\n").text(f"{path}/header")
    (out.select("review_id", export_line(schema).alias("value")).orderBy("review_id", "value").select("value")
     .write.mode(mode).option("lineSep", "\n").text(f"{path}/lines"))


def export_json(df: DataFrame, schema: AspectSchema = DEFAULT_SCHEMA) -> Column:
    """The export record as a JSON object string."""
    return F.to_json(F.struct(*[F.col(c) for c in export_columns(df, schema)]))


def write_export_json(df: DataFrame, path: str, schema: AspectSchema = DEFAULT_SCHEMA, mode: str = "overwrite") -> None:
    """S7 sink: JSON Lines (one object per review)."""
    df.select(*export_columns(df, schema)).write.mode(mode).json(path)


def row_index(df: DataFrame, order: list, index: str = "index") -> DataFrame:
    """0-based position under ``order``, computed JVM-side at any size.

    The sorted frame is tagged with its partition id and in-partition position
    and checkpointed; per-partition counts (one row per partition) give the
    offsets, which are broadcast back.  No single-partition window, no Python.
    """
    # a row hash and the scan position complete the order: equal keys (a copied id holding a third
    # of the rows) then have distinct sort keys, so the range partitioner can split them
    tie = [F.xxhash64(*[F.col(c) for c in df.columns]), F.monotonically_increasing_id()]
    ordered = (df.orderBy(*order, *tie)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # over #partitions rows
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = ordered.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
    return j.withColumn(index, F.col("_off") + F.col("_mid") - F.col("_first")).drop("_pid", "_mid", "_off", "_first")


def write_bucketed(df: DataFrame, name: str, key: str = "review_id", buckets: int = 200, mode: str = "overwrite") -> None:
    """Store a table that is joined on ``key`` job after job (J1, J4): bucketed and sorted by it.

    Tables with the same number of buckets then join without a shuffle; so does :func:`~aspectra.operators.joins.attach_scores`,
    whose distinct pairs are grouped by the same key.
    """
    df.repartition(buckets, F.col(key)).write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


#: files whose offsets are broadcast (a path and two numbers each)
BROADCAST_FILES = 100_000


def has_file_positions(df: DataFrame) -> bool:
    """Whether ``df`` reads files that know the position of each row (Parquet)."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def file_row_index(df: DataFrame, index: str = "index") -> DataFrame:
    """W15 in file order: 0-based position over all files of a Parquet read, files in the order of their paths.

    The scan itself knows each row's place in its file; the rows per file, a few numbers, give the files'
    offsets.  No row is sorted, and up to ``BROADCAST_FILES`` files none is shuffled either (beyond,
    offsets are joined by path).  ``df`` is the read, with columns chosen but no rows filtered.
    """
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = df.select("*", path.alias("_file"), place.alias("_place"))
    sizes = df.select(path.alias("_file"), place.alias("_place")).groupBy("_file").agg((F.max("_place") + 1).alias("_n"))
    w = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # over #files rows
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    if len(df.inputFiles()) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "_file").withColumn(index, F.col("_before") + F.col("_place")).drop("_file", "_place", "_before")


def labelling_feed(df: DataFrame, key: str = "review_id", text: str = "review_text",
                   order: list | None = None) -> DataFrame:
    """The annotators' task feed ``{"id", "text", "index"}`` as JSON per row.

    ``index`` is the position in file order where the source knows it, else (or with ``order``) under ``order``,
    by default the id.
    """
    base = df.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.col(key).alias("_k"))
    if order is None and has_file_positions(base):
        idx = file_row_index(base.drop("_k"))
    else:
        idx = row_index(base, order or ["_k"], "index")
    return idx.select("id", "index", F.to_json(F.struct("id", "text", "index")).alias("json"))
