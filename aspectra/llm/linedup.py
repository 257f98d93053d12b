"""Operator 8: repeated line runs by a suffix array over line-ID sequences, in DataFrame expressions only.

The lines of all documents that are not blank form sequences of line ids (a 64-bit hash of the line
with single spaces).  Distributed prefix doubling ranks the suffixes: round k gives every suffix the
rank of its first 2**k lines, from the pairs of ranks at distance 2**(k-1), which are counted (partial
counts first), sorted globally and numbered in order.  Suffixes whose prefix occurs once have left
the race; so only repeated lines are carried.  Suffixes of equal rank form an interval of the suffix
array whose longest common prefix is at least 2**k lines; two overlapping ranks name the interval of
any depth between powers of two.

A run counts if it has at least ``min_words`` words.  For every suffix the shallowest depth that
reaches ``min_words`` (and for every line the shallowest depth that ends there) names an interval; all
its members but the first, by document and line, are later copies.  Their lines together are exactly
the lines of maximal repeated runs of at least ``min_words`` words that occurred before, and are
deleted.  Depths are at most ``min_words`` lines, which bounds the rounds.

Defined results: null texts stay null, empty ones empty; blank lines do not count and go only inside a
deleted run; documents are ordered by ``doc_id``, then a hash of the text; rows that agree in both are
one document; rows without ``doc_id`` are left alone; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
_DOC = ["doc_id", "mark"]


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, pos, line_no, r0, words, before)``: lines that are not blank; ``before``: words before."""
    rows = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    clean = F.trim(F.regexp_replace("line", GAP, " "))
    rows = (rows.select(*_DOC, "line_no", clean.alias("line")).filter("line <> ''")
            .select(*_DOC, "line_no", F.xxhash64("line").alias("r0"),
                    (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("words"))
            .repartition(*_DOC).dropDuplicates([*_DOC, "line_no"]))
    w = Window.partitionBy(*_DOC).orderBy("line_no")
    return rows.select("*", (F.row_number().over(w) - 1).alias("pos"), F.coalesce(
        F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def prefix_ranks(rows: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """``rows`` whose line is repeated, with ranks ``r0 .. rK`` of prefixes of 1 .. 2**K lines (null: unique)."""
    often = rows.groupBy("r0").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("r0")
    ranked, k = written(rows.join(often, "r0"), "ranks"), 0
    while 2 << k <= longest:
        step = 1 << k
        ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(step, step)
        pairs = ranked.withColumn("_next", F.first(f"r{k}").over(ahead))
        names = (pairs.filter(F.col(f"r{k}").isNotNull() & F.col("_next").isNotNull())
                 .groupBy(f"r{k}", "_next").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
                 .orderBy(f"r{k}", "_next").select(f"r{k}", "_next", F.monotonically_increasing_id().alias(f"r{k + 1}")))
        names = written(names, "names")
        if names.isEmpty():
            break
        ranked, k = written(pairs.join(names, [f"r{k}", "_next"], "left").drop("_next"), "ranks"), k + 1
    return ranked, k


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, mark, ranges)``: the line ranges (first, last) to delete, apart from each other."""
    rows = written(lines(docs), "lines")
    ranked, top = prefix_ranks(rows, min_words)
    at = Window.partitionBy(*_DOC)
    after = F.col("before") + F.col("words")
    line = F.struct("pos", "line_no")
    # the line that completes min_words words from here, and the one from which they are complete here
    ends = at.orderBy("before").rangeBetween(Window.currentRow, min_words - 1)
    starts = at.orderBy(after).rangeBetween(-(min_words - 1), Window.currentRow)
    spans = rows.select(*_DOC, line.alias("here"), F.max(line).over(ends).alias("to"), F.min(line).over(starts).alias("from"),
                        F.min("before").over(starts).alias("_from_before"), F.max(after).over(ends).alias("_to_after"),
                        "before", after.alias("after"))
    spans = spans.select(*_DOC, F.explode(F.array(
        F.when(F.col("_to_after") - F.col("before") >= min_words, F.struct(F.col("here").alias("a"), F.col("to").alias("b"))),
        F.when(F.col("after") - F.col("_from_before") >= min_words, F.struct(F.col("from").alias("a"), F.col("here").alias("b")))
    )).alias("s")).filter("s is not null").select(*_DOC, "s.a", "s.b").distinct()
    depth = F.col("b.pos") - F.col("a.pos") + 1
    level = F.floor(F.log2(depth + F.lit(0.5))).cast("int")
    spans = spans.withColumn("depth", depth).withColumn("level", level).filter(F.col("level") <= top).select(
        *_DOC, "a", "b", "depth", "level", F.col("a.pos").alias("_p"),
        (F.col("b.pos") + 1 - F.expr("shiftleft(1, level)")).alias("_q"))
    side = ranked.select(*_DOC, "pos", F.array(*[F.col(f"r{k}") for k in range(top + 1)]).alias("_r"))
    for place, name in (("_p", "_first"), ("_q", "_last")):
        spans = spans.join(side.withColumnRenamed("pos", place), [*_DOC, place])
        spans = spans.withColumn(name, F.element_at("_r", F.col("level") + 1)).filter(F.col(name).isNotNull()).drop("_r")
    spans = written(spans, "spans")
    key = ["depth", "_first", "_last"]
    where = F.struct("doc_id", "mark", F.col("a.pos").alias("pos"))
    intervals = (spans.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"), F.min(where).alias("_head"))
                 .filter("_c > 1").drop("_c"))
    later = spans.join(intervals, key).filter(where > F.col("_head")).select(
        *_DOC, F.col("a.line_no").alias("a"), F.col("b.line_no").alias("b"))
    in_order = Window.partitionBy(*_DOC).orderBy("a", "b")
    island = F.sum(F.when(F.col("a") > F.col("_reach"), 1).otherwise(0)).over(in_order)
    merged = (later.withColumn("_reach", F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("_island", island).groupBy(*_DOC, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    return merged.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text)`` for every row of ``docs``, later copies of runs deleted."""
    found = repeated_runs(docs, min_words)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    kept = F.filter("_l", lambda l, i: ~F.exists("ranges", lambda r: (r["a"] <= i) & (i <= r["b"])))
    removed = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"] + 1)
    return (mine.join(found, _DOC, "left").withColumn("_l", F.split("text", "\n"))
            .select("doc_id", F.coalesce(F.size("_l"), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(removed, F.lit(0)).alias("n_removed"),
                    F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")))


#: the same runs and texts with plain SQL: windows named by their lines instead of ranks
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(l[i], '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs WHERE doc_id IS NOT NULL)),
counted AS (
  SELECT doc_id, line_no, line, length(line) - length(replace(line, ' ', '')) + 1 AS words
  FROM lines WHERE line <> ''),
placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line_no) - words AS before,
         sum(words) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM counted),
windows AS (
  SELECT doc_id, line_no AS a, max(line_no) OVER e AS b, string_agg(line, chr(10)) OVER e AS name
  FROM placed
  WINDOW e AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  QUALIFY max(after) OVER e - before >= 50
  UNION
  SELECT doc_id, min(line_no) OVER s AS a, line_no AS b, string_agg(line, chr(10)) OVER s AS name
  FROM placed
  WINDOW s AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
  QUALIFY after - min(before) OVER s >= 50),
later AS (
  SELECT doc_id, a, b FROM windows
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line_no FROM later),
per_doc AS (SELECT doc_id, count(*) AS n_removed, list(line_no) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN n_removed IS NULL THEN text ELSE array_to_string(
         [x FOR x, i IN l IF NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM docs d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""
