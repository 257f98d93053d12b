"""Operator 4: secrets in texts, by patterns and by character Markov models, in DataFrame expressions only.

Three patterns find the base spans, leftmost and without overlap for each kind: assignments to a name
like ``password`` or ``api_key``, access keys, and long hexadecimal runs.  The method adds spans of
kind ``markov``: runs of 20 and more key characters, outside all base spans, that a Markov model of
random strings finds likelier than one of ordinary identifiers.

Both models count transitions between characters (with one start state), smoothed by one half.  They
are trained from labelled samples of this corpus: random strings are the values of base spans, and
digests of document ids in hexadecimal and base64; ordinary identifiers are the words of 6 and more
letters, digits and underscores that lie outside base spans.  The sample is at most about
``SAMPLE_ROWS`` documents without and as many with base spans, chosen by a hash of id and text; the
model is a table of at most 68 * 68 ratios.  All documents are scanned.  A candidate is a secret if
its mean log-likelihood ratio per character is at least ``MEAN_RATIO`` and its sum ``SUM_RATIO``.

Positions are code points, end exclusive.  Found strings become rows, so a text with very many of
them is no single large value; a text's spans meet again only to be listed.

Defined results: null and empty texts have no spans (``base_sha256`` is the digest of the empty
string); rows that agree in ``doc_id`` and text have the same spans; without any document to sample
the models are uniform and add nothing; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.tables import written

# fixed values: the patterns of the base spans
NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
#: kind, pattern, the part (a group) that must not be shorter than the minimum, minimum
KINDS = (("assign", NAME + VALUE, f"^{NAME}({VALUE})", 8), ("access", "AKIA[A-Z0-9]{12,}", "(.*)", 16),
         ("hex", "[0-9a-f]{32,}", "(.*)", 32))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{5,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: start, or any other character
SAMPLE_ROWS = 4_000
MEAN_RATIO, SUM_RATIO = 0.7, 20.0
_ROW = ["doc_id", "mark"]


def matches(docs: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """``(doc_id, mark, kind, start, end, found)``: all matches of each pattern, leftmost first.

    ``docs (doc_id, mark, text)``.  The pieces between the matches give their positions.
    """
    found = [F.when(F.col("text").rlike(p), F.struct(
        F.lit(k).alias("kind"), F.transform(F.split("text", p, -1), lambda x: F.length(x)).alias("gaps"),
        F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("found"))) for k, p in kinds]
    rows = docs.select(*_ROW, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_m"))
    rows = rows.select(*_ROW, "_m.kind", F.posexplode(F.arrays_zip("_m.gaps", "_m.found")).alias("_i", "_x"))
    rows = rows.select(*_ROW, "kind", "_i", F.col("_x.gaps").cast("long").alias("_gap"), F.col("_x.found").alias("found"))
    # rows that agree in id and text give the same rows here
    rows = rows.filter("found is not null").dropDuplicates([*_ROW, "kind", "_i"])
    so_far = Window.partitionBy(*_ROW, "kind").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("_gap") + F.length("found")).over(so_far)
    return rows.withColumn("end", end).select(*_ROW, "kind", (F.col("end") - F.length("found")).alias("start"), "end", "found")


def base_spans(found: DataFrame) -> DataFrame:
    """The matches of the three patterns that are long enough; ``secret`` is the part that counts."""
    value = F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("found", inner, 1)) for k, _, inner, _ in KINDS])
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, _, _, n in KINDS])
    return found.withColumn("secret", value).filter(F.length("secret") >= least).drop("found")


# pairs of states, from * STATES + to, along the string s; what is not in the alphabet is state 0
_CODES = f"transform(filter(split(s, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))"
_PAIRS = f"transform(codes, (c, i) -> if(i = 0, 0, codes[i - 1]) * {STATES} + c)"


def transitions(strings: DataFrame) -> dict[int, int]:
    """How often each state pair occurs in ``strings (s)``: at most STATES ** 2 numbers."""
    rows = strings.select("s").selectExpr(f"{_CODES} AS codes").selectExpr(f"explode({_PAIRS}) AS pair")
    return {r["pair"]: r["n"] for r in rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}


def log_probabilities(counts: dict[int, int]) -> list[float]:
    """The smoothed log probability of every transition."""
    out = []
    for a in range(STATES):
        row = [counts.get(a * STATES + b, 0) + 0.5 for b in range(STATES)]
        out += [math.log(x / sum(row)) for x in row]
    return out


def _sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of ``by``."""
    share = min(1.0, rows / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))


def train(docs: DataFrame, base: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """The log-likelihood ratio, random to ordinary, of every transition."""
    values = _sample(base.select(F.col("secret").alias("s")).distinct(), sample_rows, "s")
    some = _sample(docs.filter("text is not null"), sample_rows, "doc_id", "mark")
    sha = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "mark"), 256)
    digests = some.select(F.explode(F.array(F.substring(sha, 1, 40), F.upper(F.substring(sha, 5, 40)),
                                            F.base64(F.unhex(sha)))).alias("s"))
    words = (some.join(base.select(*_ROW).distinct(), _ROW, "left_anti")
             .select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("s")))
    random, ordinary = (log_probabilities(transitions(x)) for x in (values.union(digests), words))
    return [a - b for a, b in zip(random, ordinary)]


def markov_spans(candidates: DataFrame, base: DataFrame, ratios: list[float]) -> DataFrame:
    """Candidates outside all base spans that the model of random strings explains better."""
    ratio = F.aggregate(F.expr(_PAIRS), F.lit(0.0), lambda x, p: x + F.col("ratios")[p])
    scored = (candidates.withColumnRenamed("found", "s").withColumn("codes", F.expr(_CODES))
              .withColumn("ratios", F.lit(ratios)).withColumn("ratio", ratio)
              .filter((F.col("ratio") >= SUM_RATIO) & (F.col("ratio") >= MEAN_RATIO * F.size("codes"))))
    every = scored.select(*_ROW, "kind", "start", "end").union(base.select(*_ROW, "kind", "start", "end"))
    w = Window.partitionBy(*_ROW).orderBy("start")
    is_base = F.col("kind") != "markov"
    reach = F.max(F.when(is_base, F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(is_base, F.col("start"))).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return (every.withColumn("_reach", reach).withColumn("_next", after).filter("kind = 'markov'")
            .filter("coalesce(_reach <= start, true) and coalesce(_next >= end, true)").drop("_reach", "_next"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans)`` for every row of ``docs``."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    found = written(matches(mine, [*((k, p) for k, p, _, _ in KINDS), ("markov", CANDIDATE)]), "matches")
    base = base_spans(found.filter("kind <> 'markov'"))
    spans = base.select(*_ROW, "kind", "start", "end").union(
        markov_spans(found.filter("kind = 'markov'"), base, train(mine, base)))
    order = F.array_position(F.lit([k for k, *_ in KINDS] + ["markov"]), F.col("kind"))
    listed = spans.groupBy(*_ROW).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, *_ in KINDS], F.count_if(F.col("kind") == "markov").alias("n_markov"),
        F.sort_array(F.collect_list(F.struct("start", order.alias("o"), F.concat_ws(
            ":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("t")))).alias("_all"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), ",")
    ours = F.coalesce(joined(F.filter("_all", lambda x: x["o"] <= len(KINDS))), F.lit(""))
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.mark") == F.col("s.mark"))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")]
    return mine.select("doc_id", "mark").alias("d").join(listed.alias("s"), same, "left").select(
        "d.doc_id", *counts, F.sha2(ours, 256).alias("base_sha256"), F.coalesce(joined("_all"), F.lit("")).alias("spans"))
