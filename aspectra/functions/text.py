"""Column -> Column text helpers.  All built-in expressions (stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra.schema import EMBED_MAX_CHARS

# Python's str.strip() removes every Unicode whitespace; Spark's trim only spaces.
_UNICODE_STRIP = r"(?U)^\s+|\s+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unicode_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), _UNICODE_STRIP, "")


def normalise_label(col) -> Column:
    """Strip + lower-case; null stays null."""
    return F.lower(unicode_strip(col))


def text_length(col) -> Column:
    """Length in code points."""
    return F.length(_c(col))


def truncate_chars(col, n: int = EMBED_MAX_CHARS) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(_c(col), 1, n)


def join_aspects(col, sep: str = ", ") -> Column:
    """``', '``-joined aspect names; empty or null array gives ''."""
    return F.coalesce(F.array_join(_c(col), sep), F.lit(""))


def capitalize(col) -> Column:
    """Python ``str.capitalize``: first character upper, rest lower."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def display_name(col) -> Column:
    """``logistica_sentimento`` -> ``LOGISTICA``."""
    return F.upper(F.replace(_c(col), F.lit("_sentimento"), F.lit("")))


def bar_text(pct, divisor: float = 1.0, block: str = "█") -> Column:
    """``block * int(pct / divisor)`` (truncation toward zero)."""
    n = F.floor(_c(pct) / F.lit(float(divisor))).cast("int")
    return F.repeat(F.lit(block), F.greatest(n, F.lit(0)))


def format_percent(frac, digits: int = 1) -> Column:
    """``f'{x:.1%}'`` of a fraction: the exact binary value of 100 x, rounded half to even.

    The value is scaled by a power of two to a whole number (no bit is lost between 2**-8 and 2**17) and
    divided in exact decimals; beyond that range Spark's own formatting is used.
    """
    v = _c(frac) * F.lit(100.0)
    a = F.abs(v)
    bits = F.when(a < 0.125, F.lit(60)).when(a < 128, F.lit(55)).otherwise(F.lit(45))
    whole = (a * F.pow(F.lit(2.0), bits)).cast("bigint").cast("decimal(38,0)")
    unit = F.pow(F.lit(2.0), bits).cast("bigint").cast("decimal(38,0)")
    scaled = (whole * F.lit(10 ** digits)).cast("decimal(38,0)")
    low = F.call_function("div", scaled, unit)
    rest = (scaled - low.cast("decimal(20,0)") * unit).cast("decimal(38,0)") * 2
    n = low + F.when(rest > unit, 1).when(rest < unit, 0).otherwise(low % 2)
    head = F.call_function("div", n, F.lit(10 ** digits)).cast("string")
    tail = F.lpad((n % (10 ** digits)).cast("string"), digits, "0") if digits else F.lit("")
    text = F.concat(F.when((v < 0), "-").otherwise(""), head, F.lit("." if digits else ""), tail, F.lit("%"))
    return F.when(a < 131072.0, text).otherwise(F.format_string(f"%.{digits}f%%", v))


def percent_cell(frac, width: int, digits: int = 1) -> Column:
    """X18 in a report column: the percent text, right-aligned to ``width`` (longer texts stay whole)."""
    text = format_percent(frac, digits)
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def int_div(a, b) -> Column:
    """Python ``//`` for non-negative ints (SQL ``div``, a long)."""
    a, b = (F.lit(x) if isinstance(x, int) else _c(x) for x in (a, b))
    return F.call_function("div", a, b)


def null_text_to_empty(col) -> Column:
    """Text null -> '' (ids are cast to string the same way)."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def sampling_hash(id_col, seed) -> Column:
    """Deterministic per-row sort key for seeded sampling.

    ``md5(id || '|' || seed)``; independent of partitioning, so the same rows are
    drawn on 8 threads and on 1000 executors.  The id is the tie-breaker.
    """
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", _c(id_col).cast("string"), seed_col.cast("string")))


def hash_unit_interval(id_col, seed) -> Column:
    """First 32 bits of :func:`sampling_hash` as a double in [0, 1)."""
    h = sampling_hash(id_col, seed)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)
