"""Label encoding and label-state helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra.functions.text import capitalize, normalise_label
from aspectra.schema import DEFAULT_SCHEMA, AspectSchema

LABEL_STATE_TYPE = T.StructType([
    T.StructField("categories", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("toRemove", T.BooleanType(), True),
])


def encode_labels(columns: list[str], schema: AspectSchema = DEFAULT_SCHEMA) -> Column:
    """Four sentiment columns -> 8-element 0/1 double array in label order.

    Only ``positivo``/``negativo`` (after strip+lower) set a bit; Neutro, empty,
    null, unknown and absent columns give zeros.
    """
    present = set(columns)
    bits = []
    for col in schema.sentiment_columns:
        if col in present:
            norm = normalise_label(col)
            bits.append(F.when(norm == "positivo", 1.0).otherwise(0.0))
            bits.append(F.when(norm == "negativo", 1.0).otherwise(0.0))
        else:
            bits.extend([F.lit(0.0), F.lit(0.0)])
    return F.array(*bits)


def label_bit(arr, i: int) -> Column:
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.get(c, i)


def label_polarity(label) -> Column:
    """``Pos``/``Neg`` from the label suffix."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.endswith("_Pos"), "Pos").when(c.endswith("_Neg"), "Neg")


def parse_label_state(json_col) -> Column:
    """Label-state JSON -> struct<categories: map, toRemove: bool>."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.from_json(c, LABEL_STATE_TYPE)


def label_variant(json_col) -> Column:
    """X20 for stores with keys that no schema names: label-state JSON as VARIANT; null where it is no JSON."""
    c = F.col(json_col) if isinstance(json_col, str) else json_col
    return F.try_parse_json(c)


def variant_field(variant, path: str, kind: str) -> Column:
    """One field of a VARIANT by path, null where it is absent or of another kind."""
    c = F.col(variant) if isinstance(variant, str) else variant
    return F.try_variant_get(c, path, kind)


def category_key(display, schema: AspectSchema = DEFAULT_SCHEMA) -> Column:
    """Display category name -> aspect key (``Logística`` -> ``logistica``)."""
    pairs = []
    for key, name in schema.category_names.items():
        pairs += [F.lit(name), F.lit(key)]
    c = F.col(display) if isinstance(display, str) else display
    return F.element_at(F.create_map(*pairs), c)


def restore_sentiment(stored) -> Column:
    """Stored capitalised sentiment -> lower-case radio value if valid, else null."""
    low = F.lower(F.col(stored) if isinstance(stored, str) else stored)
    return F.when(low.isin("positivo", "negativo", "neutro"), low)


def ui_sentiment(value) -> Column:
    """Sentiment as the labelling tool stores it: first letter upper-cased."""
    c = F.col(value) if isinstance(value, str) else value
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


__all__ = ["encode_labels", "label_bit", "label_polarity", "label_variant", "parse_label_state", "variant_field", "category_key",
           "restore_sentiment", "ui_sentiment", "capitalize", "LABEL_STATE_TYPE"]
