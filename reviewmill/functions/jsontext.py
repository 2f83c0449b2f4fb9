"""JSON found inside free text, read through the variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedded_object(content: Column) -> Column:
    """The text from the first ``{`` to the last ``}``; null if there is none."""
    return F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_embedded(content: Column) -> Column:
    """The embedded object as a variant; null if absent or not valid JSON."""
    return F.try_parse_json(embedded_object(content))


def field(variant: Column, name: str) -> Column:
    """A top-level field as a variant; SQL null if the key is absent."""
    return F.try_variant_get(variant, f"$.{name}", "variant")


def is_one(variant: Column, name: str) -> Column:
    """1 if the field equals one (1, 1.0, true), else 0. The string "1" is not one."""
    value = field(variant, name)
    number = F.try_variant_get(variant, f"$.{name}", "double")
    hit = (F.schema_of_variant(value) != "STRING") & (number == 1.0)
    return F.coalesce(hit, F.lit(False)).cast("int")
