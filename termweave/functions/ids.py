"""Identifiers and list values: one spelling for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(raw: Column) -> Column:
    """Trimmed (U+0020), cut at the first point, upper case; null where nothing is left."""
    return F.nullif(F.upper(F.substring_index(F.trim(raw), ".", 1)), F.lit(""))


def term_id(raw: Column) -> Column:
    """Trimmed and in upper case; null where nothing is left."""
    return F.nullif(F.upper(F.trim(raw)), F.lit(""))


def list_values(values: Column) -> Column:
    """The values of a list trimmed and in lower case, without null and empty ones; repeats stay. Null gives []."""
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))


def latin_words(text: Column) -> Column:
    """Maximal runs of three or more letters a-z of the lower-cased text, in order; null gives []."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1))
