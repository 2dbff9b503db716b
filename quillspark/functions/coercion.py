"""Coercion of loosely typed fields to typed ones with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import POLARITIES
from .text import js_round, js_trim, or_null


def finite_or_null(x: Column) -> Column:
    """Null for what is no number, not a number or infinite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def polarity(x: Column) -> Column:
    return F.when(x.isin(*POLARITIES), x).otherwise(F.lit("estimate"))


def status(x: Column) -> Column:
    return F.when(x.isin("pending", "done", "failed", "skipped"), x).otherwise(F.lit("pending"))


def confidence(x: Column) -> Column:
    """Clamped to 0 ... 1; 0.6 where there is none."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.6)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def embedding(array: Column, text: Column) -> Column:
    """From an array, or else from JSON text; elements that are no numbers are dropped."""
    parsed = F.from_json(text, "array<string>")
    numbers = F.transform(parsed, lambda x: x.try_cast("double"))
    return F.filter(F.coalesce(array.cast("array<double>"), numbers), lambda x: x.isNotNull())


def score(value: Column) -> Column:
    """A score of 1 to 10 from VARIANT: missing or unreadable 5, null 1, half up."""
    text = F.try_variant_get(value, "$", "string")
    number = F.when(F.is_variant_null(value), 0.0).when(js_trim(text) == "", 0.0).when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(value.isNotNull() & usable, F.greatest(F.lit(1), F.least(F.lit(10), js_round(number)))).otherwise(F.lit(5)).cast("int")


def trimmed(value: Column, path: str = "$") -> Column:
    """Trimmed text of a VARIANT's string; null for blank text and other kinds."""
    is_text = F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING"
    return F.when(is_text, or_null(js_trim(F.try_variant_get(value, path, "string"))))
