"""Extracted drafts: normalising, repairing, and turning into events."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import (
    ATTRIBUTE_LADDER,
    CHUNK_CHARS,
    CHUNK_OVERLAP,
    DEMOTED_CONFIDENCE,
    DERIVED_PHRASES,
    HOLLOW_ATTRIBUTES,
    PRONOUN_CLAIM,
    ROLE_WORDS,
    SKIP_MIN_CHARS,
    UNSPECIFIED_ATTRIBUTE,
)
from ..functions.coercion import confidence, finite_or_null, polarity
from ..functions.text import collapse, iso, js_trim, or_null, parse_timestamp, utf16_length, utf16_prefix


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise_label(text: Column, unicode: bool = True) -> Column:
    return js_trim(collapse(nfkc(text) if unicode else text))


def state_key(entity: Column, attribute: Column, unicode: bool = True) -> Column:
    low = lambda c: F.lower(normalise_label(c, unicode))
    return F.concat(low(entity), F.lit("|"), F.regexp_replace(low(attribute), " ", "_"))


def is_hollow(attribute: Column) -> Column:
    return F.regexp_replace(F.lower(attribute), r"\s+", "_").isin(*HOLLOW_ATTRIBUTES)


def upgraded_attribute(attribute: Column, blob: Column) -> Column:
    """A hollow attribute becomes what the text around it says; null where it says nothing."""
    out = None
    for pattern, name in ATTRIBUTE_LADDER:
        hit = F.lower(blob).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(is_hollow(attribute), out).otherwise(attribute)


def is_meaningful(claim: Column, value: Column, entity: Column) -> Column:
    """A claim that can stand alone: long enough, about the entity and the value, or with a role word."""
    low = F.lower(claim)
    token = F.lower(F.element_at(F.filter(F.split(entity, r"\s+"), lambda t: utf16_length(t) >= 4), 1))
    token = F.when(F.exists(F.split(entity, r"\s+"), lambda t: utf16_length(t) >= 4), token)
    about_entity = F.coalesce(F.contains(low, token), F.lit(True))
    about_value = (value == "") | F.contains(low, F.replace(F.lower(value), F.lit(","), F.lit(""))) | F.contains(low, F.lower(value))
    role = low.rlike(ROLE_WORDS)
    return (utf16_length(claim) >= 24) & ~low.rlike(PRONOUN_CLAIM) & (about_entity | role) & (about_value | role)


def normalise_drafts(drafts: DataFrame, unicode: bool = True) -> DataFrame:
    """Drafts that hold as facts; the others are dropped.

    Needs entity, attribute, value_text, claim, raw_span; takes value_num, unit,
    polarity, confidence as they are.  Other columns are kept.
    """
    clean = lambda c: normalise_label(F.coalesce(F.col(c).cast("string"), F.lit("")), unicode)
    d = drafts
    for c in ("entity", "attribute", "value_text", "claim", "raw_span"):
        d = d.withColumn(c, clean(c))
    d = d.withColumn("raw_span", utf16_prefix(F.col("raw_span"), 500))
    d = d.filter((F.col("entity") != "") & (F.col("attribute") != "") & (F.col("value_text") != "") & (utf16_length(F.col("value_text")) <= 240))
    e, v = F.col("entity"), F.col("value_text")
    better = upgraded_attribute(F.col("attribute"), F.concat_ws(" ", "claim", "raw_span", "entity"))
    d = d.filter(better.isNotNull() | is_meaningful(F.col("claim"), v, e)).withColumn("attribute", F.coalesce(better, F.lit(UNSPECIFIED_ATTRIBUTE)))
    rich = utf16_length(F.col("raw_span")) >= 40
    from_span = F.when(utf16_length(F.col("raw_span")) > 220, F.concat(utf16_prefix(F.col("raw_span"), 217), F.lit("…"))).otherwise(F.col("raw_span"))
    d = d.withColumn("claim", F.when(utf16_length(F.col("claim")) >= 20, F.col("claim")).when(rich, from_span)).filter("claim is not null")
    merged = utf16_prefix(F.concat(e, F.lit(": "), F.col("raw_span")), 280)
    stands = is_meaningful(F.col("claim"), v, e)
    d = d.withColumn("claim", F.when(stands, F.col("claim")).when(rich & is_meaningful(merged, v, e), merged)).filter("claim is not null")
    d = d.withColumn("raw_span", F.when(utf16_length(F.col("raw_span")) < 20, F.col("claim")).otherwise(F.col("raw_span")))
    d = d.withColumn("claim", utf16_prefix(F.col("claim"), 320))
    for c, f in (("value_num", finite_or_null), ("polarity", polarity), ("confidence", confidence)):
        if c in d.columns:
            d = d.withColumn(c, f(F.col(c)))
    return d


def to_events(drafts: DataFrame, unicode: bool = True) -> DataFrame:
    """Events of normalised drafts with note_id, content_hash, note_ts, draft_as_of (text) and idx."""
    as_of = F.coalesce(parse_timestamp(F.col("draft_as_of"), "M/d/yyyy", "MMM d, yyyy").cast("timestamp"), F.col("note_ts").cast("timestamp"))
    d = drafts.withColumn("state_key", state_key(F.col("entity"), F.col("attribute"), unicode)).withColumn("as_of", as_of)
    parts = ["note_id", "state_key", "claim", "value_text", iso(F.col("as_of")), "polarity", F.col("idx").cast("string"), "content_hash"]
    return d.withColumn("fact_id", F.sha1(F.concat_ws("|", *parts))).withColumnRenamed("note_id", "source_note_id")


def is_derived_analysis(content: Column) -> Column:
    """Long text that reads like a generated analysis: numbered heads, rules, or set phrases."""
    heads = F.regexp_count(content, F.lit(r"(?m)^\d+\.\s"))
    rules = F.regexp_count(content, F.lit(r"(?m)^---+$"))
    phrase = F.lower(content).rlike(DERIVED_PHRASES)
    return (utf16_length(content) >= 4000) & ((heads >= 4) | (rules >= 3) | ((utf16_length(content) > 8000) & phrase))


def skip_reason(content: Column) -> Column:
    """Why a note is not extracted at all, else null."""
    text = js_trim(content)
    return F.when(utf16_length(text) < SKIP_MIN_CHARS, "too_short").when(F.lower(text).rlike(r"^this is a test\b") & (utf16_length(text) < 80), "test_note")


def demoted_confidence(value: Column, kind: Column, derived: Column) -> Column:
    """Measurements of a derived analysis are believed less."""
    return F.when(derived & (kind == "measurement"), F.least(value, F.lit(DEMOTED_CONFIDENCE))).otherwise(value)


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def chunk_bounds(content: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """Where the chunks of a text begin and end: at a line or sentence end if that is over 40 % in.

    ``size`` and ``overlap`` are in UTF-16 units, the bounds in characters; a
    bound that would fall within a character is put before it.
    """
    units = _BEYOND.sub("\ud800\udc00", content)
    bounds, start = [], 0
    while start < len(units):
        end = min(len(units), start + size)
        if end < len(units):
            at = max(units.rfind("\n", start, end), units.rfind("\n\n", start, end), units.rfind(". ", start, end)) - start
            if at > size * 0.4:
                end = start + at + 1
        bounds.append((start, end))
        if end >= len(units):
            break
        start = max(0, end - overlap)
    if len(units) == len(content):
        return bounds
    second = [m.start() for m in re.finditer("\udc00", units)]  # where the second unit of a character stands
    return [(a - bisect_left(second, a + 1), b - bisect_left(second, b + 1)) for a, b in bounds]


def chunk_notes(notes: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """note_id, chunk, chunk_text: overlapping pieces of each content.

    Short notes, most of them, stay in the JVM; only the cutting points of long
    ones, which depend on the text, are found in Python, batch by batch.
    """

    @F.pandas_udf("array<struct<s:int,n:int>>")
    def bounds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"s": a + 1, "n": b - a} for a, b in chunk_bounds(t or "", size, overlap)])

    short = F.array(F.struct(F.lit(1).alias("s"), F.length("content").alias("n")))
    small, large = notes.filter(utf16_length(F.col("content")) <= size), notes.filter(utf16_length(F.col("content")) > size)
    parts = small.select("note_id", "content", short.alias("b")).unionByName(large.select("note_id", "content", bounds("content").alias("b")))
    cut = parts.select("note_id", "content", F.posexplode("b").alias("chunk", "at"))
    text = F.when(utf16_length(F.col("content")) <= size, F.col("content")).otherwise(js_trim(F.expr("substring(content, at.s, at.n)")))
    return cut.select("note_id", "chunk", text.alias("chunk_text")).filter(or_null(F.col("chunk_text")).isNotNull() | (F.col("chunk") == 0))
