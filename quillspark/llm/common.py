"""Shared pieces: reading tables, text columns, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, new_path, running_sum, shuffle_width

__all__ = ["WORD", "ascii_lower", "cut", "heads_of", "id_key", "new_path", "rows_of", "running_sum", "shuffle_width", "table", "text_key"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does the same, faster, to pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_key(column: Column) -> Column:
    """A document id that joins: null becomes the smallest long."""
    return F.coalesce(column.cast("long"), F.lit(-(2**63)))


def rows_of(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """One row of ``docs`` for each row of ``kept`` (_id, _key, copies), columns as they were.

    ``_id`` is the ``id_key`` of a row's doc_id and ``_key`` its ``key``;
    ``copies`` rows share both.  Only where there are several, the row whose
    columns are the largest as JSON is taken, by a maximum that is combined before
    the shuffle.  Columns may have any name and type.
    """
    keyed = docs.select(F.struct("*").alias("_row"), id_key(F.col("doc_id")).alias("_id"), key.alias("_key"))
    # merged, as nothing bounds the number of rows that are kept
    once = keyed.join(kept.filter("copies = 1").hint("merge"), ["_id", "_key"], "left_semi").select("_row.*")
    repeats = kept.filter("copies > 1")
    if repeats.isEmpty():
        return once
    several = keyed.join(repeats.hint("merge"), ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.max_by("_row", F.to_json("_row")).alias("_row"))
    return once.unionByName(several.select("_row.*"))


def text_key() -> Column:
    """A key of the row's text; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def heads_of(docs: DataFrame, components: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``components`` (doc_id, text_key, root), columns as they were.

    It is the row of the smallest doc_id (null is the smallest); of rows that
    share it, that of the smallest text key; of rows that repeat both, the largest.
    """
    same = components.groupBy("root", id_key(F.col("doc_id")).alias("_id"), F.col("text_key").alias("_key")).agg(F.count(F.lit(1)).alias("copies"))
    heads = same.groupBy("root").agg(F.min(F.struct("_id", "_key", "copies")).alias("head")).select("head.*")
    return rows_of(docs, cut(heads, "heads"), text_key())
