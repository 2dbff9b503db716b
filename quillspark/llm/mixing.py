"""Mixing sources to target weights by weighted fair queueing.

Each source plays its shuffled documents, again and again, as a flow of a fair
queue: an entry's virtual finish time is the source's tokens so far, this entry
included, divided by the source's target.  All entries are range-sorted by that
time and the queue is cut where the total budget is used up.

Both orderings are running sums over ranges (``running_sum``), so a source that
holds a third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, id_key, running_sum

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size), one row for each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the total by weight; what a share has above ``repeats`` times its source is
    dealt out again until none is above.  Only scalars reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sum(totals, ["_last", "source"], "_one", "_rank", "source-rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    sources = cut(ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("_cap")), "sources")
    rate = 0.0
    while True:
        # a source is capped where its share by weight is more than it can give
        capped = F.col("_cap") < F.col("weight") * F.lit(rate)
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        new = (row["total"] - row["fixed"]) / row["open"] if row["open"] else rate
        if new <= rate:
            break
        rate = new
    target = F.when(F.col("_cap") < F.col("weight") * F.lit(rate), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken (and text_hash) for each row of ``docs``.

    ``size`` counts the words of the text (null or empty: 0); ``taken`` is size
    times the number of times (0 to ``repeats``) that the row is in the mix.
    The shuffle follows an md5 of doc_id and ``seed``, so reruns agree.  Rows
    that repeat a doc_id, and rows without one, are dealt each on its own.  An
    empty table gives no rows; other columns are ignored.
    """
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        )
        .withColumn("_turn", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|" + seed))))
        .withColumn("_row", F.monotonically_increasing_id()),  # fixed by being written here
        "sized",
    )
    targets = cut(source_targets(sized.select("source", "size"), weights, repeats), "targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0

    # tokens of the source so far, in shuffled order: a running sum over all, less what stands before the source
    last = F.col("source").isNull()
    summed = running_sum(sized.withColumn("_last", last), ["_last", "source", "_turn", "doc_id", "text_hash", "_row"], "size", "_all", "shuffled")
    before = running_sum(targets.withColumn("_last", last), ["_last", "source"], "source_size", "_upto", "source-starts")
    before = before.select(F.col("source").alias("_source"), "source_size", "target", (F.col("_upto") - F.col("source_size")).alias("_start"))
    flows = summed.join(before, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_so_far", F.col("_all") - F.col("_start"))

    finish = F.try_divide((F.col("_so_far") + F.col("_round") * F.col("source_size")).cast("double"), F.col("target"))
    entries = flows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_finish", finish)
    columns = ["_row", "doc_id", "text_hash", "_turn", "_round", "_finish", "size", "source_size", "target"]
    queue = running_sum(entries.select(*columns), ["_finish", "_turn", "doc_id", "text_hash", "_row", "_round"], "size", "_played", "queue")
    # the queue stops at its first entry beyond the budget
    return (
        queue.groupBy("_row", "doc_id", "text_hash", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("_played") <= total, F.col("size")).otherwise(F.lit(0))).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken", "text_hash")
    )


def play(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, columns as they were.

    Rows that repeat doc_id and text share out their turns in the order of their
    columns as JSON, so reruns agree; null ids and texts are values like others,
    though a row without words is never taken.  Columns may have any name and
    type.  An empty table gives no rows.
    """
    # a row that isn't taken has its place in the order too
    shares = cut(
        mix(docs, **options)
        .groupBy(id_key(F.col("doc_id")).alias("_id"), F.col("text_hash").alias("_text"))
        .agg(F.sum(F.coalesce(F.try_divide("taken", "size"), F.lit(0)).cast("int")).alias("_times"), F.count(F.lit(1)).alias("_rows"))
        .filter("_times > 0"),
        "shares",
    )
    keyed = docs.select(F.struct("*").alias("_row"), id_key(F.col("doc_id")).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    # merged, as nothing bounds the number of rows that are taken
    out = keyed.join(shares.filter("_rows = 1").select("_id", "_text", F.col("_times").cast("int").alias("_times")).hint("merge"), ["_id", "_text"])
    several = shares.filter("_rows > 1")
    if not several.isEmpty():
        # a row's number among its equals: its number among all of these, less what stands before its group
        alike = keyed.join(several.select("_id", "_text"), ["_id", "_text"], "left_semi")
        numbered = running_sum(alike.withColumn("_json", F.to_json("_row")).withColumn("_one", F.lit(1).cast("long")), ["_id", "_text", "_json"], "_one", "_k", "repeats")
        starts = running_sum(several, ["_id", "_text"], "_rows", "_upto", "repeat-starts")
        place = F.col("_k") - (F.col("_upto") - F.col("_rows"))
        turns = numbered.join(starts, ["_id", "_text"]).withColumn("_times", F.floor((F.col("_times") + F.col("_rows") - place) / F.col("_rows")).cast("int"))
        out = out.unionByName(turns.filter("_times > 0").select("_id", "_text", "_row", "_times"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
