"""The message log: keyed merge, append, delete, and views of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import batch_number, clip, js_trim, millis, utf16_length, utf16_prefix
from ..storage import cut, running_sum

FIELDS = ("id", "content", "type", "ts", "source")


def message_key() -> Column:
    """The id, or type, time and content of a message without one."""
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    kind = F.when(F.coalesce("type", F.lit("")) == "", "unknown").otherwise(F.col("type"))
    composite = F.concat_ws(":", kind, stamp, F.coalesce("content", F.lit("")))
    return F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit("id:"), F.col("id"))).otherwise(composite)


def append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """No deduplication and no order."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def upsert_merge(existing: DataFrame, incoming: DataFrame, order: str = "ord", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Merge by key, field by field: the last message that has a field gives it.

    Typed columns have no absent fields, so ``present_<field>`` (boolean, true
    where missing) says whether a message has it; a present null overrides.
    Aggregates only, so a key with very many messages is combined before the
    shuffle.  ``first_ord`` keeps the key's first place.
    """
    sides = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    place = F.struct("_side", order)
    merged = []
    for field in fields:
        present = F.coalesce(F.col(f"present_{field}"), F.lit(True)) if f"present_{field}" in sides.columns else F.lit(True)
        last = F.max(F.when(present, F.struct(F.col("_side"), F.col(order), F.col(field).alias("value"))))
        merged.append(last["value"].alias(field))
    return sides.withColumn("message_key", message_key()).groupBy("message_key").agg(*merged, F.min(place).alias("_first")).select(
        *fields, "message_key", F.col("_first._side").alias("first_side"), F.col(f"_first.{order}").alias("first_ord")
    )


def chronological(df: DataFrame, *ties: str) -> DataFrame:
    """By time, unreadable times first as the epoch."""
    return df.orderBy(F.coalesce(millis(F.col("ts")), F.lit(0)), *ties)


def add_unseen(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Only messages of new keys; what is there is never overwritten."""
    old = existing.withColumn("_key", message_key())
    new = incoming.withColumn("_key", message_key())
    return existing.unionByName(new.join(old.select("_key").distinct(), "_key", "left_anti").drop("_key"))


def delete_by_id(log: DataFrame, message_id: str) -> DataFrame:
    return log.filter(~F.col("id").eqNullSafe(F.lit(message_id)))


def shrink_guard(existing: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """One row: old_count, new_count, rejected (the new log has less than half)."""
    counts = existing.agg(F.count(F.lit(1)).alias("old_count")).crossJoin(incoming.agg(F.count(F.lit(1)).alias("new_count")))
    return counts.withColumn("rejected", F.lit(not force) & (F.col("new_count") < 0.5 * F.col("old_count")))


def save_delta(log: DataFrame, snapshots: DataFrame, *fields: str) -> DataFrame:
    """Messages that are new or differ from their snapshot, with ``change`` new or updated."""
    seen = snapshots.select(F.col("id").alias("_id"), F.struct(*fields).alias("_old"))
    now = log.withColumn("_now", F.struct(*fields))
    joined = now.join(seen, F.col("id") == F.col("_id"), "left")
    change = F.when(F.col("_id").isNull(), "new").when(~F.col("_now").eqNullSafe(F.col("_old")), "updated")
    return joined.withColumn("change", change).filter(F.col("change").isNotNull()).drop("_id", "_old", "_now")


def persistable(log: DataFrame) -> DataFrame:
    """What is saved: no blank answers, four fields."""
    blank = (F.col("type") == "ai-response") & (js_trim(F.coalesce("content", F.lit(""))) == "")
    return log.filter(~F.coalesce(blank, F.lit(False))).select("id", "content", "type", "ts")


def loadable(log: DataFrame) -> DataFrame:
    """What is loaded: no answers without content, thoughts and code blocks."""
    some = (js_trim(F.coalesce("content", F.lit(""))) != "") | (F.coalesce(F.size("thoughts"), F.lit(0)) > 0) | (F.coalesce(F.size("code_blocks"), F.lit(0)) > 0)
    return log.filter(~F.col("type").eqNullSafe(F.lit("ai-response")) | some)


def json_bytes(log: DataFrame) -> DataFrame:
    """type, n, bytes: the size of the messages as JSON, as it is saved."""
    saved = F.to_json(F.struct("id", "content", "type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")), {"ignoreNullFields": "false"})
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(saved)).alias("bytes"))


def snapshots(log: DataFrame) -> DataFrame:
    """id, snapshot: the JSON of each message that is saved, by which a client knows what it must send."""
    saved = F.struct("id", "content", "type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"))
    return persistable(log).select("id", F.to_json(saved, {"ignoreNullFields": "false"}).alias("snapshot"))


def note_list(log: DataFrame) -> DataFrame:
    return log.filter((F.col("type") == "note") & (js_trim(F.col("content")) != "")).select("content", F.col("ts").alias("date"))


def latest(log: DataFrame, n: int, *ties: str) -> DataFrame:
    """The newest ``n`` messages (a top-k report)."""
    return log.orderBy(F.col("ts").desc(), *ties).limit(n)


def type_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def profile(log: DataFrame) -> DataFrame:
    """Counts, time range and bytes of the notes: one row."""
    note = F.col("type") == "note"
    return log.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count(F.when(note, 1)).alias("notes"),
        F.min(F.when(note, F.col("ts"))).alias("first_note"),
        F.max(F.when(note, F.col("ts"))).alias("last_note"),
        F.sum(F.octet_length("content")).alias("content_bytes"),
    )


def recent_previews(log: DataFrame, n: int = 5, limit: int = 100) -> DataFrame:
    picked = latest(log.filter(F.col("type") == "note"), n, "id")
    return picked.select("id", "ts", clip(F.col("content"), limit, "...").alias("preview"))


def history(log: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` questions and answers, as role and text, oldest first by ``ord``."""
    turns = log.filter(F.col("type").isin("question", "ai-response"))
    last = latest(turns, n, F.col("id").desc())
    role = F.when(F.col("type") == "question", "user").otherwise("model")
    return last.withColumn("ord", F.row_number().over(Window.orderBy("ts", "id"))).select("ord", "id", role.alias("role"), "content")


def history_summary(turns: DataFrame, entries: int = 6, each: int = 300, total: int = 1500) -> DataFrame:
    """Speaker lines of the last entries, as many from the first as fit."""
    last = turns.orderBy(F.col("ord").desc()).limit(entries)
    text = js_trim(F.col("content"))
    speaker = F.when(F.col("role") == "model", "AI").otherwise("User")
    lines = last.filter(text != "").select("ord", F.concat(speaker, F.lit(": "), clip(text, each, "…")).alias("line"))
    upto = F.sum(utf16_length(F.col("line")) + 1).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    # joined by newlines: the first line has none before it, so the sum is one ahead of the text's length
    start = F.row_number().over(Window.orderBy("ord"))
    return lines.select("ord", "line", (upto - F.when(start > 1, 1).otherwise(0)).alias("chars")).filter(F.col("chars") <= total)


def prefix_key(limit: int = 200) -> Column:
    """The type and the first ``limit`` UTF-16 units, by which messages are the same."""
    return F.concat(F.coalesce("type", F.lit("note")), F.lit(":"), utf16_prefix(js_trim(F.coalesce("content", F.lit(""))), limit))


def prefix_dedupe(existing: DataFrame, incoming: DataFrame | None = None, order: str = "ord", limit: int = 200) -> DataFrame:
    """One message for each type and first ``limit`` UTF-16 units; existing before incoming, then the first."""
    sides = existing.withColumn("_side", F.lit(0))
    if incoming is not None:
        sides = sides.unionByName(incoming.withColumn("_side", F.lit(1)))
    columns = [c for c in existing.columns if c != order]
    first = F.min(F.struct("_side", order, *columns)).alias("_m")
    return sides.groupBy(prefix_key(limit).alias("dedupe_key")).agg(first).select("dedupe_key", F.col(f"_m.{order}").alias(order), *[F.col(f"_m.{c}").alias(c) for c in columns])


def batch_counts(log: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """type, batch, n: the batches of ``size`` messages that each group falls into, in ``order``.

    A message's number is its place among all, less what stands before its
    group: running sums over ranges, so a group of any size is spread over tasks.
    """
    known = [F.col(g).isNotNull().alias(f"_k{i}") for i, g in enumerate(group)]
    rows = log.select(*group, *order, *known, F.lit(1).cast("long").alias("_one"))
    by = [c for i, g in enumerate(group) for c in (f"_k{i}", g)]
    placed = running_sum(rows, [*by, *order], "_one", "_place", "batches")
    starts = cut(placed.groupBy(*group).agg(F.min("_place").alias("_start")), "batch-starts")
    same = None
    for g in group:
        now = placed[g].eqNullSafe(starts[g])
        same = now if same is None else same & now
    numbered = placed.join(starts, same).select(placed["type"], batch_number(F.col("_place") - F.col("_start"), size).alias("batch"))
    return numbered.groupBy("type", "batch").agg(F.count(F.lit(1)).alias("n"))
