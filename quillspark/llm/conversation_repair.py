"""Repairing the structure of conversations by the cheapest edits.

A conversation holds when its roles' initials read ``(s?(ua)+)?``.  Faulty turns
are flagged by windows, the turns of a conversation are collected as sorted
structs, and ``aggregate()`` carries the cheapest way to each of four states as a
(cost, audit) struct: nothing yet, after a system turn, after a user turn, after
an answer.  ``least`` of such structs takes the cheapest and, among equals, the
smallest audit, so the fold never leaves the JVM.

A conversation of more than ``segment`` turns is never one group.  It is ordered
over ranges and cut into segments; each is folded from each of the four states,
the results are joined 64 at a time, level by level, and the repaired text is
hashed segment by segment as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, running_sum

#: Turns that are folded at once.
SEGMENT = 1024
#: Segments that are joined at once.
FAN_IN = 64
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: More than any repair costs: a state that can't be reached.
NEVER = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
STATES = ("none", "system", "user", "answer")
_VECTOR = "struct<" + ",".join(f"{s}:struct<cost:bigint,audit:string>" for s in STATES) + ">"


# --- damage


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the damage of the exercise, drawn by crc32 of ``conv_id:turn``.

    A null counts as one space.  Dropped rows are flagged, not removed, so that a
    conversation of none but these stays known.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    drawn = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_draw"))
    draw = F.col("_draw")
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(True), F.when(draw == 3, 2).otherwise(1))
    return drawn.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (draw == 0).alias("dropped"), F.explode(copies).alias("_")).drop("_")


# --- faults


def _faults(seen: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated, else null."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    return F.when(bare == "", "blank").when(seen, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")


def _turn() -> Column:
    """What is collected of a row; these sort by turn (null first), role, text."""
    return F.struct("turn", "role", "text", "again", "fault")


def _short(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, segment 0, turns."""
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    flagged = rows.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    flagged = flagged.withColumn("fault", _faults(F.col("again")))
    kept = F.when(~F.col("dropped"), _turn())
    return flagged.groupBy("conv_id").agg(F.sort_array(F.collect_list(kept)).alias("turns")).select("conv_id", F.lit(0).cast("long").alias("segment"), "turns")


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """One row for each segment of a conversation; no group holds more than a segment."""
    named = rows.filter(~F.col("dropped")).select("conv_id", "turn", "role", "text", F.col("turn").isNotNull().alias("_timed"), F.lit(1).cast("long").alias("_one"))
    placed = running_sum(named.withColumn("_known", F.col("conv_id").isNotNull()), ["_known", "conv_id", "_timed", "turn", "role", "text"], "_one", "_place", "turns")
    placed = cut(placed.select("conv_id", "turn", "role", "text", "_place", F.sha2("text", 256).alias("_sha")), "turns-placed")
    starts = cut(placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_place").alias("_start")), "turns-starts")
    # a minimum, not a window: it is combined before the shuffle where a text is repeated very often
    firsts = placed.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_sha").alias("_s")).agg(F.min("_place").alias("_first"))
    firsts = cut(firsts, "turns-firsts")
    joined = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")))
    joined = joined.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_sha") == F.col("_s")))
    at = F.col("_place") - F.col("_start")
    flagged = joined.withColumn("again", F.col("_place") > F.col("_first"))
    flagged = flagged.withColumn("fault", _faults(F.col("again"))).withColumn("segment", F.floor(at / segment))
    own = F.struct("_place", _turn().alias("t"))
    groups = flagged.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(own)).alias("placed"))
    return groups.select("conv_id", "segment", F.transform("placed", lambda p: p["t"]).alias("turns"))


# --- the fold


def _way(cost, audit) -> Column:
    return F.struct(F.least(cost, F.lit(NEVER)).cast("long").alias("cost"), audit.alias("audit"))


def _inserted(way: Column) -> Column:
    return _way(way["cost"] + INSERT, F.concat(way["audit"], F.lit("I")))


def _with_inserts(at: Column) -> tuple[Column, Column]:
    """The user and answer states, also reached by inserts.  From any other state the next turn is a user's."""
    user = F.least(at["user"], *[_inserted(at[s]) for s in ("none", "system", "answer")])
    return user, F.least(at["answer"], _inserted(user))


def _fold(turns: Column, start: str) -> Column:
    """The cheapest way from ``start`` to each state over all ``turns``."""

    def step(at: Column, turn: Column) -> Column:
        gone = turn["fault"].isin("blank", "duplicate")
        left_open = F.when(turn["fault"] == "truncated", CUT_OFF).otherwise(0)
        initial = F.substring(turn["role"], 1, 1)
        dropped = lambda way: _way(way["cost"] + DELETE, F.concat(way["audit"], F.lit("D")))

        def taken(way: Column, wanted: str) -> Column:
            fits = initial == wanted
            cost = F.when(F.coalesce(gone, F.lit(False)), NEVER).otherwise(left_open + F.when(fits, 0).otherwise(REROLE))
            return _way(way["cost"] + cost, F.concat(way["audit"], F.when(fits, "K").otherwise("R")))

        user, answer = _with_inserts(at)
        first = taken(at["none"], "s")
        first = _way(F.when(initial == "s", first["cost"]).otherwise(NEVER), first["audit"])  # rows are re-roled to user and assistant only
        return F.struct(
            dropped(at["none"]).alias("none"),
            F.least(dropped(at["system"]), first).alias("system"),
            F.least(dropped(user), *[taken(w, "u") for w in (at["none"], at["system"], answer)]).alias("user"),
            F.least(dropped(answer), taken(user, "a")).alias("answer"),
        )

    begin = F.struct(*[F.struct(F.lit(0 if s == start else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(s) for s in STATES])
    return F.aggregate(turns, begin.cast(_VECTOR), step)


def _best(at: Column) -> Column:
    """The cheapest way to a whole conversation."""
    return F.least(at["none"], _with_inserts(at)[1])


def _facts(turns: Column) -> list[Column]:
    """What else a segment tells: counts, turn numbers and the initials at its ends."""
    numbers = F.filter(F.transform(turns, lambda t: t["turn"]), lambda n: n.isNotNull())
    initials = F.transform(turns, lambda t: F.substring(t["role"], 1, 1))
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size(initials) - 1, F.lit(0))), F.slice(initials, 2, F.greatest(F.size(initials), F.lit(1))), lambda a, b: F.concat(a, b))
    count = lambda name: F.size(F.filter(turns, lambda t: t["fault"] == name)).cast("long").alias(name)
    return [
        *[count(f) for f in ("blank", "duplicate", "truncated")],
        F.size(F.filter(pairs, _illegal)).cast("long").alias("illegal"),
        F.size(F.array_distinct(numbers)).cast("long").alias("numbers"),
        F.array_min(numbers).alias("low"),
        F.array_max(numbers).alias("high"),
        F.try_element_at(initials, F.lit(1)).alias("first"),
        F.try_element_at(initials, F.lit(-1)).alias("last"),
    ]


def _illegal(pair: Column) -> Column:
    return ~pair.isin("su", "ua", "au")


def _then(ways: Column, more: Column) -> Column:
    """Ways to each state over one segment and then the next."""
    through = lambda t: [_way(ways[s]["cost"] + more[s][t]["cost"], F.concat(ways[s]["audit"], more[s][t]["audit"])) for s in STATES]
    return F.struct(*[F.least(*through(t)).alias(t) for t in STATES])


def _join_segments(parts: DataFrame) -> DataFrame:
    """Segments (with ``table``: the ways from each state) joined until one is left of each conversation."""
    added = ("blank", "duplicate", "truncated", "illegal", "numbers")

    def join(a: Column, b: Column) -> Column:
        extra = {"illegal": _illegal(F.concat(a["last"], b["first"])).cast("long"), "numbers": -(a["high"] == b["low"]).cast("long")}
        sums = [(a[c] + b[c] + F.coalesce(extra.get(c, F.lit(0)), F.lit(0))).cast("long").alias(c) for c in added]
        ends = [F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"), a["first"].alias("first"), b["last"].alias("last")]
        table = F.struct(*[_then(a["table"][s], b["table"]).alias(s) for s in STATES]).alias("table")
        return F.struct(b["segment"].alias("segment"), *sums, *ends, table)

    columns = ["segment", *added, "low", "high", "first", "last", "table"]
    while not parts.filter("segment > 0").isEmpty():
        grouped = parts.groupBy("conv_id", F.expr(f"segment div {FAN_IN}").alias("_part")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_all"))
        one = F.aggregate(F.slice("_all", 2, FAN_IN), F.col("_all")[0], join).alias("_one")
        parts = cut(grouped.select("conv_id", "_part", one).select("conv_id", "_part", "_one.*").drop("segment").withColumnRenamed("_part", "segment"), "segments-joined")
    return parts


# --- the repaired text


def _lines(turns: Column, edits: Column, before: Column, system: Column) -> Column:
    """The repaired turns of a segment as ``role:text``.

    ``edits`` has an entry for each turn: the inserts before it and its own
    letter.  ``before`` counts the turns that stand before the segment, and
    ``system`` is 1 if the first of all is a system turn: this and its place tell
    the role of a turn that is new or has changed.
    """
    role = lambda place: F.when((place - system) % 2 == 0, "user").otherwise("assistant")
    standing = lambda some: F.length(F.regexp_replace(F.array_join(some, ""), "D", ""))

    def of(edit: Column, i: Column) -> Column:
        place = before + standing(F.slice(edits, F.lit(1), i))
        inserts = F.length(F.regexp_replace(edit, "[^I]", ""))
        new = F.when(inserts > 0, F.transform(F.sequence(F.lit(0), inserts - 1), lambda k: F.concat(role(place + k), F.lit(":")))).otherwise(F.array().cast("array<string>"))
        turn = F.try_element_at(turns, (i + 1).cast("int"))
        own = F.when(edit.endswith("K"), turn["role"]).when(edit.endswith("R"), role(place + inserts))
        return F.concat(new, F.when(own.isNotNull(), F.array(F.concat(own, F.lit(":"), turn["text"]))).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(edits, of))


def _edits(audit: Column) -> Column:
    """The letters for each turn; the inserts at the end are an entry of their own."""
    return F.regexp_extract_all(audit, F.lit("I*[KRD]|I+$"), F.lit(0))


def _system(turns: Column, edits: Column) -> Column:
    """1 where the first turn that stands is one that was a system turn and is kept."""
    first = F.try_element_at(F.filter(edits, lambda e: e != "D"), F.lit(1))
    at = F.array_position(edits, first)
    kept = (first == "K") & F.substring(F.try_element_at(turns, at.cast("int"))["role"], 1, 1).eqNullSafe(F.lit("s"))
    return F.when(kept, 1).otherwise(0)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from (conv_id, segment, lines), hashed piece by piece."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hasher, begun = None, None, False
        for batch in batches:
            done = []
            for conv, lines in zip(batch["conv_id"].array, batch["lines"], strict=True):
                if hasher is None or conv != now:
                    if hasher is not None:
                        done.append((now, hasher.hexdigest()))
                    now, hasher, begun = conv, hashlib.sha256(), False
                if len(lines):
                    hasher.update((("\n" if begun else "") + "\n".join(lines)).encode())
                    begun = True
            if done:
                yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])
        if hasher is not None:
            yield pd.DataFrame([(now, hasher.hexdigest())], columns=["conv_id", "repaired_sha256"])

    ship(pieces.sparkSession)
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    # ids as text, as pandas turns integers with nulls into floats
    hashed = dealt.select(F.col("conv_id").cast("string").alias("conv_id"), "lines").mapInPandas(stream, "conv_id string, repaired_sha256 string")
    return hashed.withColumn("conv_id", F.col("conv_id").cast(kind))


# --- whole conversations


def _gaps() -> Column:
    return F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0)).alias("gaps")


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repair_long(rows: DataFrame, segment: int) -> DataFrame:
    segments = cut(_long(rows, segment), "segments")
    table = F.struct(*[_fold(F.col("turns"), s).alias(s) for s in STATES]).alias("table")
    whole = _join_segments(cut(segments.select("conv_id", "segment", *_facts(F.col("turns")), table), "segments-folded"))
    whole = whole.withColumn("way", _best(F.col("table")["none"]))
    judged = cut(whole.select("conv_id", _gaps(), "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit")), "segments-judged")

    # each segment's own edits; those after the last turn go to the last segment
    edits = judged.select(F.col("conv_id").alias("_conv"), _edits(F.col("audit")).alias("_edits"), F.length(F.regexp_replace("audit", "[I]", "")).alias("_n"))
    last = F.floor((F.col("_n") - 1) / segment)
    own = F.slice("_edits", (F.col("_s") * segment + 1).cast("int"), F.when(F.col("_s") == last, segment + 1).otherwise(segment))
    split = edits.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("_conv", "_s", own.alias("edits"))
    parts = cut(segments.join(split, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_s"))).drop("_conv", "_s"), "segments-edited")
    stands = F.length(F.regexp_replace(F.array_join("edits", ""), "D", ""))
    opened = F.when(stands > 0, _system(F.col("turns"), F.col("edits")))
    # one narrow row for each segment
    placed = parts.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_s"), stands.alias("_n"), opened.alias("_system"))
    every = Window.partitionBy("_conv").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = Window.partitionBy("_conv").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(placed.select("_conv", "_s", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.coalesce(F.first("_system", ignorenulls=True).over(every), F.lit(0)).alias("_system")), "segments-before")
    lines = parts.join(placed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_s")))
    lines = lines.select("conv_id", "segment", _lines(F.col("turns"), F.col("edits"), F.col("_before"), F.col("_system")).alias("lines"))
    hashes = _hashed(lines).withColumnRenamed("conv_id", "_conv")
    return judged.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*RESULT)


def _repair_short(rows: DataFrame) -> DataFrame:
    # the window's and the group's exchange are one; judged before the way is read, so that the fold runs once
    folded = _short(rows).select("conv_id", "turns", *_facts(F.col("turns")), _fold(F.col("turns"), "none").alias("at"))
    judged = folded.withColumn("way", _best(F.col("at"))).withColumn("edits", _edits(F.col("way.audit")))
    lines = _lines(F.col("turns"), F.col("edits"), F.lit(0), _system(F.col("turns"), F.col("edits")))
    return judged.select(
        "conv_id", _gaps(), "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, dropped).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, the hash of the repaired ``role:text`` lines.  Rows stand by
    turn, null first, then by role and text.  A row's first fault counts: blank,
    a role and text seen earlier, or not ended by one of ``.!?``.  To keep a row
    costs 0, to re-role it 2, to delete it 3 (blank and duplicate rows must go),
    to insert an empty user or assistant turn 2; a cut-off row that stays adds 1.
    Of the cheapest edits the smallest audit by ASCII is taken.  A conversation
    without rows has zeros, an empty audit and the hash of nothing.  Null ids are
    one conversation; an empty table gives no rows; other columns are ignored.
    """
    sizes = rows.groupBy("conv_id").agg(F.count(F.when(~F.col("dropped"), 1)).alias("_n"))
    long = cut(sizes.filter(F.col("_n") > segment).select(F.col("conv_id").alias("_long")), "long-conversations")
    if long.isEmpty():
        return _repair_short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return _repair_short(rows.join(long, same, "left_anti")).unionByName(_repair_long(rows.join(long, same, "left_semi"), segment))


def conversation_repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The repair of the damaged rows of ``conversations`` (see :func:`damaged` and :func:`repair`)."""
    return repair(damaged(rows), segment)
