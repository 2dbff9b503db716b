"""Lines of prompts and reports, and the split of a shared budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COMBINE_OVERHEAD, MAX_STATE_CHARS, STATE_FRACTION
from ..functions.text import js_rtrim, js_trim, or_null, stamp, utf16_length, utf16_prefix
from .ledger import display_order, supersessions


def _value(value: Column, unit: Column | None) -> Column:
    return value if unit is None else js_trim(F.concat_ws(" ", value, or_null(unit)))


def _unit(state: DataFrame) -> Column | None:
    return F.col("unit") if "unit" in state.columns else None


def state_line(state: DataFrame) -> Column:
    """``- claim [polarity, as of day]`` and what it replaced."""
    plain = F.concat(F.col("entity"), F.lit(" / "), F.col("attribute"), F.lit(": "), _value(F.col("value_text"), _unit(state)))
    claim = F.coalesce(or_null(js_trim("claim")), plain)
    was = F.when(F.col("previous_claim") != "", F.concat(F.lit("  (was: "), F.col("previous_claim"), F.lit(")"))).when(
        (F.col("previous_value_text") != "") & F.col("previous_as_of").isNotNull(),
        F.concat(F.lit("  (was "), _value(F.col("previous_value_text"), _unit(state)), F.lit(" on "), stamp(F.col("previous_as_of"), "day"), F.lit(")")),
    )
    head = F.concat(F.lit("- "), claim, F.lit(" ["), F.col("polarity"), F.lit(", as of "), stamp(F.col("as_of"), "day"), F.lit("]"))
    return F.concat(head, F.coalesce(was, F.lit("")))


def supersession_line(state: DataFrame) -> Column:
    day = stamp(F.col("as_of"), "day")
    both = (F.col("previous_claim") != "") & (F.col("claim") != "")
    long_form = F.concat(F.lit("- "), day, F.lit(" · "), F.col("previous_claim"), F.lit(" → "), F.col("claim"))
    short_form = F.concat(
        F.lit("- "), day, F.lit(" · "), F.col("entity"), F.lit(" / "), F.col("attribute"), F.lit(": "),
        _value(F.col("previous_value_text"), _unit(state)), F.lit(" → "), _value(F.col("value_text"), _unit(state)),
    )
    return F.when(both, long_form).otherwise(short_form)


def packed_state(state: DataFrame, max_chars: int = MAX_STATE_CHARS) -> DataFrame:
    """rank, state_key, line, chars: state lines in display order up to the first that doesn't fit.

    A line has at least 20 characters, so no more than ``max_chars`` / 20 rows
    are ever ordered in one task.
    """
    lines = state.withColumn("line", state_line(state)).orderBy(*display_order()).limit(max_chars // 20 + 1)
    w = Window.orderBy(*display_order())
    summed = lines.withColumn("rank", F.row_number().over(w)).withColumn("chars", F.sum(utf16_length(F.col("line")) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.filter(F.col("chars") <= max_chars).select("rank", "state_key", "line", "chars")


def state_budget(total: int) -> int:
    """Characters that state lines may take of a shared budget."""
    return min(MAX_STATE_CHARS, max(0, int(max(0, total) * STATE_FRACTION)))


def notes_budget(total: int, state_chars: int) -> int:
    """What is left to notes; all where there is no state."""
    return max(0, total - state_chars - COMBINE_OVERHEAD) if state_chars else max(0, total)


#: Headings of the state block; the texts are the application's to choose.
STATE_HEADING = "CURRENT STATE"
SUPERSESSION_HEADING = "RECENT SUPERSESSIONS"
NOTES_HEADING = "NOTES"


def world_state(state: DataFrame, max_chars: int = MAX_STATE_CHARS) -> DataFrame:
    """part, rank, line: heading, packed state lines, then supersessions; no rows for an empty state."""
    some = state.limit(1).select(F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit(STATE_HEADING).alias("line"))
    packed = packed_state(state, max_chars).select(F.lit(1).alias("part"), "rank", "line")
    newest = supersessions(state)
    w = Window.orderBy(F.col("as_of").desc(), "state_key")
    changed = newest.select(F.lit(3).alias("part"), F.row_number().over(w).alias("rank"), supersession_line(newest).alias("line"))
    heading = newest.limit(1).select(F.lit(2).alias("part"), F.lit(0).alias("rank"), F.lit(SUPERSESSION_HEADING).alias("line"))
    return some.unionByName(packed).unionByName(heading).unionByName(changed)


def budget_split(state: DataFrame, total: int) -> DataFrame:
    """One row: total, state_chars, notes_chars."""
    lines = world_state(state, state_budget(total))
    used = lines.agg(F.coalesce(F.sum(utf16_length(F.col("line")) + 1) - 1, F.lit(0)).alias("state_chars"))
    left = F.when(F.col("state_chars") == 0, F.lit(total)).otherwise(F.greatest(F.lit(0), F.lit(total) - F.col("state_chars") - COMBINE_OVERHEAD))
    return used.select(F.lit(total).alias("total"), "state_chars", left.alias("notes_chars"))


def clipped_notes(text: Column, budget: Column) -> Column:
    """Note text that was selected without a budget, cut to one with an ellipsis; blank ends are dropped."""
    whole = js_trim(F.coalesce(text, F.lit("")))
    return F.when(utf16_length(whole) > budget, F.concat(js_rtrim(utf16_prefix(whole, F.greatest(F.lit(0), budget - 1))), F.lit("…"))).otherwise(whole)


def combined(state: Column, notes: Column, heading: str = NOTES_HEADING, nothing: str = "") -> Column:
    """The state block before the notes block; either alone where the other is blank."""
    has_state, has_notes = js_trim(F.coalesce(state, F.lit(""))) != "", js_trim(F.coalesce(notes, F.lit(""))) != ""
    block = F.when(has_notes, F.concat(F.lit(heading + "\n"), notes)).otherwise(F.lit(nothing))
    return F.when(~has_state, F.coalesce(notes, F.lit(""))).otherwise(F.concat(state, F.lit("\n\n"), block))


def note_lines(notes: DataFrame, style: str = "short") -> DataFrame:
    """note_id, note_ts, line of every note: the notes export, to be written in time order."""
    return notes.select("note_id", "note_ts", F.concat(F.lit("["), stamp(F.col("note_ts"), style), F.lit("] "), F.col("content")).alias("line"))


def event_lines(facts: DataFrame) -> DataFrame:
    """fact_id, as_of, line of every event."""
    line = F.concat(F.lit("- "), stamp(F.col("as_of"), "day"), F.lit(" ["), F.col("polarity"), F.lit("] "), F.coalesce(or_null(js_trim("claim")), F.col("value_text")))
    return facts.select("fact_id", "as_of", line.alias("line"))


def write_lines(lines: DataFrame, path: str, *order: Column | str) -> None:
    """Write a report of any size: its lines are range-sorted, so part files follow each other in order."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
