"""Queries that need a note's length, not its content, move no contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import retrieval
from quillspark.plans import context
from quillspark.sources import views

SMALL = "/root/testdata/sf0.001"


def _sides(df):
    """The lines of the optimised plan above its last join, and from there on."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = max(i for i, line in enumerate(lines) if "Join " in line)
    return "\n".join(lines[:at]), "\n".join(lines[at:])


def test_lengths_of_lines_are_taken_before_the_join(spark):
    notes = views.notes(spark, SMALL)
    both = notes.select("note_id", retrieval.line_length(notes, "date").alias("n"), F.octet_length(F.encode(retrieval.prompt_line("date"), "UTF-16LE")).alias("twice"))
    assert both.filter("twice <> 2 * n").count() == 0
    above, below = _sides(notes.select("note_id", retrieval.line_length(notes, "date")))
    assert "content#" not in above and "AS content_units" in below and "AS content#" not in below


def test_contents_are_read_for_picked_notes_only(spark):
    notes = views.notes(spark, SMALL)
    _, below = _sides(retrieval.picked_notes(notes, [("n-1", 1, 20, None), ("n-3", 2, 30, None)]).drop("pick"))
    picked = retrieval.picked_notes(notes, [("n-1", 1, 20, None), ("n-3", 2, 30, None)])
    assert sorted(r["note_id"] for r in picked.collect()) == ["n-1", "n-3"]
    assert "n-1" in below and "n-3" in below


def test_diagnostics_move_no_contents_of_all_notes(spark):
    notes = views.notes(spark, SMALL)
    picked = notes.filter("note_id = 'n-1'").select("note_id", "note_ts", F.lit("x").alias("content"), F.lit("primary").alias("part"))
    plan = context.diagnostics(picked, notes, "chat")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS content_units" in plan and "AS content#" not in plan
