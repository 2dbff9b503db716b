"""The whole retrieval plan: rank, select, split the budget, pack, sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PROFILES
from ..operators import render, retrieval
from ..operators.ledger import current_state
from ..storage import cut


def query_vectors(embeddings: DataFrame, n: int = 3) -> list[list[float]]:
    """The first vectors of the test table, which stand for the embedded queries."""
    rows = embeddings.filter(F.col("vec_id") < n).orderBy("vec_id").select("embedding").collect()
    return [[float(x) for x in r["embedding"]] for r in rows]


def relevant_notes(
    notes: DataFrame,
    index: DataFrame,
    facts: DataFrame | None,
    queries: Sequence[Sequence[float]],
    profile_name: str,
    now_ms: int,
    terms: Sequence[str] = (),
) -> DataFrame:
    """note_id, note_ts, content, part (primary or sweep), cut_to of the notes of a prompt.

    State lines take their share of the budget first.  The best notes fill what
    is left; then short notes with a fair score fill a part of what they leave.
    Scores and line lengths are narrow rows, written once, as every pass reads
    them; contents are joined to the notes that were picked, a budget's worth.
    """
    profile = PROFILES[profile_name]
    style, place = profile.timestamp_style, retrieval.rank_place()
    scored = cut(retrieval.score(notes, index, queries, now_ms, profile, terms, style), "scored")
    budget = profile.max_prompt_chars
    if facts is not None:
        budget = render.budget_split(cut(current_state(facts), "current"), budget).first()["notes_chars"]
    # at most the profile's limit of candidates, so its selection is folded as rows
    best = cut(retrieval.selection(retrieval.top_candidates(scored, profile), profile).filter("line_length is not null"), "best")
    primary = retrieval.greedy_picks(best, place, budget, retrieval.content_of(notes))
    room = min(int(budget * profile.short_budget_ratio), max(0, budget - sum(length + 1 for _, _, length, _ in primary)))
    sweep: list[retrieval.Pick] = []
    if room > 1:
        short = scored.filter((F.col("content_length") > 0) & (F.col("content_length") <= profile.short_max) & (F.col("score") >= profile.short_min_score))
        sweep = retrieval.greedy_picks(short.filter(F.col("line_length").isNotNull() & ~F.col("note_id").isin([p[0] for p in primary])), place, room - 1)
    parts = notes.sparkSession.createDataFrame([(p[0], name) for picks, name in ((primary, "primary"), (sweep, "sweep")) for p in picks], "note_id string, part string")
    picked = retrieval.picked_notes(notes, [*primary, *sweep]).join(F.broadcast(parts), "note_id")
    kept = F.when(F.col("cut_to").isNotNull(), F.expr("substring(content, 1, cut_to)")).otherwise(F.col("content"))
    return picked.select("note_id", "note_ts", kept.alias("content"), "cut_to", "part")


def recent_notes(notes: DataFrame, budget: int, style: str) -> DataFrame:
    """Without an index: the newest notes that fit, to be shown in time order."""
    place = [-F.unix_millis(F.col("note_ts").cast("timestamp")), F.col("note_id")]
    return retrieval.greedy_pack(notes, place, budget, style)


def diagnostics(picked: DataFrame, notes: DataFrame, profile_name: str) -> DataFrame:
    """One row about a retrieval: counts, characters, and the share of the corpus's text that was left out."""
    style = PROFILES[profile_name].timestamp_style
    all_notes = notes.agg(F.count(F.lit(1)).alias("available_notes"), F.greatest(F.lit(0), F.sum(retrieval.line_length(notes, style) + 1) - 1).alias("full_chars"))
    chosen = picked.agg(
        F.count(F.lit(1)).alias("selected_notes"),
        F.count(F.when(F.col("part") == "sweep", 1)).alias("short_notes"),
        F.greatest(F.lit(0), F.coalesce(F.sum(retrieval.line_length(picked, style) + 1), F.lit(1)) - 1).alias("selected_chars"),
    )
    ratio = F.when(F.col("full_chars") > 0, F.greatest(F.lit(0.0), 1 - F.col("selected_chars") / F.col("full_chars"))).otherwise(F.lit(0.0))
    return all_notes.crossJoin(chosen).withColumn("reduction", ratio).withColumn("profile", F.lit(profile_name))


def prompt_lines(picked: DataFrame, profile_name: str) -> DataFrame:
    """note_id, note_ts, line of the picked notes; the prompt has them in time order."""
    style = PROFILES[profile_name].timestamp_style
    text = retrieval.prompt_line(style)
    return picked.select("note_id", "note_ts", F.when(F.col("cut_to").isNotNull(), F.concat(text, F.lit("…"))).otherwise(text).alias("line"))
