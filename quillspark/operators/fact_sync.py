"""Keeping the fact ledger in step with the notes: extraction, state, index and counters in one commit.

A call takes the newest notes that need it, up to a limit, has their chunks read by
a model, and replaces their facts.  A note that fails is a row with its error, not
an exception.  The current state follows the notes in the order in which they are
taken: a note that owns a key's state replaces it even by an older fact, others must
beat it, and where the owner no longer says anything the best of the history as it
is at that moment takes over.

What a call moves follows from its limit: of a key, however many facts it has, two
facts from notes outside the call are carried (the best, and the best that differs
from it), found by aggregates that are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..config import (
    BACKFILL_LIMIT,
    DEFAULT_SYNC_LIMIT,
    EXTRACTOR_VERSION,
    MAX_BACKFILL_ROUNDS,
    MAX_ERROR_CHARS,
    MAX_SYNC_LIMIT,
    STATE_POLARITIES,
    WINNER_RANK,
)
from ..functions.text import js_trim, utf16_length, utf16_prefix
from ..shipping import ship
from ..sources.store import Commit, Snapshot, TableStore
from ..storage import cut
from . import drafts, ledger

#: The tables of a ledger and the column by which rows of each are replaced.
TABLES = {"fact_events": "source_note_id", "fact_index": "note_id", "current_state": "state_key", "ledger_meta": None}

DRAFTS = (
    "array<struct<entity:string,attribute:string,value_text:string,claim:string,raw_span:string,"
    "value_num:double,unit:string,polarity:string,confidence:double,as_of:string>>"
)
EVENTS = (
    "fact_id string, source_note_id string, source_content_hash string, entity string, attribute string, state_key string, claim string, "
    "value_text string, value_num double, unit string, polarity string, as_of timestamp, confidence double, raw_span string, extractor_version string"
)
INDEX = (
    "note_id string, content_hash string, status string, extractor_version string, processed_at timestamp, fact_count long, "
    "attempts long, error string, content_length long, note_ts timestamp"
)
STATE = (
    "state_key string, entity string, attribute string, claim string, value_text string, value_num double, unit string, polarity string, "
    "as_of timestamp, confidence double, source_note_id string, source_fact_id string, previous_value_text string, previous_claim string, "
    "previous_as_of timestamp, previous_source_note_id string, updated_at timestamp"
)

#: Chunks (note_id, chunk, chunks, chunk_text, note_ts, derived) to (note_id, chunk, drafts, error): a call of the model, as columns.
Model = Callable[[DataFrame], DataFrame]


# --- one note's facts


def extract_facts(notes: DataFrame, model: Model, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """The facts of notes (note_id, content, content_hash, note_ts), and what became of each note.

    Events are (see ``EVENTS``) with ``position``; outcomes are (note_id, status,
    fact_count, error).  Short and test notes are skipped before the model is
    asked, a note without a usable draft afterwards; a note of which any chunk has an
    error fails and has no facts.  Drafts are numbered over all chunks after the
    unusable ones are dropped.
    """
    text = js_trim(F.col("content"))
    judged = notes.select("note_id", text.alias("content"), "content_hash", F.col("note_ts").cast("timestamp").alias("note_ts"))
    judged = cut(judged.withColumn("reason", drafts.skip_reason(F.col("content"))).withColumn("derived", drafts.is_derived_analysis(F.col("content"))), "judged-notes")
    chunks = drafts.chunk_notes(judged.filter("reason is null"))
    count = F.count(F.lit(1)).over(Window.partitionBy("note_id"))
    asked = chunks.withColumn("chunks", count).join(judged.select("note_id", "note_ts", "derived"), "note_id")
    answers = cut(model(asked).select("note_id", "chunk", F.col("drafts").cast(DRAFTS).alias("drafts"), F.col("error").cast("string").alias("error")), "model-answers")

    failed = answers.filter("error is not null").groupBy("note_id").agg(F.min(F.struct("chunk", "error"))["error"].alias("error"))
    failed = failed.select("note_id", utf16_prefix(F.col("error"), MAX_ERROR_CHARS).alias("error"))
    raw = answers.join(failed, "note_id", "left_anti").select("note_id", "chunk", F.posexplode("drafts").alias("at", "d")).select("note_id", "chunk", "at", "d.*")
    usable = drafts.normalise_drafts(raw, unicode)
    # the drafts of one note
    numbered = usable.withColumn("idx", (F.row_number().over(Window.partitionBy("note_id").orderBy("chunk", "at")) - 1).cast("long"))
    known = judged.select("note_id", "content_hash", "note_ts", "derived")
    events = drafts.to_events(numbered.withColumnRenamed("as_of", "draft_as_of").join(known, "note_id"), unicode)
    kept = ledger.dedupe_facts(events, "idx")
    events = cut(
        kept.select(
            "fact_id", "source_note_id", F.col("content_hash").alias("source_content_hash"), "entity", "attribute", "state_key", "claim", "value_text",
            "value_num", "unit", "polarity", "as_of", drafts.demoted_confidence(F.col("confidence"), F.col("polarity"), F.col("derived")).alias("confidence"),
            "raw_span", F.lit(EXTRACTOR_VERSION).alias("extractor_version"), "position",
        ),
        "extracted",
    )
    counts = events.groupBy(F.col("source_note_id").alias("note_id")).agg(F.count(F.lit(1)).alias("n"))
    found = judged.select("note_id", "reason").join(failed, "note_id", "left").join(counts, "note_id", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n") > 0, "done").otherwise("skipped")
    error = F.coalesce("error", F.when(F.col("n").isNull(), F.coalesce("reason", F.lit("no_signal"))))
    return events, found.select("note_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("fact_count"), error.alias("error"))


# --- the current state, in order of the notes


_FACT = ("fact_id", "entity", "attribute", "claim", "value_text", "value_num", "unit", "polarity", "as_of", "confidence", "source_note_id")


def _fact_struct() -> Column:
    """A fact as the fold carries it; times as microseconds."""
    return F.struct(*[(F.unix_micros(F.col(c).cast("timestamp")) if c == "as_of" else F.col(c)).alias(c) for c in _FACT])


def _order(fact: Row) -> tuple:
    """The first in this order wins: newest, then by polarity, then the more confident."""
    return -fact["as_of"], -WINNER_RANK.get(fact["polarity"], 0), -fact["confidence"]


def _beats(fact: Row, state: dict) -> bool:
    a, b = (fact["as_of"], WINNER_RANK.get(fact["polarity"], 0)), (state["as_of"], WINNER_RANK.get(state["polarity"], 0))
    return a > b or (a == b and fact["confidence"] >= state["confidence"])


def state_after(fact: Row, before: dict | None) -> dict:
    """The state that a fact makes; a value that it changes becomes the previous one, else what was previous stays."""
    out = {c: fact[c] for c in _FACT}
    for c in ("value_text", "claim", "as_of", "source_note_id"):
        changed = before is not None and before["value_text"] != fact["value_text"]
        out[f"previous_{c}"] = before[c] if changed else before[f"previous_{c}"] if before else None
    return out


def _from_history(history: list[Row], owned: dict) -> dict | None:
    """The best of what is left takes over from a state whose note no longer says it."""
    if not history:
        return None
    best = min(history, key=lambda f: (*_order(f), f["fact_id"]))
    others = [f for f in history if (f["value_text"], f["as_of"]) != (best["value_text"], best["as_of"])]
    if others:
        then = min(others, key=lambda f: (*_order(f), f["fact_id"]))
        owned = owned | {c: then[c] for c in ("value_text", "claim", "as_of", "source_note_id")}
    return state_after(best, owned)


def fold_key(state: dict | None, steps: list[Row], facts: list[Row]) -> tuple[dict | None, bool]:
    """A key's state after the notes of a call that touch it, and whether it changed.

    ``steps`` (seq, note_id) are in order.  ``facts`` (fact, position, since,
    until) are the key's: a fact is there at step s if since <= s < until.
    """
    changed = False
    for step in steps:
        own = [f for f in facts if f["since"] == step["seq"]]
        if own:
            best = min(own, key=lambda f: (*_order(f["fact"]), f["position"]))["fact"]
            if state is None or state["source_note_id"] == step["note_id"] or _beats(best, state):
                state, changed = state_after(best, state), True
        elif state is not None and state["source_note_id"] == step["note_id"]:
            state, changed = _from_history([f["fact"] for f in facts if f["since"] <= step["seq"] < f["until"]], state), True
    return state, changed


def refresh_state(state: DataFrame, facts: DataFrame, steps: DataFrame, new: DataFrame, clock: Column) -> tuple[DataFrame, DataFrame]:
    """State rows that change (see ``STATE``), and all keys that change (a key without a row goes).

    ``facts`` are those before the call, ``steps`` (note_id, seq, applied) the
    notes of the call in order, all of whose old facts go at their step; ``new``
    are the facts of the applied ones.
    """
    ship(state.sparkSession)
    never = F.lit(1 << 62).cast("long")
    last, first = F.lit(0).cast("long"), F.col("seq")
    eligible = F.col("polarity").isin(*STATE_POLARITIES)
    # written, as a note's facts are joined with the steps several times
    old = cut(facts.join(F.broadcast(steps), F.col("source_note_id") == F.col("note_id")).select("state_key", "seq", "applied", eligible.alias("eligible"), _fact_struct().alias("fact")), "old-facts")
    new = new.join(F.broadcast(steps), F.col("source_note_id") == F.col("note_id")).select("state_key", "seq", "applied", eligible.alias("eligible"), "position", _fact_struct().alias("fact"))
    touched = old.filter("applied").select("state_key", "seq").unionByName(new.filter("eligible").select("state_key", "seq")).distinct()
    touched = touched.join(F.broadcast(steps.select("seq", "note_id")), "seq")
    keys = cut(touched.groupBy("state_key").agg(F.sort_array(F.collect_list(F.struct("seq", "note_id"))).alias("steps")), "touched-keys")

    # a note loses a key at its own step only, so history is asked where a note of the call owns the state
    owned = state.join(F.broadcast(steps.select(F.col("note_id").alias("source_note_id"))), "source_note_id", "left_semi")
    here = cut(keys.select("state_key").join(owned.select("state_key"), "state_key", "left_semi"), "owned-keys")
    outside = facts.filter(eligible).join(F.broadcast(steps.select(F.col("note_id").alias("source_note_id"))), "source_note_id", "left_anti").join(here, "state_key", "left_semi")
    row = lambda since, until, position: F.struct("fact", position.cast("long").alias("position"), since.alias("since"), until.alias("until")).alias("f")
    told = ledger.two_best(outside, _fact_struct()).withColumnRenamed("best", "fact").select("state_key", row(last, never, F.lit(0)))
    told = told.unionByName(old.filter("eligible").select("state_key", row(last, first, F.lit(0))))
    told = told.unionByName(new.filter("eligible").select("state_key", row(first, never, F.col("position"))))
    told = told.groupBy("state_key").agg(F.collect_list("f").alias("facts"))

    fields = [f.strip().split() for f in STATE.split(",")]
    carried = [c if c != "source_fact_id" else "fact_id" for c, _ in fields if c not in ("state_key", "updated_at")]
    times = ("as_of", "previous_as_of")
    now = state.select("state_key", F.struct(*[(F.unix_micros(c) if c in times else F.col("source_fact_id" if c == "fact_id" else c)).alias(c) for c in carried]).alias("state"))
    kinds = {c: "long" if c in times else kind for c, kind in fields} | {"fact_id": "string"}
    schema = "state_key string, gone boolean, " + ", ".join(f"{c} {kinds[c]}" for c in carried)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, steps, facts, held in zip(batch["state_key"], batch["steps"], batch["facts"], batch["state"], strict=True):
                after, changed = fold_key(held, list(steps), [] if facts is None else list(facts))
                if changed:
                    rows.append((key, after is None, *[None if after is None else after[c] for c in carried]))
            if rows:
                out = pd.DataFrame(rows, columns=["state_key", "gone", *carried])
                yield out.astype({c: "Int64" for c in times})

    told = keys.join(told, "state_key", "left").join(now, "state_key", "left")
    after = cut(told.select("state_key", "steps", "facts", "state").mapInPandas(fold, schema), "state-after")
    made = [clock.cast(kind).alias(c) if c == "updated_at" else F.timestamp_micros(c).alias(c) if c in times else F.col("fact_id" if c == "source_fact_id" else c).cast(kind).alias(c) for c, kind in fields]
    return after.filter("not gone").select(*made), after.select("state_key")


# --- counters


@dataclass(frozen=True)
class Meta:
    """What the ledger knows of itself without reading its tables."""

    extractor_version: str
    total_notes: int
    processed_for_version: int
    remaining_dirty: int
    index_count: int
    current_state_count: int
    n_done: int
    n_skipped: int
    n_failed: int
    n_pending: int
    stale_version: int

    @classmethod
    def empty(cls, total: int) -> Meta:
        return cls(EXTRACTOR_VERSION, total, 0, total, 0, 0, 0, 0, 0, total, total)


@dataclass(frozen=True)
class Result:
    processed: int
    failed: int
    skipped: int
    facts_written: int
    remaining_dirty: int
    dirty_total: int


def counted(before: Meta | None, total: int, allowed: int, scanned: int, limit: int, processed: int, failed: int, skipped: int) -> Meta:
    """The counters after a call, without a count over all notes.

    ``allowed`` notes could be looked at and ``scanned`` were, until ``limit``
    had been processed; ``total`` are all notes.
    """
    if before is None or before.extractor_version != EXTRACTOR_VERSION:
        meta = Meta.empty(total)
    else:
        meta = replace(before, total_notes=total, remaining_dirty=max(0, before.remaining_dirty + max(0, total - before.total_notes)))
    done = min(total, meta.processed_for_version + processed - failed)
    stopped = processed >= limit and scanned < allowed
    if stopped:
        # a ledger that has just begun knows better than its estimate
        remaining = max(0, total - done) if done <= processed else max(0, meta.remaining_dirty - processed)
    elif processed < limit:
        remaining = 0
    else:
        remaining = max(0, meta.remaining_dirty - processed)
    if processed == 0 and scanned >= total:
        remaining, done = 0, total
    return replace(
        meta, processed_for_version=done, remaining_dirty=remaining, stale_version=remaining, index_count=max(meta.index_count, done),
        n_done=meta.n_done + processed - failed - skipped, n_skipped=meta.n_skipped + skipped, n_failed=meta.n_failed + failed,
    )


# --- the call


def clamp_limit(limit: float | None) -> int:
    """Between 1 and 40, 15 where none is given."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")):
        return DEFAULT_SYNC_LIMIT
    return max(1, min(MAX_SYNC_LIMIT, int(limit // 1)))


def create(store: TableStore, facts: DataFrame, index: DataFrame, state: DataFrame) -> Snapshot:
    """Begin a ledger from tables that have at least the columns of ``EVENTS``, ``INDEX`` and ``STATE`` that aren't null."""

    def begin(commit: Commit) -> None:
        for table, df, schema in (("fact_events", facts, EVENTS), ("fact_index", index, INDEX), ("current_state", state, STATE)):
            fields = [f.strip().split() for f in schema.split(",")]
            commit.replace(table, df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields]))

    return store.update(begin)


def read_meta(commit: Commit) -> Meta | None:
    """The counters, from the one row of their table."""
    row = commit.read("ledger_meta").first() if commit.exists("ledger_meta") else None
    return Meta(**{c: row[c] for c in Meta.__dataclass_fields__}) if row else None


def write_meta(commit: Commit, meta: Meta, clock: Column) -> None:
    """Upsert the one row of the counters."""
    columns = [F.lit(getattr(meta, c)).cast("long" if isinstance(getattr(meta, c), int) else "string").alias(c) for c in Meta.__dataclass_fields__]
    commit.replace("ledger_meta", commit.store.spark.range(1).select(*columns, clock.cast("timestamp").alias("last_sync_at"), clock.cast("timestamp").alias("updated_at")))


def sync(store: TableStore, notes: DataFrame, model: Model, limit: int = 3, only: DataFrame | None = None, clock: Column | None = None, unicode: bool = True) -> Result:
    """Process the newest ``limit`` notes that need it, and commit facts, state, index and counters together.

    ``notes``: note_id, content, content_hash, note_ts.  ``only`` (note_id)
    restricts the call to some notes.  A failing note loses its old facts, keeps
    the number of its last ones in the index, and leaves the state alone.
    """
    clock = F.current_timestamp() if clock is None else clock
    out: list[Result] = []

    def change(commit: Commit) -> None:
        out[:] = [_sync(commit, notes, model, limit, only, clock, unicode)]

    store.update(change)
    return out[0]


def _sync(commit: Commit, notes: DataFrame, model: Model, limit: int, only: DataFrame | None, clock: Column, unicode: bool) -> Result:
    index, facts = commit.read("fact_index"), commit.read("fact_events")
    meant = notes if only is None else notes.join(only.select("note_id").distinct(), "note_id", "left_semi")
    seen = Observation()
    judged = ledger.with_index(meant.select("note_id", "content_hash", "note_ts"), index).observe(seen, F.count(F.lit(1)).alias("n"))
    newest = [F.col("note_ts").desc(), F.col("note_id")]
    # at most ``limit`` rows; ``seq`` is their order
    queue = judged.filter("dirty").orderBy(*newest).limit(limit).withColumn("seq", F.row_number().over(Window.orderBy(*newest)).cast("long"))
    queue = cut(queue.select("note_id", "note_ts", "seq", F.col("i_attempts").cast("long").alias("attempts"), F.col("i_fact_count").alias("old_count")), "queue")
    processed = queue.count()
    allowed = seen.get["n"]
    total = allowed if only is None else notes.count()

    # the contents of at most ``limit`` notes, read once
    work = cut(notes.select("note_id", "content", "content_hash", "note_ts").join(F.broadcast(queue.select("note_id")), "note_id", "left_semi"), "work")
    events, outcomes = extract_facts(work, model, unicode)
    told = cut(queue.join(outcomes, "note_id"), "outcomes")
    counts = told.agg(F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped"), F.max(F.struct("seq", "note_ts", "note_id")).alias("last")).first()
    last = counts["last"]
    scanned = allowed
    if processed >= limit:
        at = (F.col("note_ts") > F.lit(last["note_ts"])) | ((F.col("note_ts") == F.lit(last["note_ts"])) & (F.col("note_id") <= last["note_id"]))
        scanned = meant.filter(at).count()

    steps = told.select("note_id", "seq", (F.col("status") != "failed").alias("applied"))
    rows, changed = refresh_state(commit.read("current_state"), facts, steps, events, clock)
    written, _ = commit.change("fact_events", events, told.select(F.col("note_id").alias("source_note_id")))
    commit.change("current_state", rows, changed)
    entries = told.join(work.select("note_id", "content_hash", utf16_length(js_trim(F.col("content"))).alias("content_length")), "note_id")
    fact_count = F.when(F.col("status") == "failed", F.coalesce("old_count", F.lit(0))).otherwise(F.col("fact_count"))
    commit.upsert(
        "fact_index",
        entries.select(
            "note_id", "content_hash", "status", F.lit(EXTRACTOR_VERSION).alias("extractor_version"), clock.alias("processed_at"), fact_count.alias("fact_count"),
            (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), "error", "content_length", "note_ts",
        ),
    )
    meta = counted(read_meta(commit), total, allowed, scanned, limit, processed, counts["failed"], counts["skipped"])
    write_meta(commit, meta, clock)
    commit.stamp(extractor_version=EXTRACTOR_VERSION)
    return Result(processed, counts["failed"], counts["skipped"], written, meta.remaining_dirty, processed + meta.remaining_dirty)


def backfill(store: TableStore, notes: DataFrame, model: Model, limit: float | None = BACKFILL_LIMIT, rounds: int = MAX_BACKFILL_ROUNDS, **options) -> list[Result]:
    """Calls until nothing remains, a call finds nothing to do, or ``rounds`` are over; one result for each."""
    done: list[Result] = []
    while len(done) < rounds:
        done.append(sync(store, notes, model, clamp_limit(limit), **options))
        if not done[-1].remaining_dirty or not done[-1].processed:
            break
    return done


def rounds_table(spark: SparkSession, done: list[Result]) -> DataFrame:
    """A row for each round, with the totals so far."""
    processed = facts = 0
    rows = []
    for i, r in enumerate(done):
        processed, facts = processed + r.processed, facts + r.facts_written
        rows.append((i + 1, r.processed, r.failed, r.skipped, r.facts_written, r.remaining_dirty, processed, facts))
    return spark.createDataFrame(rows, "round long, processed long, failed long, skipped long, facts_written long, remaining long, processed_so_far long, facts_so_far long")
