"""The fact sync on hand-written notes: what fails, what is skipped, who owns a state, and the counters."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.functions.text import utf16_prefix
from quillspark.operators import fact_sync
from quillspark.sources.store import TableStore

DAY = datetime(2024, 1, 1)
def clock_():
    return F.lit("2024-02-01").cast("timestamp")



def draft(value, attribute="rent", polarity="decision", as_of="2024-01-05", confidence=0.9):
    text = f"The office has {attribute} of {value} per month"
    return Row(entity="Office", attribute=attribute, value_text=value, claim=text, raw_span=text, value_num=None, unit=None, polarity=polarity, confidence=confidence, as_of=as_of)


def model_of(spark, said, errors=()):
    answers = spark.createDataFrame([(n, d) for n, d in said.items()], f"note_id string, said {fact_sync.DRAFTS}")

    def call(chunks):
        out = chunks.join(answers, "note_id", "left").withColumn("drafts", F.when(F.col("chunk") == 0, F.col("said")))
        return out.withColumn("error", F.when(F.col("note_id").isin(*errors, "-"), F.concat(F.lit("bad "), F.repeat(F.lit("😀"), 400))))

    return call


def notes_of(spark, *rows):
    frame = spark.createDataFrame([(n, text, DAY.replace(day=day)) for n, text, day in rows], "note_id string, content string, note_ts timestamp")
    return frame.withColumn("content_hash", F.sha1("content"))


@pytest.fixture
def store(spark, tmp_path):
    out = TableStore(spark, str(tmp_path / "ledger"), fact_sync.TABLES)
    empty = lambda schema: spark.createDataFrame([], schema)
    fact_sync.create(out, empty(fact_sync.EVENTS), empty(fact_sync.INDEX), empty(fact_sync.STATE))
    return out


def index_of(store):
    return {r["note_id"]: (r["status"], r["attempts"], r["fact_count"], r["error"]) for r in store.read("fact_index").collect()}


def state_of(store):
    return {r["state_key"]: (r["value_text"], r["source_note_id"], r["previous_value_text"], r["previous_source_note_id"]) for r in store.read("current_state").collect()}


LONG = "A long enough note about the office."


def test_notes_fail_are_skipped_and_are_replaced(spark, store):
    notes = notes_of(spark, ("a", LONG, 1), ("b", LONG + "b", 2), ("c", "short", 3), ("d", LONG + "d", 4), ("e", LONG + "e", 5))
    said = {"a": [draft("10"), draft("", "area"), draft("11", "area")], "b": [draft("20", as_of="2024-01-06")], "d": [draft("30")]}
    first = fact_sync.sync(store, notes, model_of(spark, said, ["d"]), limit=10, clock=clock_())
    assert (first.processed, first.failed, first.skipped, first.facts_written, first.remaining_dirty) == (5, 1, 2, 3, 0)
    got = index_of(store)
    assert got["a"] == ("done", 1, 2, None) and got["b"] == ("done", 1, 1, None)
    assert got["c"] == ("skipped", 1, 0, "too_short") and got["e"] == ("skipped", 1, 0, "no_signal")
    # 500 UTF-16 units, and no character cut in two: "bad " and 248 of two units each
    assert got["d"] == ("failed", 1, 0, "bad " + "😀" * 248)
    assert state_of(store) == {"office|rent": ("20", "b", None, None), "office|area": ("11", "a", None, None)}
    assert [r["source_note_id"] for r in store.read("fact_events").collect()].count("d") == 0

    # the failed note is tried again and wins by its time; b, the owner until then, goes back in time and changes nothing of d
    said |= {"d": [draft("30", as_of="2024-01-09")]}
    again = notes_of(spark, ("a", LONG, 1), ("b", LONG + "b, changed", 2), ("c", "short", 3), ("d", LONG + "d", 4), ("e", LONG + "e", 5))
    said["b"] = [draft("19", as_of="2023-01-01")]
    second = fact_sync.sync(store, again, model_of(spark, said), limit=1, clock=clock_())
    assert (second.processed, second.failed) == (1, 0) and index_of(store)["d"] == ("done", 2, 1, None)
    assert state_of(store)["office|rent"] == ("30", "d", "20", "b")
    fact_sync.sync(store, again, model_of(spark, said), limit=1, clock=clock_())
    assert state_of(store)["office|rent"] == ("30", "d", "20", "b") and index_of(store)["b"][:3] == ("done", 2, 1)
    last = fact_sync.sync(store, again, model_of(spark, said), limit=2, clock=clock_())
    assert (last.processed, last.remaining_dirty) == (0, 0)
    meta = store.read("ledger_meta").first()
    assert (meta["total_notes"], meta["remaining_dirty"], meta["n_failed"], meta["last_sync_at"]) == (5, 0, 1, datetime(2024, 2, 1))


def test_history_takes_over_where_the_owner_falls_silent(spark, store):
    notes = notes_of(spark, ("a", LONG, 1), ("b", LONG + "b", 2), ("c", LONG + "c", 3))
    said = {"a": [draft("1", as_of="2024-01-01")], "b": [draft("2", as_of="2024-01-02")], "c": [draft("3", as_of="2024-01-03"), draft("x", "fee")]}
    fact_sync.sync(store, notes, model_of(spark, said), limit=10, clock=clock_())
    assert state_of(store) == {"office|rent": ("3", "c", None, None), "office|fee": ("x", "c", None, None)}
    silent = notes_of(spark, ("a", LONG, 1), ("b", LONG + "b", 2), ("c", LONG + "c, changed", 3))
    said["c"] = None
    fact_sync.sync(store, silent, model_of(spark, said), limit=10, clock=clock_())
    # the best of the history, superseding the second of the history; a key that nobody speaks of goes
    assert state_of(store) == {"office|rent": ("2", "b", "1", "a")}
    assert index_of(store)["c"] == ("skipped", 2, 0, "no_signal")


def test_only_some_notes(spark, store):
    notes = notes_of(spark, ("a", LONG, 1), ("b", LONG + "b", 2), ("c", LONG + "c", 3))
    only = spark.createDataFrame([("a",), ("a",), ("z",)], "note_id string")
    got = fact_sync.sync(store, notes, model_of(spark, {"a": [draft("1")]}), limit=10, only=only, clock=clock_())
    assert got.processed == 1 and set(index_of(store)) == {"a"}


def test_a_broken_model_call_leaves_all_tables_as_they_were(spark, store):
    notes = notes_of(spark, ("a", LONG, 1))
    fact_sync.sync(store, notes, model_of(spark, {"a": [draft("1")]}), limit=10, clock=clock_())
    before = store.snapshot()

    def broken(chunks):
        return chunks.withColumn("drafts", F.lit(None)).withColumn("error", F.raise_error(F.lit("no model")).cast("string"))

    with pytest.raises(Exception, match="no model"):
        fact_sync.sync(store, notes_of(spark, ("a", LONG + "!", 1)), broken, limit=10, clock=clock_())
    assert store.snapshot() == before and state_of(store)["office|rent"][0] == "1"


def test_the_owner_may_go_back_in_time_within_a_call():
    fact = lambda i, value, at, note, polarity="decision", confidence=0.5: Row(fact_id=i, entity="e", attribute="a", claim=f"c{value}", value_text=value, value_num=None, unit=None, polarity=polarity, as_of=at, confidence=confidence, source_note_id=note)
    row = lambda f, since, until=1 << 62, position=0: Row(fact=f, position=position, since=since, until=until)
    step = lambda seq, note: Row(seq=seq, note_id=note)
    held = fact_sync.state_after(fact("1", "v", 10, "n1"), None)
    after, changed = fact_sync.fold_key(held, [step(1, "n1"), step(2, "n2")], [row(fact("2", "w", 5, "n1"), 1), row(fact("3", "x", 4, "n2"), 2)])
    assert changed and (after["value_text"], after["previous_value_text"], after["as_of"]) == ("w", "v", 5)
    # of a note's own facts the newest counts, then the rank, then the confidence, then the place
    own = [row(fact("4", "p", 9, "n1", "plan", 1.0), 1, position=0), row(fact("5", "q", 9, "n1", "identity", 0.2), 1, position=1), row(fact("6", "r", 9, "n1", "constraint", 0.2), 1, position=2)]
    assert fact_sync.fold_key(held, [step(1, "n1")], own)[0]["value_text"] == "q"
    # another note that says the same at the same time takes over and keeps what was superseded
    same = fact_sync.fold_key(after, [step(1, "n3")], [row(fact("7", "w", 5, "n3"), 1)])[0]
    assert (same["source_note_id"], same["previous_value_text"]) == ("n3", "v")
    assert fact_sync.fold_key(after, [step(1, "n3")], [row(fact("8", "z", 5, "n3", confidence=0.4), 1)]) == (after, False)
    assert fact_sync.fold_key(held, [step(1, "n1")], [row(fact("1", "v", 10, "n1"), 0, 1)]) == (None, True)


def test_limits():
    assert [fact_sync.clamp_limit(x) for x in (None, 0, -3, 1, 7.9, 40, 41, 1e9, float("nan"), float("inf"))] == [15, 1, 1, 1, 7, 40, 40, 40, 15, 15]


def test_counters():
    first = fact_sync.counted(None, total=100, allowed=100, scanned=30, limit=10, processed=10, failed=2, skipped=3)
    assert (first.processed_for_version, first.remaining_dirty, first.n_done, first.n_skipped, first.n_failed, first.index_count) == (8, 92, 5, 3, 2, 8)
    more = fact_sync.counted(first, total=105, allowed=105, scanned=50, limit=10, processed=10, failed=0, skipped=0)
    assert (more.processed_for_version, more.remaining_dirty, more.total_notes) == (18, 87, 105)
    assert fact_sync.counted(more, 105, 105, 105, 10, 4, 0, 0).remaining_dirty == 0
    assert fact_sync.counted(more, 105, 105, 105, 10, 10, 0, 0).remaining_dirty == 77
    done = fact_sync.counted(more, 105, 105, 105, 10, 0, 0, 0)
    assert (done.processed_for_version, done.remaining_dirty) == (105, 0)
    old = fact_sync.Meta(**{**vars(more), "extractor_version": "v0"})
    assert fact_sync.counted(old, 20, 20, 20, 30, 0, 0, 0).processed_for_version == 20


def test_backfill_ends(monkeypatch):
    calls = []

    def sync(store, notes, model, limit, **options):
        calls.append(limit)
        return fact_sync.Result(limit, 0, 0, 1, remaining[len(calls)] if len(calls) < len(remaining) else 1, 0)

    monkeypatch.setattr(fact_sync, "sync", sync)
    remaining = [9, 5, 3, 0]
    assert [r.remaining_dirty for r in fact_sync.backfill(None, None, None, limit=99)] == [5, 3, 0] and calls == [40] * 3
    remaining, calls = [], []
    assert len(fact_sync.backfill(None, None, None)) == 80 and set(calls) == {12}


@pytest.mark.parametrize("units", [1, 2, 3, 5, 6])
def test_utf16_prefix(spark, units):
    texts = ["", "abc", "😀", "a😀b", "😀😀😀", "ab😀cd", "éàü€x", "abcdef", "ab\ncd😀", None]
    want = []
    for t in texts:
        cut = None if t is None else t.encode("utf-16-le")[: 2 * units].decode("utf-16-le", errors="ignore")
        want.append((t, cut))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted(map(str, map(tuple, df.select("t", utf16_prefix(F.col("t"), units)).collect()))) == sorted(map(str, want))
