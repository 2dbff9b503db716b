"""Hand-written rows for the points where semantics are easy to get wrong."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.config import PROFILES
from quillspark.functions import coercion, scoring, text
from quillspark.operators import drafts, ledger, message_log, model_json, note_index, render, retrieval
from quillspark.sources import exports, feed

DAY = datetime(2024, 1, 31)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def notes(spark, contents, start=DAY):
    rows = [(f"n{i}", c, start - timedelta(hours=i), len(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "note_id string, content string, note_ts timestamp, content_length int")




def newest():
    return [-F.unix_millis(F.col("note_ts")), F.col("note_id")]


def fold(lengths, budget):
    """The packing rule, one line after the other."""
    total, picked = 0, []
    for i, n in enumerate(lengths):
        if total + n > budget:
            continue
        picked.append(i)
        total += n + 1
        if total >= budget:
            break
    return picked


PREFIX = len("[1/31/2024] ")


@pytest.mark.parametrize("budget", [30, 60, 100, 200, 1000])
def test_packing_skips_and_goes_on(spark, budget):
    r = random.Random(budget)
    contents = ["x" * r.randint(1, 40) for _ in range(60)]
    contents[0] = "x"
    got = retrieval.greedy_pack(notes(spark, contents), newest(), budget, "date").orderBy("pick").collect()
    lengths = [len(text_) + len(f"[{(DAY - timedelta(hours=i)).month}/{(DAY - timedelta(hours=i)).day}/2024] ") for i, text_ in enumerate(contents)]
    assert [r["note_id"] for r in got] == [f"n{i}" for i in fold(lengths, budget)]


def test_first_note_beyond_the_budget_is_cut(spark):
    got = retrieval.greedy_pack(notes(spark, ["y" * 500, "z"]), newest(), 200, "date").orderBy("pick").collect()
    assert [(r["note_id"], r["cut_to"]) for r in got] == [("n0", 168), ("n1", None)]
    got = retrieval.greedy_pack(notes(spark, ["y" * 500, "z"]), newest(), 0, "date").collect()
    assert [(r["note_id"], r["cut_to"]) for r in got] == [("n0", 120)]
    assert retrieval.greedy_pack(notes(spark, []), newest(), 100, "date").count() == 0


def test_sweep_counts_the_newline(spark):
    scored = notes(spark, ["aa", "bb"]).withColumn("score", F.lit(1.0))
    assert retrieval.sweep_pack(scored, PREFIX + 2, "date").count() == 0
    assert retrieval.sweep_pack(scored, PREFIX + 3, "date").count() == 1


def test_adding_recent_notes_changes_nothing(spark):
    r = random.Random(3)
    rows = [(f"n{i}", DAY - timedelta(days=r.randrange(100)), 10, 0.5, r.random(), 0.0, r.random()) for i in range(300)]
    scored = spark.createDataFrame(rows, "note_id string, note_ts timestamp, content_length int, similarity double, recency double, keyword double, score double")
    for name in ("chat", "reframe"):
        a, b = retrieval.top_candidates(scored, PROFILES[name]), retrieval.union_recent(scored, PROFILES[name])
        assert {r["note_id"] for r in a.collect()} == {r["note_id"] for r in b.collect()}


def test_coverage_swaps_the_last_pick(spark):
    p = PROFILES["reframe"]
    rows = [(f"n{i:02d}", DAY, 10, 0.5, 0.9 if i == 30 else 0.1, 0.0, 1 - i / 100) for i in range(40)]
    scored = spark.createDataFrame(rows, "note_id string, note_ts timestamp, content_length int, similarity double, recency double, keyword double, score double")
    got = {r["note_id"] for r in retrieval.selection(scored, p).collect()}
    assert got == {f"n{i:02d}" for i in [*range(19), 30]}


def test_recency_and_density(spark):
    p = PROFILES["chat"]
    now = 1706659200000
    score = lambda ts: one(spark, scoring.recency(F.lit(ts).cast("timestamp"), now, p))
    assert score("2025-01-01") == 1.0  # the future clamps
    assert score(None) == 0.0
    assert score("2024-01-31") == 1.0
    assert score("2023-12-31 00:00:00") == pytest.approx(1 / (1 + 31 / 21))
    assert one(spark, scoring.density_bonus(F.lit(150), p)) == 0
    assert one(spark, scoring.density_bonus(F.lit(0), p)) == 0
    assert one(spark, scoring.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))) == 3.0
    assert one(spark, scoring.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, scoring.query_terms(F.lit("What IS the e-mail of the a-b-c about, e-mail?"))) == ["the", "e-mail", "a-b-c"]


def test_text(spark):
    assert one(spark, text.js_trim(F.lit(" ﻿ a b\n"))) == "a b"
    assert one(spark, text.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, text.js_round(F.lit(-2.5))) == -2
    assert one(spark, text.join_nonempty([F.lit("a"), F.lit(None).cast("string"), F.lit("")], " · ")) == "a"
    assert one(spark, text.document_id(F.lit("a|b?>"))) == "YXxiPz4"
    assert one(spark, text.duration_label(F.lit(125.7))) == "02:05"
    assert one(spark, text.stamp(F.lit("2024-01-05 14:03:00").cast("timestamp"), "datetime")) == "Fri, Jan 5, 2024, 02:03 PM"
    assert one(spark, text.stamp(F.lit(None).cast("timestamp"), "date")) == "Unknown date"
    assert one(spark, text.iso(F.lit(None).cast("timestamp"))) == "1970-01-01T00:00:00.000Z"


def test_scores(spark):
    value = lambda s: one(spark, coercion.score(F.parse_json(F.lit(s))))
    assert [value(s) for s in ("12", "0", "null", '""', '"7"', '"x"', "2.5", "true")] == [10, 1, 1, 1, 7, 5, 3, 1]
    assert one(spark, coercion.score(F.lit(None).cast("variant"))) == 5
    assert one(spark, coercion.confidence(F.lit(float("nan")))) == 0.6
    assert one(spark, coercion.confidence(F.lit(1.7))) == 1.0
    assert one(spark, coercion.finite_or_null(F.lit("x"))) is None
    assert one(spark, coercion.embedding(F.lit(None).cast("array<float>"), F.lit('[1, "a", 2]'))) == [1.0, 2.0]


LOG = "id string, content string, type string, ts timestamp, source string, ord int"


def test_merge_keeps_absent_and_overrides_with_null(spark):
    old = spark.createDataFrame([("a", "x", "note", DAY, "s", 0), (None, "y", None, DAY, "s", 1)], LOG)
    new = spark.createDataFrame([("a", None, "question", DAY, None, 0)], LOG).withColumn("present_content", F.lit(True)).withColumn("present_source", F.lit(False))
    got = {r["message_key"]: r for r in message_log.upsert_merge(old, new).collect()}
    a = got["id:a"]
    assert (a["content"], a["type"], a["source"], a["first_ord"]) == (None, "question", "s", 0)
    assert len(got) == 2 and any(k.startswith("unknown:2024-01-31T00:00:00.000Z:y") for k in got)


def test_merge_is_idempotent(spark):
    rows = [(f"m{i}", f"t{i}", "note", DAY, "s", i) for i in range(9)]
    log = spark.createDataFrame(rows, LOG)
    again = message_log.upsert_merge(log, log).select("id", "content", "type", "ts", "source")
    assert again.exceptAll(log.drop("ord")).count() == 0 and again.count() == 9


def test_shrink_guard(spark):
    ten, four = spark.range(10), spark.range(4)
    assert message_log.shrink_guard(ten, four).first()["rejected"]
    assert not message_log.shrink_guard(ten, spark.range(5)).first()["rejected"]
    assert not message_log.shrink_guard(ten, four, force=True).first()["rejected"]


def test_history_summary_stops_at_its_limit(spark):
    turns = spark.createDataFrame([(i, "user" if i % 2 else "model", "w" * 400) for i in range(8)], "ord int, role string, content string")
    got = message_log.history_summary(turns, total=700).orderBy("ord").collect()
    assert [r["ord"] for r in got] == [2, 3] and got[0]["line"] == "AI: " + "w" * 300 + "…"


def test_fingerprint_knows_no_order(spark):
    rows = [(f"n{i}", f"h{i}") for i in range(50)]
    prints = {note_index.fingerprint(spark.createDataFrame(random.Random(i).sample(rows, 50), "note_id string, content_hash string").repartition(i + 1)).first()[0] for i in range(3)}
    assert len(prints) == 1
    other = note_index.fingerprint(spark.createDataFrame(rows[:-1] + [("n49", "h")], "note_id string, content_hash string")).first()[0]
    assert other not in prints


FACT = "source_note_id string, fact_id string, state_key string, value_text string, polarity string, as_of timestamp, confidence double, entity string, attribute string, claim string, value_num double"


def fact(i, key, value, polarity, when, confidence, note="n"):
    return (note, f"{i:04x}", key, value, polarity, when, confidence, "e", "a", f"claim {i}", None)


def test_winner_and_predecessor(spark):
    later = DAY + timedelta(days=1)
    rows = [
        fact(1, "k", "1", "plan", later, 0.9), fact(2, "k", "2", "decision", later, 0.1), fact(3, "k", "2", "decision", DAY, 0.5), fact(4, "k", "9", "hypothesis", later, 1.0),
        fact(5, "only", "1", "hypothesis", DAY, 1.0),
        fact(6, "same", "1", "decision", later, 0.5), fact(7, "same", "1", "decision", later, 0.5),
    ]
    got = {r["state_key"]: r for r in ledger.current_state(spark.createDataFrame(rows, FACT)).collect()}
    assert set(got) == {"k", "same"}
    assert (got["k"]["source_fact_id"], got["k"]["previous_value_text"]) == ("0002", "1")
    assert (got["same"]["source_fact_id"], got["same"]["previous_value_text"]) == ("0006", None)


def test_dedupe_keeps_the_first_place(spark):
    rows = [fact(1, "k", "A", "plan", DAY, 0.5), fact(2, "z", "b", "plan", DAY, 0.5), fact(3, "k", "a", "plan", DAY, 0.8), fact(4, "k", "a", "plan", DAY, 0.8)]
    got = ledger.dedupe_facts(spark.createDataFrame(rows, FACT)).orderBy("position").collect()
    assert [(r["fact_id"], r["position"]) for r in got] == [("0003", "0001"), ("0002", "0002")]
    assert ledger.dedupe_facts(spark.createDataFrame([fact(i, f"k{i}", "v", "plan", DAY, 0.5) for i in range(60)], FACT)).count() == 40


def test_retry_limit(spark):
    n = spark.createDataFrame([(f"n{i}", "h", DAY) for i in range(3)], "note_id string, content_hash string, note_ts timestamp")
    index = spark.createDataFrame([("n0", "h", "failed", "v3", 3), ("n1", "h", "failed", "v3", 4)], "note_id string, content_hash string, status string, extractor_version string, attempts int")
    assert {r["note_id"] for r in ledger.dirty_queue(n, index, 9).collect()} == {"n0", "n2"}


def test_budgets():
    assert render.state_budget(28000) == 12000 and render.state_budget(10000) == 4500 and render.state_budget(-5) == 0
    assert render.notes_budget(28000, 0) == 28000 and render.notes_budget(1000, 900) == 0


DRAFT = "entity string, attribute string, value_text string, claim string, raw_span string, polarity string, confidence double"


def test_drafts(spark):
    long = "the rent of the north office is 900 a year and will stay so " * 5
    rows = [
        ("north office", "price", "900", "north office rent is 900 per month", "", "decision", 0.9),
        ("north office", "value", "900", "it is 900", "short", "plan", 0.5),
        ("north office", "rent", "900", "", long, "odd", float("nan")),
        ("north office", "rent", "9" * 241, "claim of enough length with north", "", "plan", 0.5),
        ("", "rent", "900", "north office rent is 900 per month", "", "plan", 0.5),
        ("north office", "amount", "1,200", "north office has 1200 chairs in it", "", "plan", 1.5),
    ]
    got = drafts.normalise_drafts(spark.createDataFrame(rows, DRAFT)).collect()
    assert [r["attribute"] for r in got] == ["subscription_price_monthly", "rent", "value_unspecified"]
    assert got[1]["claim"].endswith("…") and len(got[1]["claim"]) == 218
    assert (got[1]["polarity"], got[1]["confidence"], got[2]["confidence"]) == ("estimate", 0.6, 1.0)
    assert one(spark, drafts.state_key(F.lit(" Ｎorth  Office "), F.lit("Unit  Cost"))) == "north office|unit_cost"


@given(st.text(alphabet="ab \n.", max_size=300), st.integers(20, 60))
@settings(max_examples=60, deadline=None)
def test_chunks_cover_the_text(content, size):
    bounds = drafts.chunk_bounds(content, size, 5)
    assert all(b - a <= size for a, b in bounds)
    assert {i for a, b in bounds for i in range(a, b)} == set(range(len(content)))


def test_json_recovery():
    whole = {"objective": "grow", "list": ["a", "b, c"], "n": {"x": 1.5}}
    raw = json.dumps(whole)
    assert json.loads(model_json.recover("Sure:\n```json\n" + raw + "\n```")) == whole
    assert json.loads(model_json.recover("text {not json} " + raw + " more")) == whole
    assert json.loads(model_json.recover('{"a": "b", "c": "cut of')) == {"a": "b", "c": "cut of"}
    assert json.loads(model_json.recover('{"a": "b", ')) == {"a": "b"}
    assert model_json.recover("nothing here") is None and model_json.recover(None) is None and model_json.recover("") is None


@given(st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_json_prefixes_parse_or_are_refused(n):
    raw = json.dumps({"title": "a \"b\" c", "s": "x\\y", "deep": {"k": "v"}})
    found = model_json.recover(raw[:n])
    assert found is None or json.loads(found) is not None


def test_explore_document(spark):
    idea = {
        "title": " t ", "mechanism": "m", "whyNew": "w", "whyItCouldWorkHere": "h", "differsFromYourNotes": "d", "risks": ["r", " "], "noveltyScore": 12, "fitScore": 0,
        "experiment": {"name": "e", "steps": ["s"] * 9, "successMetric": "x", "successSignal": "y"},
    }
    doc = {"objective": " ", "questions": ["q", 3, ""], "newIdeas": [idea, {**idea, "risks": []}], "alreadyThought": [{"idea": "i", "evidence": "e", "status": "odd"}, {"idea": "i"}], "realityMap": {"constraints": ["c"]}}
    df = spark.createDataFrame([(json.dumps(doc),), (None,)], "j string")
    rows = model_json.normalise_explore(df, "j", F.lit("goal")).withColumn("text", model_json.explore_text(F.col("explore"))).collect()
    e = rows[0]["explore"]
    assert (e["objective"], e["summary"], e["questions"]) == ("goal", "No summary generated.", ["q"])
    assert [(i["title"], i["novelty"], i["fit"], i["upside"], len(i["experiment"]["steps"])) for i in e["new_ideas"]] == [("t", 10, 1, 5, 6)]
    assert [(t["idea"], t["status"]) for t in e["already_thought"]] == [("i", "already yours")]
    assert "New 1: t" in rows[0]["text"] and "Novelty 10/10 | Fit 1/10" in rows[0]["text"]
    assert rows[1]["explore"]["objective"] == "goal" and rows[1]["text"].startswith("Objective: goal")


def test_message_content(spark):
    value = lambda s: one(spark, model_json.message_content(F.parse_json(F.lit(s))))
    assert [value(s) for s in ('"a"', '[{"text": "a"}, {"x": 1}, {"text": "b"}]', "7", "{}")] == ["a", "ab", "", ""]


def test_stream_frames(spark):
    raw = "data: a\n\nevent: x\n\ndata: b\n\ndata: [DONE]\n\ndata: half"
    assert one(spark, model_json.split_frames(F.lit(raw))) == ["a", "b", "half"]


def test_import(spark, tmp_path):
    raw = "Total messages: 2\n===\n[1/5/24, 2:03 PM] first\nExported now\n more \n\n[12/31/2023, 12:00 AM] second"
    (tmp_path / "x.txt").write_text(raw)
    got = exports.parse_export(exports.read_lines(spark, str(tmp_path))).orderBy("note_no").collect()
    assert [(r["content"], r["ts"].isoformat()) for r in got] == [("first\nmore", "2024-01-05T14:03:00"), ("second", "2023-12-31T00:00:00")]
    assert got[0]["id"].startswith("migrated-") and len(got[0]["id"]) == 29


@pytest.mark.parametrize("style", ["content", "position"])
def test_import_by_splits(spark, tmp_path, style):
    """One export read whole, in four splits and in forty gives the same notes; so do its parts as one folder."""
    r = random.Random(3)
    lines, want = ["=== Export", "before any note"], []
    for i in range(150):
        body = [f"note {i}"] + [r.choice(["more text é", "  spaced  ", "", "Exported line", "x" * 300, "[not a head] y"]) for _ in range(r.choice([0, 1, 2, 30]))]
        lines += [f"[1/{1 + i % 28}/24, {1 + i % 12}:{i % 60:02d} PM] {body[0]}", *body[1:]]
        want.append("\n".join(b.strip() for b in body if b.strip() and not b.startswith("Exported")))
    raw = "\n".join(lines).encode()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "export.txt").write_bytes(raw)
    (tmp_path / "parts").mkdir()
    for k in range(7):  # parts end with a line
        (tmp_path / "parts" / f"part-{k:05d}.txt").write_text("\n".join(lines[len(lines) * k // 7 : len(lines) * (k + 1) // 7]) + "\n")
    seen = {}
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    old["spark.sql.files.minPartitionNum"] = None
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for n in (1, 4, 40):
            spark.conf.set("spark.sql.files.minPartitionNum", str(n))
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(-(-len(raw) // n)))
            rows = exports.read_lines(spark, str(tmp_path / "one"))
            assert n / 2 <= rows.rdd.getNumPartitions() <= n + 1
            seen[n] = exports.parse_export(rows, id_style=style).drop("file").orderBy("note_no").collect()
            seen[f"parts {n}"] = exports.parse_export(exports.read_lines(spark, str(tmp_path / "parts"), folder_is_one=True), id_style=style).drop("file").orderBy("note_no").collect()
    finally:
        for c, value in old.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    assert [x["content"] for x in seen[1]] == want and [x["note_no"] for x in seen[1]] == list(range(1, 151))
    assert all(rows == seen[1] for rows in seen.values())
    if style == "position":
        assert [x["id"] for x in seen[1]] == [f"restored-note-{i}" for i in range(150)]


def test_feed(spark):
    raw = {"totalDishes": 1, "lastUpdated": "2024-01-01", "dishes": [{"name": "soup", "cost": {"amount": "3", "unit": "MXN"}, "lastUpdated": "2024-01-01", "calculationNotes": "n"}]}
    df = spark.createDataFrame([(json.dumps(raw),), ("broken",)], "value string")
    got = {r["content"] for r in feed.feed_notes(feed.parse_feed(df)).collect()}
    assert got == {"DISHES SUMMARY: 1 dishes in production. Last updated: 2024-01-01", "soup: 3 MXN to produce", "COST BREAKDOWN - soup:\n\nn"}


def test_written_report_is_in_order(spark, tmp_path):
    lines = spark.range(500).select("id", F.concat(F.lit("line "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("line")).repartition(7)
    render.write_lines(lines, str(tmp_path / "r"), "id")
    parts = sorted((tmp_path / "r").glob("part-*"))
    assert [x for p in parts for x in p.read_text().splitlines()] == [f"line {i:04d}" for i in range(500)]
