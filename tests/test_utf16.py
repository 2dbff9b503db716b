"""Limits are UTF-16 units everywhere, and no cut falls within a character."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import clip, js_trim, utf16_length, utf16_prefix
from quillspark.operators import drafts, message_log, note_index, retrieval


def units(text):
    return len(text.encode("utf-16-le")) // 2


def prefix(text, n):
    return text.encode("utf-16-le")[: 2 * n].decode("utf-16-le", "ignore")


def odd_texts():
    r = random.Random(6)
    pieces = ["a", "é", "€", "😀", "𝔘", "\n", ". ", " ", "word ", "中"]
    return ["", "😀", "a😀", "😀a", "x" * 40, *("".join(r.choice(pieces) for _ in range(r.randrange(1, 120))) for _ in range(60))]


def test_lengths_and_clips(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    row = df.select("i", utf16_length(F.col("t")).alias("n"), *[clip(F.col("t"), k, "…").alias(f"c{k}") for k in (1, 2, 7, 40)], utf16_prefix(F.col("t"), 33).alias("p"))
    for got in row.collect():
        t = texts[got["i"]]
        assert got["n"] == units(t) and got["p"] == prefix(t, 33)
        for k in (1, 2, 7, 40):
            assert got[f"c{k}"] == (t if units(t) <= k else prefix(t, k) + "…")
    assert spark.range(1).select(utf16_length(F.lit(None).cast("string"))).first()[0] is None


def brute_chunks(text, size, overlap):
    """The cutting rule on an array of units."""
    u = [text.encode("utf-16-le")[i : i + 2] for i in range(0, 2 * units(text), 2)]
    mark = lambda s: [s.encode("utf-16-le")[i : i + 2] for i in range(0, 2 * len(s), 2)]
    out, start = [], 0
    while start < len(u):
        end = min(len(u), start + size)
        if end < len(u):
            last = max((i for m in ("\n", ". ") for i in range(start, end - len(m) + 1) if u[i : i + len(m)] == mark(m)), default=-1) - start
            if last > size * 0.4:
                end = start + last + 1
        out.append((start, end))
        if end >= len(u):
            break
        start = max(0, end - overlap)
    # a bound within a character goes before it
    inside = lambda i: 0 < i < len(u) and 0xDC00 <= int.from_bytes(u[i], "little") < 0xE000
    cut = [(a - inside(a), b - inside(b)) for a, b in out]
    return [b"".join(u[a:b]).decode("utf-16-le") for a, b in cut]


@pytest.mark.parametrize(("size", "overlap"), [(10, 2), (11, 3), (30, 5)])
def test_chunks(spark, size, overlap):
    texts = [t for t in odd_texts() if t.strip()]
    for t in texts:
        assert [t[a:b] for a, b in drafts.chunk_bounds(t, size, overlap)] == brute_chunks(t, size, overlap)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "note_id string, content string")
    got = {}
    for r in drafts.chunk_notes(df, size, overlap).collect():
        got.setdefault(r["note_id"], {})[r["chunk"]] = r["chunk_text"]
    for i, t in enumerate(texts):
        whole = brute_chunks(t, size, overlap)
        want = {0: t} if units(t) <= size else {k: c.strip() for k, c in enumerate(whole) if c.strip() or k == 0}
        assert got[str(i)] == want


def test_limits_of_drafts(spark):
    base = "The office rent is 12 per month and that is what the plan says"
    rows = [("ok", "1" * 240), ("astral", "😀" * 120), ("long", "1" * 241), ("astral long", "😀" * 120 + "1")]
    df = spark.createDataFrame([(k, "Office", "rent", v, base, base + "😀" * 300) for k, v in rows], "k string, entity string, attribute string, value_text string, claim string, raw_span string")
    kept = {r["k"]: r for r in drafts.normalise_drafts(df).collect()}
    assert set(kept) == {"ok", "astral"}
    assert kept["ok"]["raw_span"] == prefix(base + "😀" * 300, 500)
    notes = spark.createDataFrame([(a, a * 6) for a in ("x", "😀", "é")] + [("y", "x" * 11)], "k string, content string")
    assert {r["k"]: r["r"] for r in notes.select("k", drafts.skip_reason(F.col("content")).alias("r")).collect()} == {"x": "too_short", "😀": None, "é": "too_short", "y": "too_short"}


def test_limits_of_log_and_prompts(spark):
    long = "😀" * 150 + "tail"
    df = spark.createDataFrame([("a", long, "note", 1), ("b", long + " other", "note", 2), ("c", "😀" * 99 + "xy", "note", 3)], "id string, content string, type string, ord int").withColumn("ts", F.timestamp_seconds("ord"))
    kept = message_log.prefix_dedupe(df, df.limit(0), limit=200).collect()
    assert {r["id"] for r in kept} == {"a", "c"} and {r["dedupe_key"] for r in kept if r["id"] == "a"} == {"note:" + "😀" * 100}
    assert {r["note_id"]: r["content_length"] for r in note_index.project_notes(df).collect()} == {"a": 304, "b": 310, "c": 200}
    notes = df.select(F.col("id").alias("note_id"), "content", F.col("ts").alias("note_ts"))
    picked = retrieval.greedy_pack(notes, [F.col("note_id")], 250, "date").collect()
    first = next(r for r in picked if r["pick"] == 1)
    # the first note is cut to 250 - 32 units: 109 of its characters
    assert (first["note_id"], first["cut_to"]) == ("a", 109) and first["line_length"] == units("[1/1/1970] ") + 218
    assert spark.createDataFrame([(" 😀 ",)], "t string").select(utf16_length(js_trim(F.col("t")))).first()[0] == 2
