"""Digest trees, vectors of texts, point reads and the pieces around model calls."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import embedding, ledger, message_log, model_json, note_index, render


def notes(spark, rows):
    return spark.createDataFrame(list(rows), "note_id string, content_hash string")


def test_tree_is_order_free_and_tells_where(spark, tmp_path):
    rows = [(f"n{i}", hashlib.sha1(str(i).encode()).hexdigest()) for i in range(300)]
    root = lambda df: note_index.tree(df).filter("level = 0").first()["digest"]
    a = notes(spark, rows).repartition(3)
    assert root(a) == root(notes(spark, rows[::-1]).repartition(5))
    changed = [(n, "x" if n == "n7" else h) for n, h in rows]
    b = notes(spark, changed)
    assert root(a) != root(b)
    leaves = note_index.differing_leaves(note_index.tree(a), note_index.tree(b)).collect()
    assert [r["leaf"] for r in leaves] == [int(hashlib.md5(b"n7").hexdigest()[:2], 16)]
    for name, df in (("a", a), ("b", b), ("c", notes(spark, [*rows[:250], ("new", "y")])), ("none", notes(spark, []))):
        note_index.write_index(df, str(tmp_path / name))
    diff = lambda x, y: note_index.changed_entries(spark, str(tmp_path / x), str(tmp_path / y))
    assert diff("a", "a").count() == 0
    one = diff("a", "b")
    assert [tuple(r) for r in one.collect()] == [("n7", "update")]
    # only the partition of the one range that differs is read
    filters = re.findall(r"PartitionFilters: \[([^\]]+)\]", one._jdf.queryExecution().executedPlan().toString())
    assert len(filters) >= 2 and all(f"= {leaves[0]['leaf']})" in f for f in filters)
    assert {tuple(r) for r in diff("a", "c").collect()} == {("new", "add"), *((n, "delete") for n, _ in rows[250:])}
    assert diff("none", "a").count() == 300 and diff("a", "none").count() == 300


def brute_vector(text, size, title=None):
    out = [0] * size
    for token in re.findall(r"[^\W_]+", f"{title} {text}".lower() if title else text.lower()):
        h = hashlib.md5(token.encode()).hexdigest()
        out[int(h[:8], 16) % size] += 1 if int(h[8], 16) % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else [0.0] * size


def test_default_vectors(spark):
    rows = [("a", "Rent is 12, rent is é.", "Office"), ("b", "", None), ("c", None, None), (None, "no id", None), ("d", "word " * 9000, "t")]
    df = spark.createDataFrame(rows, "id string, text string, title string")
    got = {r["id"]: r["embedding"] for r in embedding.default_vectors(df, size=32).collect()}
    assert len(got) == 5
    for i, text, title in rows:
        assert got[i] == pytest.approx(brute_vector((text or "")[:28000], 32, title))
    assert got["a"] != pytest.approx(embedding.default_vectors(df.filter("id = 'a'"), size=32, task="RETRIEVAL_QUERY").first()["embedding"])
    assert embedding.default_vectors(df.limit(0)).count() == 0


def test_provider_vectors(spark):
    df = spark.createDataFrame([(i, "bad" if i == 30 else "short" if i == 50 else "x" * 40000) for i in range(60)], "id int, text string").coalesce(1)

    def provider(texts):
        assert len(texts) <= 12 and max(map(len, texts)) <= 28000
        if "bad" in texts:
            raise RuntimeError("status 500")
        return [[3.0, 4.0]] * (len(texts) - ("short" in texts))

    got = embedding.provider_vectors(df, provider).collect()
    assert len(got) == 60
    failed = {r["id"]: r["error"] for r in got if r["error"]}
    assert {i: failed[i] for i in (30, 50)} == {30: "status 500", 50: "11 embeddings for 12 inputs"}
    assert len(failed) == 24 and all(r["embedding"] == [0.6, 0.8] for r in got if not r["error"])


def test_point_get(spark, monkeypatch):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    wanted = spark.createDataFrame([("b",), ("b",), ("x",), (None,)], "k string")
    want = [(None, None, False), ("b", 2, True), ("b", 3, True), ("x", None, False)]
    for few in (1000, 1):
        monkeypatch.setattr(ledger, "POINT_KEYS", few)
        assert sorted(map(tuple, ledger.point_get(table, "k", wanted).collect()), key=str) == sorted(want, key=str)


def test_mapped_facts(spark):
    row = [("f", "E", "", "5", "kg", None, float("nan"), "odd", None, None), ("g", "E", "a", "5", None, "said", 2.0, "plan", 0.9, None)]
    df = spark.createDataFrame(row, "fact_id string, entity string, attribute string, value_text string, unit string, claim string, value_num double, polarity string, confidence double, as_of timestamp")
    got = {r["fact_id"]: r for r in ledger.mapped_facts(df).collect()}
    assert (got["f"]["claim"], got["f"]["value_num"], got["f"]["polarity"], got["f"]["confidence"]) == ("E · 5 · kg", None, "estimate", 0.5)
    assert got["f"]["as_of"].timestamp() == 0 and (got["g"]["claim"], got["g"]["confidence"]) == ("said", 0.9)


def test_loadable(spark):
    rows = [("a", "ai-response", " ", None, None), ("b", "ai-response", None, ["t"], None), ("c", "ai-response", "", [], ["x"]), ("d", "ai-response", "x", None, None), ("e", "note", "", None, None), ("f", None, None, None, None), ("g", "ai-response", "", [], [])]
    df = spark.createDataFrame(rows, "id string, type string, content string, thoughts array<string>, code_blocks array<string>")
    assert {r["id"] for r in message_log.loadable(df).collect()} == set("bcdef")


def test_candidate_text(spark):
    cases = ['{"candidates": [{"content": {"parts": [{"text": " a"}, {"x": 1}, {"text": "b "}]}}, {"content": {"parts": [{"text": "z"}]}}]}', '{"candidates": []}', "{}", "cut {", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r["t"] for r in df.select("i", model_json.candidate_text(F.col("c")).alias("t")).orderBy("i").collect()] == ["ab", "", "", "", ""]


def test_combined(spark):
    df = spark.createDataFrame([("a", "S", "N"), ("b", " ", "N"), ("c", "S", " "), ("d", None, None)], "k string, s string, n string")
    got = {r["k"]: r["t"] for r in df.select("k", render.combined(F.col("s"), F.col("n"), "NOTES", "nothing left").alias("t")).collect()}
    assert got == {"a": "S\n\nNOTES\nN", "b": "N", "c": "S\n\nnothing left", "d": ""}
    clip = lambda t, n: spark.range(1).select(render.clipped_notes(F.lit(t), F.lit(n))).first()[0]
    assert [clip(" abc def ", 7), clip("abc def", 5), clip("a😀b", 3), clip("abc", 0)] == ["abc def", "abc…", "a…", "…"]


def test_names_and_dimensions(spark):
    df = spark.createDataFrame([(" x ", " 64 "), ("models/y", "0"), (None, None), ("", "abc")], "m string, d string")
    got = [tuple(r) for r in df.select(embedding.model_name(F.col("m")), embedding.dimensions(F.col("d"))).collect()]
    assert got == [("models/x", 64.0), ("models/y", 768.0), ("models/embedding-default", 768.0), ("models/", 768.0)]
