"""The stored log: handlers, two writers at once, and log documents of unknown shape."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from quillspark.operators import log_store
from quillspark.sources.store import TableStore

SCHEMA = "id string, content string, type string, ts timestamp, source string"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "log"), log_store.TABLES)


def messages(spark, *rows):
    return spark.createDataFrame([(i, c, t, None, None) for i, c, t in rows], SCHEMA)


def held(store):
    return sorted((r["id"] or "", r["content"]) for r in log_store.load(store).collect())


def test_handlers(spark, store):
    assert held(store) == []
    first = log_store.post(store, messages(spark, ("a", "1", "note"), ("b", "2", "question"), ("c", "3", "note"), ("c", "4", "note")), "t0")
    assert first == log_store.Saved(True, 4, True)
    few = log_store.post(store, messages(spark, ("z", "9", "note")), "t1")
    assert not few.success and few.total_messages == 4 and "from 4 to 1" in few.error and store.snapshot().version == 0
    assert log_store.patch(store, messages(spark, ("b", "5", "question")), "t2", "upsert") == log_store.Saved(True, 4, False)
    assert log_store.patch(store, messages(spark, ("c", "6", "note"), ("d", "7", "note")), "t3", "upsert") == log_store.Saved(True, 4, True)  # the two of c become one
    assert held(store) == [("a", "1"), ("b", "5"), ("c", "6"), ("d", "7")]
    assert log_store.patch(store, messages(spark, ("d", "8", "question")), "t4").total_messages == 5
    assert log_store.patch(store, messages(spark), "t5").error == "messages must be a non-empty array"
    assert log_store.post(store, log_store.load(store), "t6") == log_store.Saved(True, 4, True)  # both of d are one, a question
    same = log_store.post(store, log_store.load(store), "t6")
    assert same.success and not same.retrieval_synced  # the notes are as they were
    forced = log_store.post(store, messages(spark, ("z", "9", "note")), "t7", force=True)
    assert forced == log_store.Saved(True, 1, True) and held(store) == [("z", "9")]
    assert [r["note_id"] for r in store.read("note_index").collect()] == ["z"]
    log_store.clear(store, "t8")
    assert held(store) == [] and store.snapshot().stamps["total_messages"] == 0


def test_two_writers_patch_at_once(spark, store):
    log_store.post(store, messages(spark, ("n", "0", "note")), "t")

    def write(who):
        for i in range(3):
            log_store.patch(store, messages(spark, (f"{who}{i}", "x", "note"), ("n", f"{who}{i}", "note")), "t", "upsert")

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, "pq"))
    assert {i for i, _ in held(store)} == {"n", *(f"{w}{i}" for w in "pq" for i in range(3))}
    assert store.snapshot().stamps["total_messages"] == 7 == len(held(store))
    assert {r["note_id"] for r in store.read("note_index").collect()} == {i for i, _ in held(store)}


def test_roots_of_any_shape(spark, tmp_path):
    whole = {"messages": [{"id": "a", "content": "é 😀", "type": "note", "extra": [1]}, None, "x", 3, [1], {"content": 5}], "totalMessages": 12, "lastUpdated": "now", "more": {"x": 1}}
    texts = {
        "whole": json.dumps(whole), "cut": json.dumps(whole)[:40], "null": "null", "number": "5", "text": '"x"', "list": "[{}]", "empty": "", "object": "{}",
        "none": None, "wrong": '{"messages": {"0": {}}, "totalMessages": "3", "lastUpdated": 3}', "flag": '{"messages": [], "totalMessages": true}',
    }
    df = spark.createDataFrame(list(texts.items()), "k string, text string")
    got = {r["k"]: r for r in log_store.normalise_roots(df, "text", ["k"]).collect()}
    a = got["whole"]
    assert [(m["id"], m["content"], m["type"], m["ts"]) for m in a["messages"]] == [("a", "é 😀", "note", None), (None, None, None, None)]
    assert (a["n_messages"], a["total_messages"], a["last_updated"], a["corrupt"]) == (2, 12.0, "now", False)
    assert all((r["n_messages"], r["total_messages"], r["last_updated"]) == (0, 0.0, None) for k, r in got.items() if k != "whole")
    assert {k for k, r in got.items() if r["corrupt"]} == {"cut", "empty"}
    folder = tmp_path / "roots"
    folder.mkdir()
    for k, t in texts.items():
        if t is not None:
            (folder / f"{k}.json").write_text(t)
    rows = log_store.read_root(spark, str(folder)).collect()
    assert sorted((r["file"], r["ord"], r["content"]) for r in rows if r["content"]) == [("whole.json", 0, "é 😀")] and len(rows) == 2
