"""An import writes what is new, beside the log that is there."""

from __future__ import annotations

from quillspark.operators import log_store
from quillspark.sources.store import TableStore
from quillspark.storage import new_path


def test_import_writes_new_rows_only(spark):
    """Two stored messages are the same by their text, another has the id of one of these; the first stays, and what has the id."""
    store = TableStore(spark, new_path(spark, "log"), log_store.TABLES)
    log = [("a", "same", "note", 1), ("b", "same", "note", 2), ("b", "other", "note", 3), ("c", "same", "question", 4), ("d", "long " * 60 + "x", "note", 5), ("e", "  ", "note", 6)]
    log_store.post(store, spark.createDataFrame(log, "id string, content string, type string, ord long"), "2024-01-31 00:00:00")
    read = [("i1", " other ", "note", 1), ("i2", "new", "note", 2), ("i3", "new", "note", 3), ("i4", "long " * 60 + "y", "note", 4), ("i5", "", "note", 5), ("i6", "same", "note", 6), ("i7", "newer", "note", 7)]
    done = log_store.import_notes(store, spark.createDataFrame(read, "id string, content string, type string, note_no long"), "2024-01-31 00:01:00")
    assert done == log_store.Imported(parsed=7, added=2, total=7)
    now = store.snapshot()
    assert sorted((r["id"], r["content"].strip()[:4]) for r in store.read("messages", now).collect()) == [("a", "same"), ("b", "othe"), ("c", "same"), ("d", "long"), ("e", ""), ("i2", "new"), ("i7", "newe")]
    assert sorted(r["note_id"] for r in store.read("note_index", now).collect()) == ["a", "b", "d", "i2", "i7"]
    assert now.stamps["total_messages"] == 7
    # the two that are new, and those that stay of the ids that stood for a doubled text
    assert now.rows_written("messages") == 4
