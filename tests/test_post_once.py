"""A first post is written once beside its table."""

from __future__ import annotations

from quillspark.operators import log_store
from quillspark.sources.store import TableStore
from quillspark.storage import new_path


def test_first_post_is_not_written_again_as_merged(spark, monkeypatch):
    labels, cut = [], log_store.cut
    monkeypatch.setattr(log_store, "cut", lambda df, label: labels.append(label) or cut(df, label))
    store = TableStore(spark, new_path(spark, "log"), log_store.TABLES)
    log = spark.createDataFrame([("a", "one", "note"), ("b", "two", "question")], "id string, content string, type string")
    assert log_store.post(store, log, "2024-01-31 00:00:00").total_messages == 2
    assert "merged" not in labels
    assert log_store.post(store, log, "2024-01-31 00:01:00").total_messages == 2
    assert "merged" in labels
