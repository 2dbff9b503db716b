"""Importers over notes that are blank, missing, begin with a blank line or have an id in common, against their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from quillspark.plans import catalog

TEXTS = ["plain\ntext", "", None, " ", "\n\n", "\nfoo\nbar", "foo\n\n  bar  \n", "=== head", "Exported by\nfoo", "a \nb"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of documents and events; the event of number 6 is there twice, at two times."""
    folder = str(tmp_path_factory.mktemp("odd"))
    begin = datetime(2024, 1, 1, 11, 58)
    events = [(i, begin + timedelta(minutes=i, seconds=7)) for i in range(len(TEXTS))] + [(6, begin + timedelta(days=400))]
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def _same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.SQL[name])
    columns = want.columns
    key = lambda row: tuple(map(str, row))
    got = [tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, folder).collect()]
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)


def test_roundtrip_of_odd_notes(spark, odd):
    _same(spark, odd, "import_export_roundtrip")


def test_long_dates_of_odd_notes(spark, odd):
    _same(spark, odd, "import_long_dates")
