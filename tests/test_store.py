"""Commits over several tables: whole or not at all, and none lost."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillspark.sources import store as stores
from quillspark.sources.store import TableStore


def rows(store, table="t"):
    return sorted(map(tuple, store.read(table).collect()), key=lambda r: (r[0] or "", r[1]))


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"), {"t": "k", "u": None})


def test_layers_replace_rows_of_their_keys(spark, store, monkeypatch):
    frame = lambda *some: spark.createDataFrame(list(some), "k string, v int")
    assert store.snapshot().version == -1
    store.update(lambda c: (c.replace("t", frame(("a", 1), ("a", 2), ("b", 3), (None, 4))), c.stamp(by="x")))
    store.update(lambda c: c.upsert("t", frame(("a", 5), ("c", 6))))
    assert rows(store) == [(None, 4), ("a", 5), ("b", 3), ("c", 6)]
    store.update(lambda c: c.change("t", drop=frame(("b", 0), (None, 0)).select("k")))
    store.update(lambda c: c.change("t", rows=frame(("b", 7))))
    assert rows(store) == [("a", 5), ("b", 7), ("c", 6)]
    store.update(lambda c: c.upsert("t", frame()))  # nothing
    assert store.snapshot().rows_written("t") == 0 and rows(store) == [("a", 5), ("b", 7), ("c", 6)]
    before = store.read("t", store.snapshot(1))
    assert sorted(map(str, map(tuple, before.collect()))) == sorted(map(str, [(None, 4), ("a", 5), ("b", 3), ("c", 6)]))
    assert store.snapshot().stamps == {"by": "x"}
    store.compact("t")
    assert len(store.snapshot().tables["t"]["layers"]) == 1 and rows(store) == [("a", 5), ("b", 7), ("c", 6)]
    monkeypatch.setattr(stores, "MAX_LAYERS", 3)
    for i in range(6):
        store.update(lambda c, i=i: c.upsert("t", frame(("z", i))))
    assert len(store.snapshot().tables["t"]["layers"]) <= 4 and rows(store)[-1] == ("z", 5)


def test_two_writers_lose_nothing(spark, store):
    store.update(lambda c: (c.replace("t", spark.createDataFrame([("n", 0)], "k string, v int")), c.stamp(commits=0)))
    tried = []

    def add(writer):
        for i in range(4):
            def change(c, i=i):
                tried.append(writer)
                old = c.read("t").filter("k = 'n'").first()["v"]
                c.upsert("t", spark.createDataFrame([("n", old + 1), (f"{writer}-{i}", i)], "k string, v int"))
                c.stamp(commits=c.stamps["commits"] + 1)

            store.update(change)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(add, "abc"))
    got = dict(rows(store))
    assert got.pop("n") == 12 and got == {f"{w}-{i}": i for w in "abc" for i in range(4)}
    assert store.snapshot().stamps["commits"] == 12 and store.versions() == list(range(13))
    assert len(tried) >= 12


def test_a_failing_change_leaves_nothing(spark, store, tmp_path):
    store.update(lambda c: c.replace("t", spark.createDataFrame([("a", 1)], "k string, v int")))

    def fails(c):
        c.replace("t", spark.createDataFrame([("b", 1)], "k string, v int"))
        c.replace("u", spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"), F.assert_true(F.lit(True)).alias("y")))

    with pytest.raises(Exception, match="broken"):
        store.update(fails)
    assert rows(store) == [("a", 1)] and len([p for p in (tmp_path / "store" / "data").iterdir() if not p.name.startswith(".")]) == 1


def test_old_commits_go_and_kept_ones_stay_readable(spark, store, tmp_path):
    for i in range(5):
        store.update(lambda c, i=i: (c.replace if i in (0, 3) else c.upsert)("t", spark.createDataFrame([(f"k{i}", i)], "k string, v int")))
    want = {v: sorted(tuple(r) for r in store.read("t", store.snapshot(v)).collect()) for v in (3, 4)}
    assert store.expire(2) == [0, 1, 2] and store.versions() == [3, 4]
    assert want == {v: sorted(tuple(r) for r in store.read("t", store.snapshot(v)).collect()) for v in (3, 4)}
    used = {layer[k] for v in (3, 4) for layer in store.snapshot(v).tables["t"]["layers"] for k in ("rows", "drops") if layer[k]}
    assert {p.name for p in (tmp_path / "store" / "data").iterdir() if not p.name.startswith(".")} == used
