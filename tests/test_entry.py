from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


def _rows(frame):
    columns = sorted(frame.columns)

    def plain(x):
        if x is None or pd.isna(x) is True:
            return ""
        return repr(float(x)) if isinstance(x, (int, float)) or type(x).__module__ == "numpy" and not isinstance(x, str) and hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)

    return columns, sorted(tuple(plain(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert _rows(catalog.QUERIES[name](spark, SMALL).toPandas()) == _rows(duck.sql(catalog.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    for p in ("__spark_entry__.py", "quillspark"):
        (tmp_path / p).symlink_to(ROOT / p)
    code = f"""
import sys
sys.path.insert(0, {str(tmp_path)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("quillspark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
