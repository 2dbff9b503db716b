"""Queries judge every row of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import model_json
from quillspark.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_loose_object_judges_cut_off_outputs(spark):
    rows = catalog.QUERIES["json_loose_object_all"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/conversations.parquet").count()
    cut_off = [r for r in rows if r["seq"] % 4 == 2]
    assert cut_off and all(r["objective"] is None for r in cut_off)


def test_loose_object_of_truncated_text(spark):
    texts = ['{"objective":"a","summary":"b"', '```json\n{"objective":"a"', "{", '{"objective":"a"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(model_json.loose_object(F.col("t"))).collect()]
    assert got == [None, None, None, texts[3]]


def test_js_numbers_labels_every_value(spark, tmp_path):
    values = [0.0, 125.7, 5999.0, 6000.0, 60061.5, -3.0, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["duration"] for r in catalog.QUERIES["js_numbers"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(["00:00", "02:05", "99:59", "100:00", "1001:01", "00:00", "00:00"]))
