from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.operators import fact_sync, ledger
from quillspark.streaming import log, state


def test_log_stream_ends_as_the_batch_merge(spark, tmp_path):
    rows = [(f"m{i % 7}", f"text {i}", "note" if i % 3 else "question", datetime(2024, 1, 1) + timedelta(minutes=i), "s", i) for i in range(20)]
    for n, part in enumerate((rows[:8], rows[8:15], rows[15:])):
        spark.createDataFrame(part, log.LOG_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}.parquet"))
    stream = spark.readStream.schema(log.LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    table, index = log.Versions(spark, str(tmp_path / "log"), log.LOG_SCHEMA), log.Versions(spark, str(tmp_path / "index"), log.INDEX_SCHEMA)
    log.run(stream, log.merge_batches(table, log.index_sync(index)), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["id"]: (r["content"], r["type"], r["ord"]) for r in table.read().collect()}
    want = {}
    for i, content, kind, _, _, o in rows:
        want[i] = (content, kind, want[i][2] if i in want else o)
    assert got == want
    notes = table.read().filter("type = 'note'")
    assert {r["note_id"] for r in index.read().collect()} == {r["id"] for r in notes.collect()}
    assert table.last() == 2


def test_state_stream_agrees_with_batch_when_events_come_in_order(spark, tmp_path):
    r = random.Random(4)
    schema = "state_key string, as_of timestamp, polarity string, confidence double, fact_id string, value_text string, claim string, source_note_id string"
    rows = [(f"k{r.randrange(6)}", datetime(2024, 1, 1) + timedelta(hours=i), r.choice(["plan", "decision", "hypothesis"]), 0.5, f"{i:04x}", f"v{i}", f"claim {i}", f"n{i}") for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}.parquet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    last = {}

    def keep(batch, number):
        last.update({x["state_key"]: x for x in batch.collect()})

    state.with_rocksdb(spark)
    q = state.incremental_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    facts = spark.createDataFrame(rows, schema).withColumn("entity", F.lit("e")).withColumn("attribute", F.lit("a")).withColumn("value_num", F.lit(1.0))
    want = {x["state_key"]: x for x in ledger.current_state(facts).collect()}
    assert {k: (x["fact_id"], x["previous_value_text"]) for k, x in last.items()} == {k: (x["source_fact_id"], x["previous_value_text"]) for k, x in want.items()}


def test_activity_windows(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i // 10, i % 24), "view", float(i)) for i in range(50)]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = state.activity(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("activity").start()
    q.processAllAvailable()
    q.stop()
    assert {r["n"] for r in spark.table("activity").collect()} == {10}


def _fold(rows):
    """The state of each key after (seq, key, note, facts): a plain fold that keeps all facts of all notes."""
    held, said = {}, {}
    for _, key, note, facts in sorted(rows, key=lambda r: (r[0], r[2])):
        said.setdefault(key, {})[note] = facts
        told = [Row(fact=f, position=i, since=1, until=2) for i, f in enumerate(facts)]
        if not facts:
            told = [Row(fact=f, position=0, since=0, until=2) for some in said[key].values() for f in some]
        held[key], _ = fact_sync.fold_key(held.get(key), [Row(seq=1, note_id=note)], told)
    return {k: (s["fact_id"], s["previous_value_text"], s["previous_as_of"]) for k, s in held.items() if s is not None}


def test_state_of_notes_with_many_facts(spark, tmp_path):
    """Two facts of a note are held of a key, whatever it says, with the end of a fold over all; logs are written anew on the way."""
    r, fact = random.Random(11), Row(*fact_sync._FACT)
    batches, seq = [], 0
    for _ in range(4):
        rows = []
        for _ in range(120):
            seq += 1
            note, key = f"n{r.randrange(9)}", f"k{r.randrange(3)}"
            facts = [fact(f"{r.randrange(16**6):06x}", "e", "a", "c", f"v{r.randrange(2)}", None, None, r.choice(["plan", "decision", "measurement"]), r.randrange(3), r.choice([0.5, 0.9]), note) for _ in range(r.choice([0, 0, 1, 5]))]
            rows.append((seq, key, note, facts))
        batches.append(rows)
    schema, state_of = f"seq long, state_key string, note_id string, facts {state.FACTS}", {}
    told = spark.createDataFrame([b for rows in batches for b in rows], schema).select(state.telling(F.col("facts")).alias("t"))
    sizes = [sum(f is not None for f in x["t"]) for x in told.collect()]
    assert max(sizes) <= 3
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.with_rocksdb(spark)
        q = state.note_state(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: state_of.update({x["state_key"]: x for x in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    micros = lambda t: None if t is None else round(t.timestamp() * 1e6)
    got = {k: (x["fact_id"], x["previous_value_text"], micros(x["previous_as_of"])) for k, x in state_of.items() if not x["gone"]}
    assert got == _fold([b for rows in batches for b in rows])
