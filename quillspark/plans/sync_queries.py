"""Queries over the fact sync: one call on all four tables, and the backfill's rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fact_sync, ledger
from ..sources import views
from ..sources.store import TableStore
from ..sources.views import with_views
from ..storage import cut, new_path
from ..streaming import log, state
from .ledger_queries import DIRTY
from .registry import query

#: The clock of the queries.
CLOCK = "2024-01-31 00:00:00"


def _number(note_id: Column) -> Column:
    return F.substring(note_id, 3, 20).cast("long")


def stub_model(facts: DataFrame):
    """Stands in for the model: a note's first chunk yields its events as drafts; every eleventh note fails.

    Drafts of little confidence have no value, so they are dropped and those
    after them move up; plans have no time of their own.
    """
    draft = F.struct(
        "entity", "attribute", F.when(F.col("confidence") < 0.05, "").otherwise(F.col("value_text")).alias("value_text"),
        F.concat("claim", F.lit(" as noted in the weekly plan")).alias("claim"), F.col("claim").alias("raw_span"), "value_num", F.lit(None).cast("string").alias("unit"),
        "polarity", "confidence", F.when(F.col("polarity") != "plan", F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("as_of"),
    )

    def call(chunks: DataFrame) -> DataFrame:
        asked = chunks.select("note_id", "chunk")
        # the facts of the notes of a call only
        own = facts.withColumnRenamed("source_note_id", "note_id").join(asked.select("note_id").distinct(), "note_id", "left_semi")
        said = own.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("fact_id", draft.alias("d")))).alias("all"))
        said = said.select("note_id", F.transform("all", lambda x: x["d"]).alias("own"))
        answers = asked.join(said, "note_id", "left").withColumn("drafts", F.when(F.col("chunk") == 0, F.col("own"))).drop("own")
        return answers.withColumn("error", F.when(_number(F.col("note_id")) % 11 == 3, F.concat(F.lit("model: "), F.repeat(F.lit("x"), 600))))

    return call


def _ledger(spark, sf) -> tuple[TableStore, DataFrame]:
    facts = views.fact_events(spark, sf)
    store = TableStore(spark, new_path(spark, "ledger"), fact_sync.TABLES)
    fact_sync.create(store, facts, views.fact_index(spark, sf), ledger.current_state(facts))
    return store, facts


def _text(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("line")


CALL = f"""{DIRTY},
given AS (SELECT DISTINCT source_note_id AS note_id FROM fact_events),
allowed AS (SELECT d.*, row_number() OVER (ORDER BY note_ts DESC, note_id) AS place FROM dirty d WHERE note_id IN (SELECT note_id FROM given)),
queue AS (SELECT a.note_id, a.content, a.content_hash, a.note_ts, a.place, i.attempts, row_number() OVER (ORDER BY a.note_ts DESC, a.note_id) AS seq
  FROM allowed a LEFT JOIN fact_index i ON i.note_id = a.note_id WHERE is_dirty ORDER BY seq LIMIT 40),
judged AS (SELECT *, CAST(substring(note_id, 3) AS BIGINT) % 11 = 3 AS broken, CASE WHEN length(trim(content)) < 12 THEN 'too_short' END AS reason,
  length(content) >= 4000 AND (len(regexp_extract_all(content, '(?m)^\\d+\\.\\s')) >= 4 OR len(regexp_extract_all(content, '(?m)^---+$')) >= 3
    OR (length(content) > 8000 AND regexp_matches(lower(content), '(you think|your realistic|scenario|option [ab]:|break-even|reconstructed)'))) AS derived FROM queue),
drafted AS (SELECT q.seq, q.note_id, q.content_hash, q.derived, f.entity, f.attribute, f.value_text, f.claim || ' as noted in the weekly plan' AS claim, f.polarity, f.confidence, f.state_key,
    CASE WHEN polarity = 'plan' THEN q.note_ts ELSE date_trunc('milliseconds', f.as_of) END AS as_of, row_number() OVER (PARTITION BY q.note_id ORDER BY f.fact_id) - 1 AS idx
  FROM judged q JOIN fact_events f ON f.source_note_id = q.note_id WHERE NOT broken AND reason IS NULL AND f.confidence >= 0.05),
identified AS (SELECT *, sha1(note_id || '|' || state_key || '|' || claim || '|' || value_text || '|' || strftime(as_of, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || polarity || '|' || idx || '|' || content_hash) AS fact_id FROM drafted),
grouped AS (SELECT *, min(idx) OVER g AS position, row_number() OVER (PARTITION BY note_id, state_key, lower(value_text), polarity, CAST(as_of AS DATE) ORDER BY confidence DESC, idx) AS rn
  FROM identified WINDOW g AS (PARTITION BY note_id, state_key, lower(value_text), polarity, CAST(as_of AS DATE))),
events AS (SELECT seq, note_id, fact_id, entity, attribute, state_key, claim, value_text, polarity, as_of, position,
    CASE WHEN derived AND polarity = 'measurement' THEN least(confidence, 0.55) ELSE confidence END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY position) AS pn FROM grouped WHERE rn = 1) WHERE pn <= 40),
told AS (SELECT q.*, CASE WHEN reason IS NULL AND broken THEN 'failed' WHEN e.n > 0 THEN 'done' ELSE 'skipped' END AS now_status, coalesce(e.n, 0) AS fact_count,
    CASE WHEN reason IS NULL AND broken THEN ('model: ' || repeat('x', 600))[1:500] WHEN e.n > 0 THEN NULL ELSE coalesce(reason, 'no_signal') END AS error
  FROM judged q LEFT JOIN (SELECT note_id, count(*) n FROM events GROUP BY 1) e ON e.note_id = q.note_id),
-- facts with the steps between which they are there
lived AS (
  SELECT f.state_key, f.fact_id, f.claim, f.value_text, f.polarity, f.as_of, f.confidence, f.source_note_id AS note_id, 0 AS since, coalesce(t.seq, 1000000) AS until FROM fact_events f LEFT JOIN told t ON t.note_id = f.source_note_id
  UNION ALL SELECT state_key, fact_id, claim, value_text, polarity, as_of, confidence, note_id, seq, 1000000 FROM events),
ranks(polarity, r) AS (VALUES ('measurement', 4), ('decision', 4), ('constraint', 3), ('identity', 3), ('estimate', 2), ('plan', 1)),
touched AS (SELECT t.seq, t.note_id, f.state_key FROM told t JOIN fact_events f ON f.source_note_id = t.note_id WHERE now_status <> 'failed'
  UNION SELECT seq, note_id, state_key FROM events WHERE polarity <> 'hypothesis'),
best AS (SELECT seq, state_key, struct_pack(fact_id, claim, value_text, polarity, as_of, confidence, r, note_id) AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY seq, state_key ORDER BY as_of DESC, r DESC, confidence DESC, position) AS rn FROM events JOIN ranks USING (polarity)) WHERE rn = 1),
left_over AS (
  SELECT t.seq, t.state_key, l.* EXCLUDE (state_key), r, row_number() OVER (PARTITION BY t.seq, t.state_key ORDER BY as_of DESC, r DESC, confidence DESC, fact_id) AS rn
  FROM touched t JOIN lived l ON l.state_key = t.state_key AND l.since <= t.seq AND t.seq < l.until JOIN ranks USING (polarity)),
hist AS (SELECT seq, state_key, struct_pack(fact_id, claim, value_text, polarity, as_of, confidence, r, note_id) AS f FROM left_over WHERE rn = 1),
then_ AS (SELECT o.seq, o.state_key, struct_pack(value_text := o.value_text, claim := o.claim, as_of := o.as_of, note_id := o.note_id) AS f
  FROM left_over o JOIN hist h ON h.seq = o.seq AND h.state_key = o.state_key WHERE o.value_text <> h.f.value_text OR o.as_of <> h.f.as_of QUALIFY row_number() OVER (PARTITION BY o.seq, o.state_key ORDER BY o.rn) = 1),
steps AS (SELECT t.*, row_number() OVER (PARTITION BY t.state_key ORDER BY t.seq) AS k, b.f AS best, h.f AS hist, p.f AS prev
  FROM touched t LEFT JOIN best b USING (seq, state_key) LEFT JOIN hist h USING (seq, state_key) LEFT JOIN then_ p USING (seq, state_key)),
fold AS (
  SELECT s.state_key, CAST(0 AS BIGINT) AS k, c.source_fact_id AS fact_id, c.claim, c.value_text, c.polarity, c.as_of, c.confidence, r.r, c.source_note_id AS note_id, c.previous_value_text AS pv, c.previous_claim AS pc, c.previous_as_of AS pa, c.previous_source_note_id AS pn
  FROM (SELECT DISTINCT state_key FROM steps) s LEFT JOIN current_state c ON c.state_key = s.state_key LEFT JOIN ranks r ON r.polarity = c.polarity
  UNION ALL
  SELECT state_key, k, x.fact_id, x.claim, x.value_text, x.polarity, x.as_of, x.confidence, x.r, x.note_id,
    CASE WHEN kept THEN pv WHEN ov <> x.value_text THEN ov ELSE pv END, CASE WHEN kept THEN pc WHEN ov <> x.value_text THEN oc ELSE pc END,
    CASE WHEN kept THEN pa WHEN ov <> x.value_text THEN oa ELSE pa END, CASE WHEN kept THEN pn WHEN ov <> x.value_text THEN o_note ELSE pn END
  FROM (
    SELECT s.state_key, s.k, f.pv, f.pc, f.pa, f.pn,
      -- the state that is superseded: where history takes over, its second fact
      CASE WHEN best IS NULL AND prev IS NOT NULL THEN prev.value_text ELSE f.value_text END AS ov, CASE WHEN best IS NULL AND prev IS NOT NULL THEN prev.claim ELSE f.claim END AS oc,
      CASE WHEN best IS NULL AND prev IS NOT NULL THEN prev.as_of ELSE f.as_of END AS oa, CASE WHEN best IS NULL AND prev IS NOT NULL THEN prev.note_id ELSE f.note_id END AS o_note,
      NOT takes AND NOT falls AS kept, CASE WHEN takes THEN best WHEN falls THEN hist ELSE struct_pack(fact_id := f.fact_id, claim := f.claim, value_text := f.value_text, polarity := f.polarity, as_of := f.as_of, confidence := f.confidence, r := f.r, note_id := f.note_id) END AS x
    FROM fold f JOIN steps s ON s.state_key = f.state_key AND s.k = f.k + 1,
      LATERAL (SELECT s.best IS NOT NULL AND (f.fact_id IS NULL OR f.note_id = s.note_id OR s.best.as_of > f.as_of OR (s.best.as_of = f.as_of AND (s.best.r > f.r OR (s.best.r = f.r AND s.best.confidence >= f.confidence)))) AS takes,
        s.best IS NULL AND coalesce(f.note_id = s.note_id, false) AS falls) d)),
ended AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY state_key ORDER BY k DESC) = 1),
counts AS (SELECT count(*) AS processed, count(*) FILTER (WHERE now_status = 'failed') AS failed, count(*) FILTER (WHERE now_status = 'skipped') AS skipped, max(place) AS scanned FROM told),
totals AS (SELECT c.*, (SELECT count(*) FROM notes) AS total, (SELECT count(*) FROM allowed) AS n_allowed FROM counts c),
meta AS (SELECT *, processed - failed AS done, CASE WHEN processed < 40 THEN 0 WHEN scanned < n_allowed THEN total - (processed - failed) ELSE greatest(0, total - processed) END AS remaining FROM totals)"""

OUT = """
SELECT 'fact' AS part, fact_id AS key, note_id || '|' || state_key || '|' || value_text || '|' || polarity || '|' || strftime(as_of, '%Y-%m-%d %H:%M') || '|' || CAST(round(confidence, 2) AS DECIMAL(9, 2)) || '|' || claim AS line FROM (
  SELECT fact_id, source_note_id AS note_id, state_key, value_text, polarity, as_of, confidence, claim FROM fact_events WHERE source_note_id NOT IN (SELECT note_id FROM told)
  UNION ALL SELECT fact_id, note_id, state_key, value_text, polarity, as_of, confidence, claim FROM events)
UNION ALL
SELECT 'index', note_id, coalesce(content_hash, '-') || '|' || status || '|' || extractor_version || '|' || attempts || '|' || coalesce(CAST(fact_count AS VARCHAR), '-') || '|' || coalesce(error, '-') || '|' || coalesce(CAST(content_length AS VARCHAR), '-') FROM (
  SELECT note_id, content_hash, status, extractor_version, attempts, NULL AS fact_count, NULL AS error, NULL AS content_length FROM fact_index WHERE note_id NOT IN (SELECT note_id FROM told)
  UNION ALL SELECT note_id, content_hash, now_status, 'v3', coalesce(attempts, 0) + 1, fact_count, error, length(trim(content)) FROM told)
UNION ALL
SELECT 'state', state_key, fact_id || '|' || note_id || '|' || value_text || '|' || polarity || '|' || strftime(as_of, '%Y-%m-%d %H:%M') || '|' || coalesce(pv, '-') || '|' || coalesce(pc, '-') || '|' || coalesce(strftime(pa, '%Y-%m-%d %H:%M'), '-') || '|' || coalesce(pn, '-') FROM (
  SELECT state_key, source_fact_id AS fact_id, source_note_id AS note_id, value_text, polarity, as_of, previous_value_text AS pv, previous_claim AS pc, previous_as_of AS pa, previous_source_note_id AS pn
  FROM current_state WHERE state_key NOT IN (SELECT state_key FROM ended)
  UNION ALL SELECT state_key, fact_id, note_id, value_text, polarity, as_of, pv, pc, pa, pn FROM ended WHERE fact_id IS NOT NULL)
UNION ALL
SELECT 'meta', 'v3', total || '|' || done || '|' || remaining || '|' || done || '|' || (done - skipped) || '|' || skipped || '|' || failed || '|' || total || '|' || remaining || '|' || strftime(TIMESTAMP '2024-01-31', '%Y-%m-%d %H:%M') FROM meta
UNION ALL
SELECT 'result', 'call', processed || '|' || failed || '|' || skipped || '|' || (SELECT count(*) FROM events) || '|' || remaining || '|' || (processed + remaining) FROM meta"""


@query("fact_sync", with_views(f"WITH RECURSIVE {CALL}{OUT}", "notes", "fact_index", "current_state"))
def fact_sync_call(spark, sf):
    """The four tables after a call on the 40 newest notes that need it, of those that have facts, and its result."""
    store, facts = _ledger(spark, sf)
    only = facts.select(F.col("source_note_id").alias("note_id")).distinct()
    result = fact_sync.sync(store, views.notes(spark, sf), stub_model(facts), limit=fact_sync.clamp_limit(99), only=only, clock=F.lit(CLOCK).cast("timestamp"), unicode=False)
    now = store.snapshot()
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    events = store.read("fact_events", now).withColumn("as_of", time("as_of")).withColumn("confidence", F.round("confidence", 2).cast("decimal(9,2)"))
    state = store.read("current_state", now).withColumn("as_of", time("as_of")).withColumn("previous_as_of", time("previous_as_of"))
    meta = store.read("ledger_meta", now).withColumn("at", time("last_sync_at"))
    told = spark.range(1).select(F.lit("|".join(str(getattr(result, f)) for f in result.__dataclass_fields__)).alias("line"))
    part = lambda name, key, df: df.select(F.lit(name).alias("part"), key.alias("key"), "line")
    return (
        part("fact", F.col("fact_id"), events.withColumn("line", _text("source_note_id", "state_key", "value_text", "polarity", "as_of", "confidence", "claim")))
        .unionByName(part("index", F.col("note_id"), store.read("fact_index", now).withColumn("line", _text("content_hash", "status", "extractor_version", "attempts", "fact_count", "error", "content_length"))))
        .unionByName(part("state", F.col("state_key"), state.withColumn("line", _text("source_fact_id", "source_note_id", "value_text", "polarity", "as_of", "previous_value_text", "previous_claim", "previous_as_of", "previous_source_note_id"))))
        .unionByName(part("meta", F.col("extractor_version"), meta.withColumn("line", _text("total_notes", "processed_for_version", "remaining_dirty", "index_count", "n_done", "n_skipped", "n_failed", "n_pending", "stale_version", "at"))))
        .unionByName(part("result", F.lit("call"), told))
    )


ROUNDS = f"""{CALL[:CALL.index("queue AS")]}
queue AS (SELECT a.note_id, a.content, a.content_hash, a.note_ts, a.place, coalesce(i.attempts, 0) AS attempts, is_dirty, CAST(substring(a.note_id, 3) AS BIGINT) % 11 = 3 AND length(trim(a.content)) >= 12 AS broken
  FROM allowed a LEFT JOIN fact_index i ON i.note_id = a.note_id),
drafted AS (SELECT q.note_id, f.value_text, f.state_key, f.polarity, CASE WHEN polarity = 'plan' THEN q.note_ts ELSE date_trunc('milliseconds', f.as_of) END AS as_of
  FROM queue q JOIN fact_events f ON f.source_note_id = q.note_id WHERE NOT broken AND length(trim(content)) >= 12 AND f.confidence >= 0.05),
kept AS (SELECT note_id, least(40, count(DISTINCT (state_key, lower(value_text), polarity, CAST(as_of AS DATE)))) AS n FROM drafted GROUP BY 1),
lists AS (SELECT list(CASE WHEN NOT is_dirty THEN 0 WHEN broken THEN greatest(1, 4 - attempts) ELSE 1 END ORDER BY place) AS left_, list(broken ORDER BY place) AS broken, list(coalesce(n, 0) ORDER BY place) AS n, (SELECT count(*) FROM notes) AS total
  FROM queue LEFT JOIN kept USING (note_id)),
rounds AS (
  SELECT CAST(0 AS BIGINT) AS round, left_, CAST(0 AS BIGINT) AS done, total AS remaining, CAST(-1 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS facts_written FROM lists
  UNION ALL
  SELECT round + 1, list_transform(range(1, len(left_) + 1), lambda i: left_[i] - CAST(list_contains(picked, i) AS INTEGER)), now_done,
    CASE WHEN len(picked) < 40 THEN 0 WHEN picked[-1] < len(left_) AND now_done <= len(picked) THEN total - now_done ELSE greatest(0, remaining - len(picked)) END,
    len(picked), now_failed, len(list_filter(picked, lambda i: NOT broken[i] AND n[i] = 0)), CAST(list_sum(list_transform(picked, lambda i: CASE WHEN broken[i] THEN 0 ELSE n[i] END)) AS BIGINT)
  FROM (SELECT r.*, l.broken, l.n, l.total, p.picked, len(list_filter(p.picked, lambda i: l.broken[i])) AS now_failed, least(l.total, r.done + len(p.picked) - len(list_filter(p.picked, lambda i: l.broken[i]))) AS now_done
    FROM rounds r, lists l, LATERAL (SELECT list_filter(range(1, len(r.left_) + 1), lambda i: r.left_[i] > 0)[1:40] AS picked) p WHERE r.remaining > 0 AND r.processed <> 0 AND r.round < 80))
SELECT round, processed, failed, skipped, coalesce(facts_written, 0) AS facts_written, remaining, CAST(sum(processed) OVER (ORDER BY round) AS BIGINT) AS processed_so_far, CAST(sum(coalesce(facts_written, 0)) OVER (ORDER BY round) AS BIGINT) AS facts_so_far
FROM rounds WHERE round > 0"""


@query("facts_backfill", with_views(f"WITH RECURSIVE {ROUNDS}", "notes", "fact_index", "fact_events"))
def facts_backfill(spark, sf):
    """The rounds of a backfill over all notes that have facts, with its totals so far."""
    store, facts = _ledger(spark, sf)
    only = facts.select(F.col("source_note_id").alias("note_id")).distinct()
    done = fact_sync.backfill(store, views.notes(spark, sf), stub_model(facts), limit=40, only=only, clock=F.lit(CLOCK).cast("timestamp"), unicode=False)
    return fact_sync.rounds_table(spark, done)


REPLAY = """events AS (SELECT * REPLACE (CASE WHEN attribute = 'click' THEN 'everyone|click' ELSE state_key END AS state_key), CAST(substring(source_note_id, 3) AS BIGINT) AS number FROM fact_events WHERE polarity <> 'hypothesis'),
ranks(polarity, r) AS (VALUES ('measurement', 4), ('decision', 4), ('constraint', 3), ('identity', 3), ('estimate', 2), ('plan', 1)),
lived AS (
  SELECT state_key, fact_id, claim, value_text, polarity, as_of, confidence, r, source_note_id AS note_id, number + 1 AS since, CASE WHEN number % 2 = 0 THEN 1000 - number ELSE 100000 END AS until FROM events JOIN ranks USING (polarity)
  UNION ALL SELECT state_key, fact_id, claim, value_text, polarity, as_of, confidence, r, source_note_id, 1000 - number, 100000 FROM events JOIN ranks USING (polarity) WHERE number % 2 = 0 AND polarity IN ('decision', 'measurement', 'plan')),
touched AS (SELECT DISTINCT unnest([number + 1, 1000 - number]) AS seq, source_note_id AS note_id, state_key FROM events WHERE number % 2 = 0 UNION SELECT DISTINCT number + 1, source_note_id, state_key FROM events WHERE number % 2 = 1),
best AS (SELECT since AS seq, state_key, struct_pack(fact_id, claim, value_text, polarity, as_of, confidence, r, note_id) AS f
  FROM lived QUALIFY row_number() OVER (PARTITION BY since, state_key ORDER BY as_of DESC, r DESC, confidence DESC, fact_id) = 1),
silent AS (SELECT t.seq, t.state_key FROM touched t ANTI JOIN best b USING (seq, state_key)),
left_over AS (SELECT t.seq, t.state_key, l.* EXCLUDE (state_key), row_number() OVER (PARTITION BY t.seq, t.state_key ORDER BY as_of DESC, r DESC, confidence DESC, fact_id) AS rn
  FROM silent t JOIN lived l ON l.state_key = t.state_key AND l.since <= t.seq AND t.seq < l.until),
hist AS (SELECT seq, state_key, struct_pack(fact_id, claim, value_text, polarity, as_of, confidence, r, note_id) AS f FROM left_over WHERE rn = 1),
then_ AS (SELECT o.seq, o.state_key, struct_pack(value_text := o.value_text, claim := o.claim, as_of := o.as_of, note_id := o.note_id) AS f
  FROM left_over o JOIN hist h ON h.seq = o.seq AND h.state_key = o.state_key WHERE o.value_text <> h.f.value_text OR o.as_of <> h.f.as_of QUALIFY row_number() OVER (PARTITION BY o.seq, o.state_key ORDER BY o.rn) = 1),
steps AS (SELECT t.*, row_number() OVER (PARTITION BY t.state_key ORDER BY t.seq) AS k, b.f AS best, h.f AS hist, p.f AS prev
  FROM touched t LEFT JOIN best b USING (seq, state_key) LEFT JOIN hist h USING (seq, state_key) LEFT JOIN then_ p USING (seq, state_key)),
begun AS (SELECT DISTINCT state_key, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS fact_id, CAST(NULL AS VARCHAR) AS claim, CAST(NULL AS VARCHAR) AS value_text, CAST(NULL AS VARCHAR) AS polarity, CAST(NULL AS TIMESTAMP) AS as_of,
  CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS INTEGER) AS r, CAST(NULL AS VARCHAR) AS note_id, CAST(NULL AS VARCHAR) AS pv, CAST(NULL AS VARCHAR) AS pc, CAST(NULL AS TIMESTAMP) AS pa, CAST(NULL AS VARCHAR) AS pn FROM steps)"""


def _fold(begin: str) -> str:
    """The recursive fold of ``steps`` over ``begin``; ``ended`` has each key's last state."""
    body = CALL[CALL.index("  UNION ALL\n  SELECT state_key, k, x.fact_id") : CALL.index(",\ncounts AS")]
    return f"fold AS (\n  SELECT * FROM {begin}\n{body}"


@query("state_replay", with_views(f"WITH RECURSIVE {REPLAY},\n{_fold('begun')}\nSELECT state_key, fact_id AS source_fact_id, value_text, polarity, as_of, note_id AS source_note_id, pv AS previous_value_text, pc AS previous_claim, pa AS previous_as_of, pn AS previous_source_note_id FROM ended WHERE fact_id IS NOT NULL", "fact_events"))
def state_replay(spark, sf):
    """The state kept up by a stream of three batches: all notes, then every second one again, backwards, with some facts withdrawn.  All clicks are one key."""
    facts = views.fact_events(spark, sf).filter("polarity <> 'hypothesis'").withColumn("state_key", F.when(F.col("attribute") == "click", "everyone|click").otherwise(F.col("state_key")))
    # of what a note says of a key two facts can count; both are found before a note's facts meet, when all are there and when some are withdrawn
    number, withdrawn = _number(F.col("note_id")), ~F.col("polarity").isin("decision", "measurement", "plan")
    told = state.facts_struct(facts).withColumnRenamed("source_note_id", "note_id")
    time = F.when((number % 2 == 0) & ~withdrawn, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    top = ledger.two_best(told.withColumn("time", F.explode(time)), F.col("fact"), ["note_id", "state_key", "time"])
    at = lambda t: F.transform(F.sort_array(F.collect_list(F.when(F.col("time") == t, F.struct("place", "best")))), lambda x: x["best"])
    said = cut(top.groupBy("note_id", "state_key").agg(at(1).alias("facts"), at(2).alias("left")), "said")
    first = said.withColumn("seq", number + 1)
    again = said.filter(number % 2 == 0).withColumn("seq", 1000 - number).withColumn("facts", F.col("left"))
    store = TableStore(spark, new_path(spark, "replay"), {"current_state": "state_key"})
    store.update(lambda c: c.replace("current_state", spark.createDataFrame([], fact_sync.STATE)))
    state.with_rocksdb(spark)
    landing, checkpoint = new_path(spark, "landing"), new_path(spark, "replay-checkpoint")
    for batch in (first.filter(number < 100), first.filter(number >= 100), again):
        batch.select("state_key", "note_id", "seq", "facts").write.mode("append").parquet(landing)
        stream = spark.readStream.schema(batch.select("state_key", "note_id", "seq", "facts").schema).parquet(landing)
        log.run(state.note_state(stream), state.keep_state(store), checkpoint).awaitTermination()
    return store.read("current_state").select(
        "state_key", "source_fact_id", "value_text", "polarity", F.col("as_of").cast("timestamp_ntz").alias("as_of"), "source_note_id", "previous_value_text", "previous_claim",
        F.col("previous_as_of").cast("timestamp_ntz").alias("previous_as_of"), "previous_source_note_id",
    )
