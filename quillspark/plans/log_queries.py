"""Queries over the message log and the note index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_id, js_trim, millis, preview, utf16_length, word_count
from ..operators import message_log as log
from ..operators import note_index as index
from ..sources import views
from ..sources.views import units, with_views
from .registry import query

def _digest(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "ts", "source", F.sha1("content").alias("content_sha1"))


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming messages: every question anew with other content, and an answer to each under a new id."""
    m = views.messages(spark, sf)
    asked = m.filter("type = 'question'")
    again = asked.withColumn("content", F.concat(F.lit("again: "), "content"))
    answered = asked.select(F.concat(F.lit("r-"), "id").alias("id"), F.concat(F.lit("answer: "), "content").alias("content"), F.lit("ai-response").alias("type"), "ts", F.lit("new").alias("source"))
    return again.unionByName(answered)


DELTA = """delta AS (
  SELECT id, 'again: ' || content AS content, type, ts, source FROM messages WHERE type = 'question'
  UNION ALL
  SELECT 'r-' || id, 'answer: ' || content, 'ai-response', ts, 'new' FROM messages WHERE type = 'question')"""


@query("log_scan", with_views("SELECT id, type, ts, source, sha1(content) AS content_sha1 FROM messages", "messages"))
def log_scan(spark, sf):
    return _digest(views.messages(spark, sf))


@query("log_append", with_views(f"WITH {DELTA} SELECT id, type, ts, source, sha1(content) AS content_sha1 FROM (SELECT * FROM messages UNION ALL SELECT * FROM delta)", "messages"))
def log_append(spark, sf):
    return _digest(log.append(views.messages(spark, sf), _delta(spark, sf)))


@query(
    "log_upsert_merge",
    with_views(
        f"""WITH {DELTA} SELECT id, type, ts, source, sha1(content) AS content_sha1
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC) rn FROM (SELECT *, 0 side FROM messages UNION ALL SELECT *, 1 FROM delta)) WHERE rn = 1""",
        "messages",
    ),
)
def log_upsert_merge(spark, sf):
    place = F.lit(0).alias("ord")
    old, new = views.messages(spark, sf).select("*", place), _delta(spark, sf).select("*", place)
    return _digest(log.upsert_merge(old, new))


@query("log_add_unseen", with_views(f"WITH {DELTA} SELECT id, type, ts, source, sha1(content) AS content_sha1 FROM (SELECT * FROM messages UNION ALL SELECT * FROM delta WHERE id NOT IN (SELECT id FROM messages))", "messages"))
def log_add_unseen(spark, sf):
    return _digest(log.add_unseen(views.messages(spark, sf), _delta(spark, sf)))


@query("log_delete", with_views("SELECT id, type, ts, source, sha1(content) AS content_sha1 FROM messages WHERE id <> 'n-7'", "messages"))
def log_delete(spark, sf):
    return _digest(log.delete_by_id(views.messages(spark, sf), "n-7"))


@query("log_clear", with_views("SELECT id, type FROM messages WHERE false", "messages"))
def log_clear(spark, sf):
    return views.messages(spark, sf).select("id", "type").limit(0)


@query(
    "log_shrink_guard",
    with_views("WITH c AS (SELECT count(*) old_count, count(*) FILTER (WHERE type <> 'note') new_count FROM messages) SELECT *, new_count < 0.5 * old_count AS rejected FROM c", "messages"),
)
def log_shrink_guard(spark, sf):
    m = views.messages(spark, sf)
    return log.shrink_guard(m, m.filter("type <> 'note'"))


@query(
    "log_save_delta",
    with_views(
        f"""WITH {DELTA}, now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC) rn FROM (SELECT *, 0 side FROM messages UNION ALL SELECT *, 1 FROM delta)) WHERE rn = 1)
SELECT n.id, CASE WHEN m.id IS NULL THEN 'new' ELSE 'updated' END AS change FROM now n LEFT JOIN messages m ON m.id = n.id
WHERE m.id IS NULL OR m.content IS DISTINCT FROM n.content OR m.type IS DISTINCT FROM n.type""",
        "messages",
    ),
)
def log_save_delta(spark, sf):
    m, place = views.messages(spark, sf), F.lit(0).alias("ord")
    now = log.upsert_merge(m.select("*", place), _delta(spark, sf).select("*", place))
    return log.save_delta(now, m, "content", "type").select("id", "change")


@query("log_type_counts", with_views("SELECT coalesce(type, 'unknown') AS type, count(*) n FROM messages GROUP BY 1", "messages"))
def log_type_counts(spark, sf):
    return log.type_counts(views.messages(spark, sf))


@query(
    "log_profile",
    with_views(
        """SELECT count(*) total_messages, count(*) FILTER (WHERE type = 'note') notes, min(ts) FILTER (WHERE type = 'note') first_note,
  max(ts) FILTER (WHERE type = 'note') last_note, CAST(sum(strlen(content)) AS BIGINT) content_bytes FROM messages""",
        "messages",
    ),
)
def log_profile(spark, sf):
    return log.profile(views.messages(spark, sf))


@query("log_persistable", with_views("SELECT id, sha1(content) content_sha1, type, ts FROM messages WHERE NOT (type = 'ai-response' AND trim(content) = '')", "messages"))
def log_persistable(spark, sf):
    return log.persistable(views.messages(spark, sf)).withColumn("content_sha1", F.sha1("content")).drop("content")


@query("log_notes_list", with_views("SELECT sha1(content) content_sha1, ts AS date FROM messages WHERE type = 'note' AND trim(content) <> ''", "messages"))
def log_notes_list(spark, sf):
    return log.note_list(views.messages(spark, sf)).select(F.sha1("content").alias("content_sha1"), "date")


@query("log_latest_page", with_views("SELECT id, ts FROM messages ORDER BY ts DESC, id LIMIT 10", "messages"))
def log_latest_page(spark, sf):
    return log.latest(views.messages(spark, sf), 10, "id").select("id", "ts")


@query("log_recent_previews", with_views("SELECT id, ts, CASE WHEN length(content) > 100 THEN content[1:100] || '...' ELSE content END AS preview FROM messages WHERE type = 'note' ORDER BY ts DESC, id LIMIT 5", "messages"))
def log_recent_previews(spark, sf):
    return log.recent_previews(views.messages(spark, sf))


HISTORY = """turns AS (SELECT row_number() OVER (ORDER BY ts, id) ord, id, CASE type WHEN 'question' THEN 'user' ELSE 'model' END AS role, content
  FROM (SELECT * FROM messages WHERE type IN ('question', 'ai-response') ORDER BY ts DESC, id DESC LIMIT 10))"""


@query("log_history", with_views(f"WITH {HISTORY} SELECT ord, id, role, sha1(content) content_sha1 FROM turns", "messages"))
def log_history(spark, sf):
    return log.history(views.messages(spark, sf)).withColumn("content_sha1", F.sha1("content")).drop("content")


@query(
    "log_history_summary",
    with_views(
        f"""WITH {HISTORY}, lines AS (
  SELECT ord, CASE role WHEN 'model' THEN 'AI' ELSE 'User' END || ': ' || CASE WHEN length(trim(content)) > 300 THEN trim(content)[1:300] || '…' ELSE trim(content) END AS line
  FROM (SELECT * FROM turns ORDER BY ord DESC LIMIT 6) WHERE trim(content) <> ''),
summed AS (SELECT ord, line, sum(length(line) + 1) OVER (ORDER BY ord) - CASE WHEN row_number() OVER (ORDER BY ord) > 1 THEN 1 ELSE 0 END AS chars FROM lines)
SELECT ord, line, CAST(chars AS BIGINT) AS chars FROM summed WHERE chars <= 1500""",
        "messages",
    ),
)
def log_history_summary(spark, sf):
    return log.history_summary(log.history(views.messages(spark, sf)))


@query(
    "log_prefix_dedupe",
    with_views("SELECT id, ts FROM (SELECT *, row_number() OVER (PARTITION BY type, trim(content)[1:200] ORDER BY CASE WHEN source = 'doc' THEN 0 ELSE 1 END, id) rn FROM messages) WHERE rn = 1", "messages"),
)
def log_prefix_dedupe(spark, sf):
    m = views.messages(spark, sf).withColumn("ord", F.col("id"))
    return log.prefix_dedupe(m.filter("source = 'doc'"), m.filter("source <> 'doc'")).select("id", "ts")


@query("log_text_stats", with_views(f"SELECT id, {units("content")} AS chars, len(regexp_split_to_array(trim(content), '\\s+')) AS words, CASE WHEN length(content) > 80 THEN content[1:80] || '...' ELSE content END AS title FROM messages WHERE trim(content) <> ''", "messages"))
def log_text_stats(spark, sf):
    m = views.messages(spark, sf).filter(js_trim(F.col("content")) != "")
    return m.select("id", utf16_length(F.col("content")).alias("chars"), word_count(F.col("content")).alias("words"), preview(F.col("content"), 80).alias("title"))


@query("log_batches", with_views("SELECT type, batch, count(*) n FROM (SELECT type, (row_number() OVER (PARTITION BY type, source ORDER BY ts, id) - 1) // 12 AS batch FROM messages) GROUP BY ALL", "messages"))
def log_batches(spark, sf):
    return log.batch_counts(views.messages(spark, sf), ["type", "source"], ["ts", "id"], 12)


# --- notes and index


@query("note_projection", with_views(f"SELECT id AS note_id, sha1(trim(content)) content_hash, ts AS note_ts, {units("trim(content)")} AS content_length FROM messages WHERE type = 'note' AND trim(content) <> ''", "messages"))
def note_projection(spark, sf):
    return index.project_notes(views.messages(spark, sf)).drop("content")


@query("index_metadata", with_views("SELECT note_id, content_hash, len(embedding) AS dims, label FROM note_embeddings WHERE len(embedding) > 0", "note_embeddings"))
def index_metadata(spark, sf):
    return index.embedding_metadata(views.note_embeddings(spark, sf))


@query("index_hashes", with_views("SELECT note_id, content_hash FROM note_embeddings", "note_embeddings"))
def index_hashes(spark, sf):
    return index.hashes(views.note_embeddings(spark, sf))


@query("index_fetch_contents", with_views("SELECT note_id, sha1(content) content_sha1 FROM notes WHERE note_id IN (SELECT note_id FROM note_embeddings WHERE label < 3)", "notes", "note_embeddings"))
def index_fetch_contents(spark, sf):
    ids = views.note_embeddings(spark, sf).filter("label < 3")
    return index.fetch_contents(views.notes(spark, sf), ids).select("note_id", F.sha1("content").alias("content_sha1"))


@query("index_orphans", with_views("SELECT note_id FROM note_embeddings WHERE note_id NOT IN (SELECT note_id FROM notes)", "notes", "note_embeddings"))
def index_orphans(spark, sf):
    return index.orphans(views.note_embeddings(spark, sf), views.notes(spark, sf))


@query("index_to_embed", with_views("SELECT n.note_id, n.content_hash FROM notes n LEFT JOIN note_embeddings v ON v.note_id = n.note_id WHERE v.note_id IS NULL OR v.content_hash IS DISTINCT FROM n.content_hash", "notes", "note_embeddings"))
def index_to_embed(spark, sf):
    return index.to_index(views.notes(spark, sf), views.note_embeddings(spark, sf)).select("note_id", "content_hash")


DIFF = """diff AS (SELECT coalesce(n.note_id, v.note_id) note_id, CASE WHEN v.note_id IS NULL THEN 'add' WHEN n.note_id IS NULL THEN 'delete'
  WHEN n.content_hash IS NOT DISTINCT FROM v.content_hash THEN 'keep' ELSE 'update' END AS action
  FROM notes n FULL JOIN note_embeddings v ON v.note_id = n.note_id)"""


@query("index_diff", with_views(f"WITH {DIFF} SELECT * FROM diff", "notes", "note_embeddings"))
def index_diff(spark, sf):
    return index.diff(views.notes(spark, sf), views.note_embeddings(spark, sf))


@query("index_diff_counts", with_views(f"WITH {DIFF} SELECT action, count(*) n FROM diff GROUP BY 1", "notes", "note_embeddings"))
def index_diff_counts(spark, sf):
    return index.diff_counts(views.notes(spark, sf), views.note_embeddings(spark, sf))


@query("index_sync", with_views("SELECT n.note_id, n.content_hash FROM notes n", "notes"))
def index_sync(spark, sf):
    """The index after orphans are deleted and new or changed notes are written."""
    notes, old = views.notes(spark, sf), views.note_embeddings(spark, sf).select("note_id", "content_hash")
    kept = index.delete(old, index.orphans(old, notes), "note_id")
    return index.upsert(kept, index.to_index(notes, old).select("note_id", "content_hash"), "note_id")


PRINT = """SELECT sha1(count(*) || '|' || {}) AS fingerprint FROM (SELECT sha1(note_id || ':' || content_hash) h FROM {})"""
_PARTS = " || '|' || ".join(f"CAST(sum(CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS BIGINT)) AS VARCHAR)" for i in range(5))


@query("index_fingerprint", with_views(PRINT.format(_PARTS, "notes"), "notes"))
def index_fingerprint(spark, sf):
    return index.fingerprint(views.notes(spark, sf))


@query(
    "index_sync_gate",
    with_views(
        f"WITH a AS ({PRINT.format(_PARTS, 'notes')}), b AS ({PRINT.format(_PARTS, '(SELECT * FROM note_embeddings WHERE content_hash IS NOT NULL)')}) SELECT a.fingerprint AS old, b.fingerprint AS new, a.fingerprint <> b.fingerprint AS needs_sync FROM a, b",
        "notes",
        "note_embeddings",
    ),
)
def index_sync_gate(spark, sf):
    return index.sync_gate(views.notes(spark, sf), views.note_embeddings(spark, sf).filter("content_hash is not null"))


@query("index_validated_ids", with_views("SELECT note_id, min(pos) AS pos FROM (SELECT note_id, CAST(label AS BIGINT) * 100000 + CAST(note_id[3:] AS BIGINT) AS pos FROM note_embeddings) WHERE note_id IN (SELECT note_id FROM notes) GROUP BY 1 ORDER BY pos LIMIT 48", "notes", "note_embeddings"))
def index_validated_ids(spark, sf):
    proposed = views.note_embeddings(spark, sf).select("note_id", (F.col("label").cast("long") * 100000 + F.expr("cast(substring(note_id, 3) as bigint)")).alias("pos"))
    return index.validated_ids(proposed, views.notes(spark, sf), 48).select("note_id", "pos")


@query("state_document_ids", with_views("SELECT state_key, rtrim(translate(base64(encode(state_key)), '+/', '-_'), '=') AS document_id FROM (SELECT DISTINCT state_key FROM fact_events)", "fact_events"))
def state_document_ids(spark, sf):
    return views.fact_events(spark, sf).select("state_key").distinct().withColumn("document_id", document_id(F.col("state_key")))


@query("log_time_order", with_views("SELECT id, epoch_us(ts) // 1000 AS ms FROM messages", "messages"))
def log_time_order(spark, sf):
    return log.chronological(views.messages(spark, sf), "id").select("id", millis(F.col("ts")).alias("ms"))
