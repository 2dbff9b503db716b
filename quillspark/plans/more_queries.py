"""Queries over digests, vectors of texts, point reads, and the pieces around model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import utf16_length
from ..operators import embedding, ledger, message_log, model_json, note_index, render
from ..sources import views
from ..sources.views import units, with_views
from ..storage import new_path
from .registry import query

# --- digests

TREE = """WITH leaves AS (SELECT ('0x' || md5(note_id)[1:2])::INTEGER AS node, count(*) AS n, sha1(string_agg(note_id || ':' || content_hash, '|' ORDER BY encode(note_id || ':' || content_hash))) AS digest FROM notes GROUP BY 1),
middle AS (SELECT node // 16 AS node, sum(n) AS n, sha1(string_agg(node || ':' || digest, '|' ORDER BY node)) AS digest FROM leaves GROUP BY 1),
top AS (SELECT 0 AS node, sum(n) AS n, sha1(string_agg(node || ':' || digest, '|' ORDER BY node)) AS digest FROM middle)
SELECT 2 AS level, node, CAST(n AS BIGINT) AS n, digest FROM leaves UNION ALL SELECT 1, node, CAST(n AS BIGINT), digest FROM middle UNION ALL SELECT 0, node, CAST(n AS BIGINT), digest FROM top"""


@query("index_tree", with_views(TREE, "notes"))
def index_tree(spark, sf):
    return note_index.tree(views.notes(spark, sf))


CHANGES = """WITH old AS (SELECT note_id, content_hash FROM note_embeddings WHERE content_hash IS NOT NULL)
SELECT coalesce(n.note_id, o.note_id) AS note_id, CASE WHEN o.note_id IS NULL THEN 'add' WHEN n.note_id IS NULL THEN 'delete' ELSE 'update' END AS action
FROM notes n FULL JOIN old o ON o.note_id = n.note_id WHERE n.content_hash IS DISTINCT FROM o.content_hash"""


@query("index_tree_changes", with_views(CHANGES, "notes", "note_embeddings"))
def index_tree_changes(spark, sf):
    """What differs between the stored index of the vectors and that of the notes, read from the ranges that differ."""
    old, new = new_path(spark, "index-old"), new_path(spark, "index-new")
    note_index.write_index(views.note_embeddings(spark, sf).filter("content_hash is not null"), old)
    note_index.write_index(views.notes(spark, sf), new)
    return note_index.changed_entries(spark, old, new)


@query(
    "log_snapshots",
    with_views("""SELECT id, sha1(CAST(to_json({'id': id, 'content': content, 'type': type, 'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'}) AS VARCHAR)) AS snapshot_sha1
FROM messages WHERE NOT (type = 'ai-response' AND trim(content) = '')""", "messages"),
)
def log_snapshots(spark, sf):
    return message_log.snapshots(views.messages(spark, sf)).select("id", F.sha1("snapshot").alias("snapshot_sha1"))


@query(
    "log_json_bytes",
    with_views("""SELECT type, count(*) AS n, CAST(sum(octet_length(encode(CAST(to_json({'id': id, 'content': content, 'type': type, 'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'}) AS VARCHAR)))) AS BIGINT) AS bytes FROM messages GROUP BY 1""", "messages"),
)
def log_json_bytes(spark, sf):
    return message_log.json_bytes(views.messages(spark, sf))


LOADABLE = """WITH m AS (SELECT id, type, CASE WHEN id LIKE '%-1' THEN ' ' ELSE content END AS content, CASE WHEN length(content) % 3 = 0 THEN 1 ELSE 0 END AS thoughts, CASE WHEN length(content) % 5 = 0 THEN 1 END AS code FROM messages)
SELECT id, type FROM m WHERE type <> 'ai-response' OR trim(content) <> '' OR thoughts > 0 OR coalesce(code, 0) > 0"""


@query("log_loadable", with_views(LOADABLE, "messages"))
def log_loadable(spark, sf):
    """The log as it is loaded, first answers blanked, some with thoughts and some with code blocks."""
    m = views.messages(spark, sf).withColumn("_n", F.length("content"))
    m = m.withColumn("thoughts", F.when(F.col("_n") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))).withColumn("code_blocks", F.when(F.col("_n") % 5 == 0, F.array(F.lit("b"))))
    return message_log.loadable(m.withColumn("content", F.when(F.col("id").endswith("-1"), " ").otherwise(F.col("content")))).select("id", "type")


# --- point reads and mapped rows

GETS = """WITH w AS (SELECT DISTINCT 'n-' || CAST(vec_id * 7 AS VARCHAR) AS note_id FROM embeddings WHERE label = 3)
SELECT w.note_id, i.status, i.attempts, i.note_id IS NOT NULL AS found FROM w LEFT JOIN fact_index i ON i.note_id = w.note_id"""


@query("index_point_get", with_views(GETS, "fact_index"))
def index_point_get(spark, sf):
    """The index rows of some notes, of which some have none."""
    wanted = views.table(spark, sf, "embeddings").filter("label = 3").select(F.concat(F.lit("n-"), (F.col("vec_id") * 7).cast("string")).alias("note_id"))
    return ledger.point_get(views.fact_index(spark, sf), "note_id", wanted).select("note_id", "status", "attempts", "found")


MAPPED = """SELECT fact_id, CASE WHEN polarity = 'plan' THEN claim ELSE entity || CASE WHEN attribute = 'view' THEN '' ELSE ' · ' || attribute END || ' · ' || value_text || CASE WHEN polarity = 'estimate' THEN ' · MXN' ELSE '' END END AS claim,
  CASE WHEN polarity = 'decision' THEN 0.5 ELSE confidence END AS confidence, CASE WHEN polarity = 'identity' THEN 'estimate' ELSE polarity END AS polarity FROM fact_events"""


@query("facts_mapped", with_views(MAPPED, "fact_events"))
def facts_mapped(spark, sf):
    """Facts as they are read, after claims, attributes, confidences and polarities of some kinds are taken away."""
    f, p = views.fact_events(spark, sf), F.col("polarity")
    raw = f.withColumns({
        "claim": F.when(p == "plan", F.col("claim")), "unit": F.when(p == "estimate", "MXN"), "attribute": F.when(F.col("attribute") != "view", F.col("attribute")),
        "confidence": F.when(p != "decision", F.col("confidence")), "polarity": F.when(p == "identity", "unknown").otherwise(p),
    })
    return ledger.mapped_facts(raw).select("fact_id", "claim", "confidence", "polarity")


# --- around model calls

VECTORS = """WITH t AS (SELECT note_id, unnest(regexp_extract_all(lower(content[1:28000]), '[\\p{L}\\p{N}]+')) AS token FROM notes),
s AS (SELECT note_id, ('0x' || md5(token)[1:8])::BIGINT % 64 AS place, sum(CASE WHEN ('0x' || md5(token)[9:9])::INTEGER % 2 = 0 THEN 1 ELSE -1 END) AS s FROM t GROUP BY ALL),
n AS (SELECT note_id, sqrt(sum(s * s)::DOUBLE) AS norm FROM s GROUP BY 1)
SELECT note_id, place, round(s / norm, 6) AS value FROM s JOIN n USING (note_id) WHERE s <> 0"""


@query("embed_default", with_views(VECTORS, "notes"))
def embed_default(spark, sf):
    """The components that aren't zero of every note's default vector of 64 dimensions."""
    v = embedding.default_vectors(views.notes(spark, sf).select("note_id", F.col("content").alias("text")), "note_id", 64)
    return v.select("note_id", F.posexplode("embedding").alias("place", "value")).filter("value <> 0").select("note_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


NAMES = """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'models/' || trim(text[1:9], ' ' || chr(10)) WHEN 'system' THEN 'models/embedding-default' ELSE 'models/x' || turn END AS model,
  CASE WHEN turn = 0 THEN 768.0 WHEN turn % 2 = 1 THEN 64.0 * turn ELSE 768.0 END AS dims FROM conversations"""


@query("model_names", NAMES)
def model_names(spark, sf):
    """Names and dimensions as they are configured: bare, prefixed and missing; numbers, zero and no number."""
    c = views.table(spark, sf, "conversations")
    name = F.when(F.col("role") == "user", F.substring("text", 1, 9)).when(F.col("role") == "assistant", F.concat(F.lit(" models/x"), F.col("turn").cast("string")))
    size = F.when(F.col("turn") == 0, "0").when(F.col("turn") % 2 == 1, (64 * F.col("turn")).cast("string")).otherwise(F.lit("many"))
    return c.select("conv_id", "turn", embedding.model_name(name).alias("model"), embedding.dimensions(size).alias("dims"))


PARTS = """SELECT conv_id, sha1(coalesce(trim(string_agg(CASE WHEN role = 'system' THEN '' ELSE text END, '' ORDER BY turn), ' ' || chr(10)), '')) AS text_sha1 FROM conversations GROUP BY 1"""


@query("candidate_parts", PARTS)
def candidate_parts(spark, sf):
    """A model's answer made of a conversation: each turn a part of the first candidate, system turns without text."""
    part = F.when(F.col("role") == "system", F.lit("{}")).otherwise(F.to_json(F.struct("text")))
    c = views.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))).alias("all"))
    payload = F.concat(F.lit('{"candidates": [{"content": {"parts": ['), F.array_join(F.transform("all", lambda x: x["p"]), ","), F.lit(']}}, {"content": {"parts": [{"text": "second"}]}}]}'))
    return c.select("conv_id", F.sha1(model_json.candidate_text(payload)).alias("text_sha1"))


COMBINED = f"""WITH s AS (SELECT string_agg(line, chr(10) ORDER BY state_key) AS state FROM (SELECT state_key, '- ' || claim AS line FROM current_state ORDER BY state_key LIMIT 20)),
n AS (SELECT note_id, trim(content) AS content, {units("trim(content)")} AS u FROM notes),
c AS (SELECT note_id, u, CASE WHEN u > 400 THEN regexp_replace(content[1:399], '\\s+$', '') || '…' ELSE content END AS text FROM n)
SELECT note_id, u, sha1(state || chr(10) || chr(10) || 'NOTES' || chr(10) || text) AS prompt_sha1 FROM c, s"""


@query("prompt_combined", with_views(COMBINED, "notes", "current_state"))
def prompt_combined(spark, sf):
    """Every note, cut to 400 units, behind the first twenty state lines (a block of fixed length)."""
    lines = ledger.current_state(views.fact_events(spark, sf)).orderBy("state_key").limit(20).select("state_key", F.concat(F.lit("- "), "claim").alias("line"))
    block = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state_key", "line"))), lambda x: x["line"]), "\n").alias("state"))
    notes = views.notes(spark, sf)
    clipped = render.clipped_notes(F.col("content"), F.lit(400))
    both = notes.crossJoin(F.broadcast(block))  # one row
    return both.select("note_id", utf16_length(F.trim("content")).alias("u"), F.sha1(render.combined(F.col("state"), clipped)).alias("prompt_sha1"))
