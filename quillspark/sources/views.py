"""The engine's tables as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utf16_length

FAR_FUTURE = "2024-02-01 00:00:00"
#: The clock of the queries: 2024-01-31 00:00 UTC.
NOW_MS = 1706659200000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, content, content_hash, note_ts, content_length, content_units (UTF-16).

    What is derived from a text is derived before the join, so a query that needs
    no contents moves none.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.sha1("text").alias("content_hash"), F.length("text").alias("content_length"), utf16_length(F.col("text")).alias("content_units"))
    return d.join(table(spark, sf_dir, "events"), F.col("event_id") == F.col("doc_id")).select(
        F.concat(F.lit("n-"), F.col("doc_id").cast("string")).alias("note_id"), "content", "content_hash", F.col("ts").alias("note_ts"), "content_length", "content_units"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, type, ts, source."""
    noted = notes(spark, sf_dir).select(
        F.col("note_id").alias("id"), "content", F.lit("note").alias("type"), F.col("note_ts").alias("ts"), F.lit("doc").alias("source")
    )
    kind = F.when(F.col("role") == "assistant", "ai-response").when(F.col("role") == "user", "question").otherwise("note")
    said = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("content"),
        kind.alias("type"),
        F.expr(f"timestamp_ntz'{FAR_FUTURE}' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int))").alias("ts"),
        F.lit("conv").alias("source"),
    )
    return noted.unionByName(said)


def note_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, content_hash ("stale" for label 0, null for orphans), embedding, label."""
    v, d = table(spark, sf_dir, "embeddings").alias("v"), table(spark, sf_dir, "documents").alias("d")
    return v.join(d, F.col("d.doc_id") == F.col("v.vec_id"), "left").select(
        F.concat(F.lit("n-"), F.col("v.vec_id").cast("string")).alias("note_id"),
        F.when(F.col("v.label") == 0, "stale").otherwise(F.sha1("d.text")).alias("content_hash"),
        F.col("v.embedding").alias("embedding"),
        F.col("v.label").alias("label"),
    )


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact ledger's events."""
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    kinds = ["measurement", "decision", "estimate", "plan", "hypothesis", "constraint", "identity"]
    return e.select(
        F.sha1(F.col("event_id").cast("string")).alias("fact_id"),
        F.concat(F.lit("n-"), (F.col("event_id") % 200).cast("string")).alias("source_note_id"),
        user.alias("entity"),
        F.col("event_type").alias("attribute"),
        F.concat(user, F.lit("|"), F.col("event_type")).alias("state_key"),
        F.concat(user, F.lit(" has "), F.col("event_type"), F.lit(" of "), F.round("value", 2).cast("decimal(18,2)").cast("string")).alias("claim"),
        F.round("value", 2).cast("decimal(18,2)").cast("string").alias("value_text"),
        F.col("value").alias("value_num"),
        F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 7 + 1).cast("int")).alias("polarity"),
        F.col("ts").alias("as_of"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
    )


def fact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, content_hash, status, extractor_version, attempts."""
    label = F.col("label")
    return note_embeddings(spark, sf_dir).select(
        "note_id",
        F.when(label == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(label == 1, "failed").when(label == 2, "pending").when(label == 3, "skipped").otherwise("done").alias("status"),
        F.when(label == 4, "v2").otherwise("v3").alias("extractor_version"),
        label.alias("attempts"),
    )


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, dish_id, amount, unit, menu, calculation_notes: stands in for the cost feed."""
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"),
        F.col("p_partkey").alias("dish_id"),
        F.round("p_retailprice", 2).cast("decimal(18,2)").cast("string").alias("amount"),
        F.lit("MXN").alias("unit"),
        F.col("p_type").alias("menu"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("calculation_notes"),
    )


#: The same views as SQL, for the oracles.
VIEW_SQL = {
    "notes": """SELECT 'n-' || CAST(d.doc_id AS VARCHAR) note_id, d.text AS content, sha1(d.text) content_hash, e.ts note_ts,
       length(d.text) content_length
  FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "messages": """SELECT note_id id, content, 'note' AS type, note_ts ts, 'doc' AS source FROM notes
  UNION ALL
  SELECT 'c-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text,
         CASE role WHEN 'assistant' THEN 'ai-response' WHEN 'user' THEN 'question' ELSE 'note' END,
         timestamp '2024-02-01 00:00:00' + to_minutes(conv_id * 10 + turn), 'conv'
  FROM conversations""",
    "note_embeddings": """SELECT 'n-' || CAST(v.vec_id AS VARCHAR) note_id,
       CASE WHEN v.label = 0 THEN 'stale' ELSE sha1(d.text) END content_hash, v.embedding, v.label
  FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id""",
    "fact_events": """SELECT sha1(CAST(event_id AS VARCHAR)) fact_id, 'n-' || CAST(event_id % 200 AS VARCHAR) source_note_id,
       'user ' || CAST(user_id AS VARCHAR) entity, event_type AS attribute,
       'user ' || CAST(user_id AS VARCHAR) || '|' || event_type state_key,
       'user ' || CAST(user_id AS VARCHAR) || ' has ' || event_type || ' of ' || CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) AS claim,
       CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) value_text, value AS value_num,
       CASE event_id % 7 WHEN 0 THEN 'measurement' WHEN 1 THEN 'decision' WHEN 2 THEN 'estimate' WHEN 3 THEN 'plan'
                         WHEN 4 THEN 'hypothesis' WHEN 5 THEN 'constraint' ELSE 'identity' END polarity,
       ts as_of, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 confidence
  FROM events""",
    "fact_index": """SELECT note_id, CASE WHEN label = 0 THEN 'stale' ELSE content_hash END content_hash,
       CASE label WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'skipped' ELSE 'done' END status,
       CASE WHEN label = 4 THEN 'v2' ELSE 'v3' END extractor_version, label AS attempts
  FROM note_embeddings""",
    "dishes": """SELECT p_name AS name, p_partkey dish_id, CAST(CAST(round(p_retailprice, 2) AS DECIMAL(18,2)) AS VARCHAR) amount,
       'MXN' unit, p_type menu, CASE WHEN p_size > 25 THEN 'size ' || CAST(p_size AS VARCHAR) END calculation_notes
  FROM part""",
    "ranked_facts": """SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY as_of DESC,
         CASE WHEN polarity IN ('measurement', 'decision') THEN 4 WHEN polarity IN ('constraint', 'identity') THEN 3
              WHEN polarity = 'estimate' THEN 2 WHEN polarity = 'plan' THEN 1 ELSE 0 END DESC,
         confidence DESC, fact_id) AS rn
  FROM fact_events WHERE polarity <> 'hypothesis'""",
    "current_state": """SELECT c.state_key, c.entity, c.attribute, c.claim, c.value_text, c.value_num, c.polarity, c.as_of, c.confidence,
         c.source_note_id, c.fact_id AS source_fact_id, p.value_text AS previous_value_text, p.claim AS previous_claim,
         p.as_of AS previous_as_of, p.source_note_id AS previous_source_note_id
  FROM ranked_facts c LEFT JOIN (
    SELECT o.*, row_number() OVER (PARTITION BY o.state_key ORDER BY o.rn) AS pn
    FROM ranked_facts o JOIN ranked_facts w ON w.state_key = o.state_key AND w.rn = 1
    WHERE o.rn > 1 AND (o.value_text <> w.value_text OR o.as_of <> w.as_of)) p
  ON p.state_key = c.state_key AND p.pn = 1
  WHERE c.rn = 1""",
}
_NEEDS = {"messages": ["notes"], "fact_index": ["note_embeddings"], "ranked_facts": ["fact_events"], "current_state": ["ranked_facts"]}


def units(text: str) -> str:
    """SQL for the length of a text in UTF-16 units."""
    return f"(length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def with_views(body: str, *names: str) -> str:
    """``body`` behind a WITH clause of the views it names and of those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{name} AS (\n  {VIEW_SQL[name]})" for name in order)
    body, opening = body.strip(), "WITH"
    for start in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(start + " "):
            opening, rest = start, body[len(start) + 1 :]
            return f"{opening} {head},\n{rest}" if order else body
    return f"{opening} {head}\n{body}" if order else body
