"""Queries over the fact ledger, its state and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coercion
from ..functions.text import collapse, join_nonempty, stamp
from ..operators import drafts, ledger, render
from ..sources import views
from ..sources.views import units, with_views
from ..storage import running_sum
from .registry import query

FACT = "fact_id, source_note_id, state_key, value_text, polarity, as_of, confidence"


def _facts(spark, sf):
    return views.fact_events(spark, sf)


@query("facts_scan", with_views(f"SELECT {FACT} FROM fact_events", "fact_events"))
def facts_scan(spark, sf):
    return _facts(spark, sf).select(*FACT.split(", "))


@query("facts_by_note", with_views(f"SELECT {FACT} FROM fact_events WHERE source_note_id = 'n-7'", "fact_events"))
def facts_by_note(spark, sf):
    return _facts(spark, sf).filter("source_note_id = 'n-7'").select(*FACT.split(", "))


@query("facts_by_key", with_views("SELECT state_key, count(*) n, min(as_of) first_as_of, max(as_of) last_as_of FROM fact_events GROUP BY 1", "fact_events"))
def facts_by_key(spark, sf):
    return ledger.facts_by_key(_facts(spark, sf))


@query("facts_eligible", with_views("SELECT polarity, count(*) n FROM fact_events WHERE polarity <> 'hypothesis' GROUP BY 1", "fact_events"))
def facts_eligible(spark, sf):
    return ledger.eligible(_facts(spark, sf)).groupBy("polarity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "facts_dedupe",
    with_views(
        """WITH k AS (SELECT *, min(fact_id) OVER g AS position, row_number() OVER (PARTITION BY source_note_id, state_key, lower(value_text), polarity, CAST(as_of AS DATE) ORDER BY confidence DESC, fact_id) rn
  FROM fact_events WINDOW g AS (PARTITION BY source_note_id, state_key, lower(value_text), polarity, CAST(as_of AS DATE))),
n AS (SELECT *, row_number() OVER (PARTITION BY source_note_id ORDER BY position) pn FROM k WHERE rn = 1)
SELECT source_note_id, fact_id, position, confidence FROM n WHERE pn <= 40""",
        "fact_events",
    ),
)
def facts_dedupe(spark, sf):
    return ledger.dedupe_facts(_facts(spark, sf)).select("source_note_id", "fact_id", "position", "confidence")


@query("state_winners", with_views("SELECT state_key, fact_id, value_text, polarity, as_of, confidence FROM ranked_facts WHERE rn = 1", "ranked_facts"))
def state_winners(spark, sf):
    return ledger.winners(_facts(spark, sf)).select("state_key", "fact_id", "value_text", "polarity", "as_of", "confidence")


@query("state_current", with_views("SELECT * FROM current_state", "current_state"))
def state_current(spark, sf):
    return ledger.current_state(_facts(spark, sf))


@query("state_recompute", with_views("SELECT state_key, source_fact_id, previous_value_text FROM current_state", "current_state"))
def state_recompute(spark, sf):
    """The state from facts without purchases, with all purchase keys computed anew."""
    facts = _facts(spark, sf)
    keys = facts.select("state_key", "attribute")
    last = facts.groupBy().agg(F.max("attribute").alias("a"))
    touched = keys.join(F.broadcast(last), F.col("attribute") == F.col("a")).select("state_key")
    stale = ledger.current_state(facts.join(touched.distinct(), "state_key", "left_anti"))
    return ledger.recompute(facts, stale, touched).select("state_key", "source_fact_id", "previous_value_text")


@query("state_previous", with_views("SELECT state_key, previous_value_text, previous_as_of, previous_source_note_id FROM current_state WHERE previous_value_text IS NOT NULL", "current_state"))
def state_previous(spark, sf):
    s = ledger.current_state(_facts(spark, sf))
    return s.filter("previous_value_text is not null").select("state_key", "previous_value_text", "previous_as_of", "previous_source_note_id")


@query("state_listing", with_views("SELECT state_key, entity, attribute, value_text, polarity FROM current_state", "current_state"))
def state_listing(spark, sf):
    return ledger.current_state(_facts(spark, sf)).select("state_key", "entity", "attribute", "value_text", "polarity").orderBy("state_key")


@query("state_sample", with_views("SELECT rtrim(translate(base64(encode(state_key)), '+/', '-_'), '=') AS document_id, state_key, value_text FROM current_state ORDER BY 1 LIMIT 40", "current_state"))
def state_sample(spark, sf):
    return ledger.state_sample(ledger.current_state(_facts(spark, sf)), 40).select("document_id", "state_key", "value_text")


DISPLAY = "CASE polarity WHEN 'measurement' THEN 0 WHEN 'decision' THEN 1 WHEN 'constraint' THEN 2 WHEN 'estimate' THEN 3 WHEN 'plan' THEN 4 WHEN 'identity' THEN 5 ELSE 9 END"
LINES = f"""lines AS (SELECT state_key, row_number() OVER (ORDER BY {DISPLAY}, as_of DESC, state_key) AS rank, as_of, previous_value_text,
  '- ' || claim || ' [' || polarity || ', as of ' || strftime(as_of, '%Y-%m-%d') || ']' || CASE WHEN previous_claim IS NOT NULL THEN '  (was: ' || previous_claim || ')' ELSE '' END AS line,
  '- ' || strftime(as_of, '%Y-%m-%d') || ' · ' || previous_claim || ' → ' || claim AS change FROM current_state)"""
PACKED = "packed AS (SELECT rank, state_key, line, CAST(chars AS BIGINT) AS chars FROM (SELECT *, sum(" + units("line").replace("{", "{{").replace("}", "}}") + " + 1) OVER (ORDER BY rank) AS chars FROM lines) WHERE chars <= {})"


@query("state_display_order", with_views(f"WITH {LINES} SELECT rank, state_key, line FROM lines", "current_state"))
def state_display_order(spark, sf):
    s = ledger.current_state(_facts(spark, sf)).withColumn("display", ledger.display_rank())
    s = s.select("display", (-F.unix_micros(F.col("as_of").cast("timestamp"))).alias("age"), "state_key", render.state_line(s).alias("line"), F.lit(1).cast("long").alias("one"))
    return running_sum(s, ["display", "age", "state_key"], "one", "rank", "display").select("rank", "state_key", "line")


@query("pack_prefix_state", with_views(f"WITH {LINES}, {PACKED.format(12000)} SELECT * FROM packed", "current_state"))
def pack_prefix_state(spark, sf):
    return render.packed_state(ledger.current_state(_facts(spark, sf)))


@query("state_supersessions", with_views("SELECT state_key, as_of, value_text, previous_value_text FROM current_state WHERE previous_value_text IS NOT NULL ORDER BY as_of DESC, state_key LIMIT 25", "current_state"))
def state_supersessions(spark, sf):
    return ledger.supersessions(ledger.current_state(_facts(spark, sf))).select("state_key", "as_of", "value_text", "previous_value_text")


WORLD = f"""WITH {LINES}, {PACKED}, news AS (SELECT row_number() OVER (ORDER BY as_of DESC, state_key) AS rank, change FROM lines WHERE previous_value_text IS NOT NULL ORDER BY as_of DESC, state_key LIMIT 25),
world AS (SELECT 0 AS part, 0 AS rank, 'CURRENT STATE' AS line WHERE EXISTS (SELECT 1 FROM lines) UNION ALL SELECT 1, rank, line FROM packed
  UNION ALL SELECT 2, 0, 'RECENT SUPERSESSIONS' WHERE EXISTS (SELECT 1 FROM news) UNION ALL SELECT 3, rank, change FROM news)"""


@query("world_state", with_views(WORLD.format(12000) + " SELECT * FROM world", "current_state"))
def world_state(spark, sf):
    return render.world_state(ledger.current_state(_facts(spark, sf)))


@query("budget_split", with_views(WORLD.format(12000) + ", u AS (SELECT CAST(sum(length(line) + 1) - 1 AS BIGINT) AS state_chars FROM world) SELECT 28000 AS total, state_chars, greatest(0, 28000 - state_chars - 320) AS notes_chars FROM u", "current_state"))
def budget_split(spark, sf):
    return render.budget_split(ledger.current_state(_facts(spark, sf)), 28000)


@query("facts_event_lines", with_views("SELECT fact_id, as_of, '- ' || strftime(as_of, '%Y-%m-%d') || ' [' || polarity || '] ' || claim AS line FROM fact_events", "fact_events"))
def facts_event_lines(spark, sf):
    return render.event_lines(_facts(spark, sf))


SIGNAL = f"""WITH {LINES} SELECT 'state' AS section, state_key AS sort_key, line FROM lines
UNION ALL SELECT 'change', state_key, change FROM lines WHERE previous_value_text IS NOT NULL
UNION ALL SELECT 'event', fact_id, '- ' || strftime(as_of, '%Y-%m-%d') || ' [' || polarity || '] ' || claim FROM fact_events"""


@query("signal_export", with_views(SIGNAL, "current_state"))
def signal_export(spark, sf):
    """All lines of the signal report, by section; ``render.write_lines`` writes them in order."""
    facts = _facts(spark, sf)
    state = ledger.current_state(facts)
    named = lambda df, section, key: df.select(F.lit(section).alias("section"), F.col(key).alias("sort_key"), "line")
    changed = state.filter("previous_value_text is not null")
    return (
        named(state.withColumn("line", render.state_line(state)), "state", "state_key")
        .unionByName(named(changed.withColumn("line", render.supersession_line(changed)), "change", "state_key"))
        .unionByName(named(render.event_lines(facts), "event", "fact_id"))
    )


@query("notes_export", with_views("SELECT note_id, note_ts, sha1('[' || strftime(note_ts, '%-m/%-d/%y, %-I:%M %p') || '] ' || content) AS line_sha1 FROM notes", "notes"))
def notes_export(spark, sf):
    return render.note_lines(views.notes(spark, sf)).select("note_id", "note_ts", F.sha1("line").alias("line_sha1"))


DIRTY = """dirty AS (SELECT n.*, i.note_id AS i_id, i.status, i.extractor_version,
  i.note_id IS NULL OR i.content_hash IS DISTINCT FROM n.content_hash OR i.extractor_version IS DISTINCT FROM 'v3'
  OR coalesce(i.status = 'failed' AND i.attempts < 4, false) OR coalesce(i.status = 'pending', false) AS is_dirty
  FROM notes n LEFT JOIN fact_index i ON i.note_id = n.note_id)"""


@query("facts_dirty_notes", with_views(f"WITH {DIRTY} SELECT note_id, is_dirty AS dirty FROM dirty", "notes", "fact_index"))
def facts_dirty_notes(spark, sf):
    return ledger.with_index(views.notes(spark, sf), views.fact_index(spark, sf)).select("note_id", "dirty")


@query("facts_dirty_queue", with_views(f"WITH {DIRTY} SELECT note_id, note_ts FROM dirty WHERE is_dirty ORDER BY note_ts DESC, note_id LIMIT 15", "notes", "fact_index"))
def facts_dirty_queue(spark, sf):
    return ledger.dirty_queue(views.notes(spark, sf), views.fact_index(spark, sf), 15)


@query(
    "ledger_status",
    with_views(
        f"""WITH {DIRTY}, c AS (SELECT count(*) total, count(*) FILTER (WHERE is_dirty) remaining, count(*) FILTER (WHERE status = 'done') n_done,
  count(*) FILTER (WHERE status = 'skipped') n_skipped, count(*) FILTER (WHERE status = 'failed') n_failed, count(*) FILTER (WHERE status = 'pending') n_pending,
  count(*) FILTER (WHERE i_id IS NOT NULL AND extractor_version <> 'v3') stale_version FROM dirty)
SELECT *, total - remaining AS processed, CAST(floor(100 * (total - remaining) / total + 0.5) AS BIGINT) AS percent FROM c""",
        "notes",
        "fact_index",
    ),
)
def ledger_status(spark, sf):
    return ledger.ledger_status(views.notes(spark, sf), views.fact_index(spark, sf))


@query("facts_replace_by_note", with_views("SELECT source_note_id, count(*) n FROM fact_events WHERE source_note_id <> 'n-3' OR polarity = 'decision' GROUP BY 1", "fact_events"))
def facts_replace_by_note(spark, sf):
    facts = _facts(spark, sf)
    ids = facts.filter("source_note_id = 'n-3'").select(F.col("source_note_id").alias("note_id"))
    new = facts.filter("source_note_id = 'n-3' and polarity = 'decision'")
    return ledger.replace_facts(facts, new, ids).groupBy("source_note_id").agg(F.count(F.lit(1)).alias("n"))


@query("facts_touched_keys", with_views("SELECT DISTINCT state_key FROM fact_events WHERE source_note_id = 'n-3' OR polarity = 'plan'", "fact_events"))
def facts_touched_keys(spark, sf):
    facts = _facts(spark, sf)
    ids = facts.filter("source_note_id = 'n-3'").select(F.col("source_note_id").alias("note_id"))
    return ledger.touched_keys(facts, facts.filter("polarity = 'plan'"), ids)


@query(
    "facts_beat_state",
    with_views(
        """WITH e AS (SELECT f.fact_id, f.as_of, f.polarity, f.confidence, c.as_of s_as_of, c.polarity s_polarity, c.confidence s_confidence FROM fact_events f JOIN current_state c ON c.state_key = f.state_key),
r AS (SELECT *, CASE WHEN polarity IN ('measurement', 'decision') THEN 4 WHEN polarity IN ('constraint', 'identity') THEN 3 WHEN polarity = 'estimate' THEN 2 WHEN polarity = 'plan' THEN 1 ELSE 0 END a,
  CASE WHEN s_polarity IN ('measurement', 'decision') THEN 4 WHEN s_polarity IN ('constraint', 'identity') THEN 3 WHEN s_polarity = 'estimate' THEN 2 WHEN s_polarity = 'plan' THEN 1 ELSE 0 END b FROM e)
SELECT fact_id, CASE WHEN as_of <> s_as_of THEN as_of > s_as_of WHEN a <> b THEN a > b ELSE confidence >= s_confidence END AS beats FROM r""",
        "current_state",
    ),
)
def facts_beat_state(spark, sf):
    facts = _facts(spark, sf)
    state = ledger.current_state(facts).select("state_key", *[F.col(c).alias(f"s_{c}") for c in ("as_of", "polarity", "confidence")])
    return facts.join(state, "state_key").select("fact_id", ledger.event_beats_state("", "s_").alias("beats"))


@query(
    "facts_coerced",
    with_views(
        """SELECT fact_id, CASE WHEN polarity IN ('measurement', 'decision', 'plan', 'hypothesis', 'constraint', 'identity') THEN polarity ELSE 'estimate' END AS polarity,
  least(1.0, greatest(0.0, confidence * 2 - 0.5)) AS confidence, entity || ' · ' || attribute || ' · ' || value_text AS claim FROM fact_events""",
        "fact_events",
    ),
)
def facts_coerced(spark, sf):
    return _facts(spark, sf).select(
        "fact_id",
        coercion.polarity(F.col("polarity")).alias("polarity"),
        coercion.confidence(F.col("confidence") * 2 - 0.5).alias("confidence"),
        join_nonempty([F.col("entity"), F.col("attribute"), F.col("value_text"), F.lit("")], " · ").alias("claim"),
    )


@query("facts_state_keys", with_views("SELECT DISTINCT lower(entity) || '|' || replace(lower(attribute), ' ', '_') AS state_key FROM fact_events", "fact_events"))
def facts_state_keys(spark, sf):
    return _facts(spark, sf).select("entity", "attribute").distinct().select(drafts.state_key(F.col("entity"), F.col("attribute")).alias("state_key")).distinct()


@query(
    "facts_drafts",
    with_views(
        """WITH d AS (SELECT fact_id, entity, CASE WHEN attribute IN ('click', 'view') THEN 'price' ELSE attribute END AS attribute, value_text, claim,
  claim || CASE WHEN polarity = 'plan' THEN ' with a monthly subscription' ELSE '' END AS raw_span FROM fact_events),
u AS (SELECT *, CASE WHEN attribute <> 'price' THEN attribute WHEN regexp_matches(lower(claim || ' ' || raw_span || ' ' || entity), 'month|mensual|subscription|suscrip') THEN 'subscription_price_monthly' ELSE NULL END AS better,
  length(claim) >= 24 AND (contains(lower(claim), 'user')) AND contains(lower(claim), value_text) AS stands FROM d)
SELECT fact_id, coalesce(better, 'value_unspecified') AS attribute, CASE WHEN stands THEN claim ELSE (entity || ': ' || raw_span)[1:280] END AS claim FROM u
WHERE (better IS NOT NULL OR stands) AND length(claim) >= 20 AND (stands OR length(raw_span) >= 40)""",
        "fact_events",
    ),
)
def facts_drafts(spark, sf):
    f = _facts(spark, sf)
    raw = f.select(
        "fact_id", "entity", F.when(F.col("attribute").isin("click", "view"), "price").otherwise(F.col("attribute")).alias("attribute"), "value_text", "claim",
        F.concat("claim", F.when(F.col("polarity") == "plan", " with a monthly subscription").otherwise("")).alias("raw_span"),
    )
    return drafts.normalise_drafts(raw, unicode=False).select("fact_id", "attribute", "claim")


@query(
    "facts_ids",
    with_views(
        """SELECT fact_id AS idx, sha1(source_note_id || '|' || state_key || '|' || claim || '|' || value_text || '|' || strftime(as_of, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || polarity || '|' || fact_id || '|' || sha1(claim)) AS fact_id FROM fact_events""",
        "fact_events",
    ),
)
def facts_ids(spark, sf):
    f = _facts(spark, sf).select(F.col("source_note_id").alias("note_id"), "entity", "attribute", "claim", "value_text", "polarity", F.col("as_of").alias("note_ts"), F.lit(None).cast("string").alias("draft_as_of"), F.col("fact_id").alias("idx"), F.sha1("claim").alias("content_hash"))
    return drafts.to_events(f, unicode=False).select("idx", "fact_id")


@query(
    "notes_skip_rules",
    with_views("SELECT note_id, CASE WHEN length(trim(content)) < 12 THEN 'too_short' WHEN regexp_matches(lower(content), '^this is a test\\b') AND length(content) < 80 THEN 'test_note' END AS reason FROM notes", "notes"),
)
def notes_skip_rules(spark, sf):
    return views.notes(spark, sf).select("note_id", drafts.skip_reason(F.col("content")).alias("reason"))


@query(
    "notes_derived_analysis",
    with_views(
        r"""SELECT note_id, length(content) >= 4000 AND (len(regexp_extract_all(content, '(?m)^\d+\.\s')) >= 4 OR len(regexp_extract_all(content, '(?m)^---+$')) >= 3
  OR (length(content) > 8000 AND regexp_matches(lower(content), '(you think|your realistic|scenario|option [ab]:|break-even|reconstructed)'))) AS derived FROM notes""",
        "notes",
    ),
)
def notes_derived_analysis(spark, sf):
    return views.notes(spark, sf).select("note_id", drafts.is_derived_analysis(F.col("content")).alias("derived"))


CHUNKS = r"""WITH RECURSIVE base AS ({notes}),
cut(note_id, content, chunk, s, e) AS (
  SELECT note_id, content, 0, 0, {end} FROM (SELECT *, 0 AS s FROM base)
  UNION ALL
  SELECT note_id, content, chunk + 1, s, {end} FROM (SELECT note_id, content, chunk, greatest(0, e - 200) AS s FROM cut WHERE e < length(content)))
SELECT note_id, chunk, sha1(CASE WHEN length(content) <= 2800 THEN content ELSE trim(content[s + 1:e], ' ' || chr(10)) END) AS chunk_sha1 FROM cut"""


def _chunk_end() -> str:
    piece = "content[s + 1:s + 2800]"
    last = lambda mark: f"(CASE WHEN contains({piece}, {mark}) THEN length({piece}) - position(reverse({mark}) IN reverse({piece})) - length({mark}) + 1 ELSE -1 END)"
    at = f"greatest({last('chr(10)')}, {last('(chr(10) || chr(10))')}, {last(chr(39) + '. ' + chr(39))})"
    return f"CASE WHEN s + 2800 >= length(content) THEN length(content) WHEN {at} > 1120 THEN s + {at} + 1 ELSE s + 2800 END"


@query("notes_chunks", CHUNKS.format(notes=views.VIEW_SQL["notes"], end=_chunk_end()))
def notes_chunks(spark, sf):
    from ..shipping import ship

    ship(spark)
    return drafts.chunk_notes(views.notes(spark, sf)).select("note_id", "chunk", F.sha1("chunk_text").alias("chunk_sha1"))


@query("notes_collapsed", with_views("SELECT note_id, sha1(regexp_replace(content, '\\s+', ' ', 'g')) AS sha FROM notes", "notes"))
def notes_collapsed(spark, sf):
    return views.notes(spark, sf).select("note_id", F.sha1(collapse(F.col("content"))).alias("sha"))


@query(
    "notes_stamps",
    with_views("SELECT note_id, strftime(note_ts, '%-m/%-d/%Y') AS d, strftime(note_ts, '%a, %b %-d, %Y, %I:%M %p') AS dt, strftime(note_ts, '%Y-%m-%d') AS day FROM notes", "notes"),
)
def notes_stamps(spark, sf):
    t = F.col("note_ts")
    return views.notes(spark, sf).select("note_id", stamp(t, "date").alias("d"), stamp(t, "datetime").alias("dt"), stamp(t, "day").alias("day"))
