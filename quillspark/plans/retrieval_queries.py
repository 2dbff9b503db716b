"""Queries of hybrid retrieval and budget packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COMBINE_OVERHEAD, PROFILES, STOP_WORDS
from ..functions import scoring
from ..operators import retrieval
from ..operators.render import state_budget
from ..sources import views
from ..sources.views import NOW_MS, with_views
from . import context
from .ledger_queries import WORLD
from .registry import query


def _vectors(spark, sf):
    return context.query_vectors(views.table(spark, sf, "embeddings"))


def _scored(spark, sf, name, terms=()):
    return retrieval.score(views.notes(spark, sf), views.note_embeddings(spark, sf), _vectors(spark, sf), NOW_MS, PROFILES[name], terms)


def scored_sql(name: str) -> str:
    p = PROFILES[name]
    days = f"greatest(0, {NOW_MS} - epoch_ms(note_ts)) / 86400000.0::DOUBLE"
    return f"""queries AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3),
base AS (SELECT n.note_id, n.note_ts, n.content, n.content_length, v.embedding::DOUBLE[] AS e, {days} AS days
  FROM notes n JOIN note_embeddings v ON v.note_id = n.note_id WHERE len(v.embedding) > 0),
parts AS (SELECT b.note_id, b.note_ts, b.content, b.content_length, max(greatest(0.0::DOUBLE, list_dot_product(q, e))) AS similarity,
  any_value(CASE WHEN days <= {p.recent_window_days} THEN least(1.0::DOUBLE, 1 / (1 + days / {p.half_life_days}) + 0.2) ELSE 1 / (1 + days / {p.half_life_days}) END) AS recency
  FROM base b, queries GROUP BY b.note_id, b.note_ts, b.content, b.content_length),
scored AS (SELECT note_id, note_ts, content, content_length, similarity, recency,
  similarity * {p.similarity}::DOUBLE + recency * {p.recency}::DOUBLE + CASE WHEN content_length > 0 AND content_length < {p.short_max} THEN {p.short_boost}::DOUBLE * (1 - content_length / {p.short_max}::DOUBLE) ELSE 0 END AS score
  FROM parts),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, note_ts DESC, note_id) AS rank FROM scored)"""


ROUNDED = "note_id, round(similarity, 6) AS similarity, round(recency, 6) AS recency, round(score, 6) AS score"


def _rounded(df):
    return df.select("note_id", *[F.round(c, 6).alias(c) for c in ("similarity", "recency", "score")])


def _register_rank(name: str) -> None:
    @query(f"retrieve_rank_{name}", with_views(f"WITH {scored_sql(name)} SELECT {ROUNDED} FROM scored", "notes", "note_embeddings"))
    def rank(spark, sf):
        return _rounded(_scored(spark, sf, name))

    @query(f"retrieve_topk_{name}", with_views(f"WITH {scored_sql(name)} SELECT {ROUNDED} FROM ranked WHERE rank <= {PROFILES[name].candidate_limit}", "notes", "note_embeddings"))
    def topk(spark, sf):
        return _rounded(retrieval.top_candidates(_scored(spark, sf, name), PROFILES[name]))


for _name in PROFILES:
    _register_rank(_name)


#: The best of the candidates ``c``, the last of them giving way to the best recent one where none is recent.
COVERED = "rank < n OR (rank = n AND NOT coalesce(first_recent > n, false)) OR (first_recent > n AND rank = first_recent)"


def _candidates_sql(name: str) -> str:
    p = PROFILES[name]
    return f"""c AS (SELECT *, least({p.selection_limit}, (SELECT count(*) FROM ranked WHERE rank <= {p.candidate_limit})) AS n,
  (SELECT min(rank) FROM ranked WHERE rank <= {p.candidate_limit} AND recency > 0.2) AS first_recent FROM ranked WHERE rank <= {p.candidate_limit})"""


def _coverage_sql(name: str) -> str:
    return f"WITH {scored_sql(name)}, {_candidates_sql(name)}\nSELECT note_id, rank FROM c WHERE {COVERED}"


@query("retrieve_coverage_reframe", with_views(_coverage_sql("reframe"), "notes", "note_embeddings"))
def coverage_reframe(spark, sf):
    p = PROFILES["reframe"]
    return retrieval.selection(retrieval.top_candidates(_scored(spark, sf, "reframe"), p), p).select("note_id", "rank")


@query("retrieve_coverage_longform", with_views(_coverage_sql("longform"), "notes", "note_embeddings"))
def coverage_longform(spark, sf):
    p = PROFILES["longform"]
    return retrieval.selection(retrieval.top_candidates(_scored(spark, sf, "longform"), p), p).select("note_id", "rank")


def greedy_sql(budget: int, style: str, source: str) -> str:
    """The fold as a recursive CTE over ``source`` (note_id, line_length, content_length, k = 1, 2, ...)."""
    first = f"CASE WHEN line_length > {budget} THEN line_length - content_length + least(content_length, {max(120, budget - 32)}) + 2 ELSE line_length + 1 END"
    return f"""fold(k, total, picked, note_id) AS (
  SELECT CAST(1 AS BIGINT), CAST({first} AS BIGINT), true, note_id FROM {source} WHERE k = 1
  UNION ALL
  SELECT s.k, CASE WHEN f.total + s.line_length <= {budget} THEN f.total + s.line_length + 1 ELSE f.total END, f.total + s.line_length <= {budget}, s.note_id
  FROM fold f JOIN {source} s ON s.k = f.k + 1 WHERE f.total < {budget})"""


@query(
    "pack_recent_notes",
    with_views(
        f"""WITH RECURSIVE lined AS MATERIALIZED (SELECT note_id, length('[' || strftime(note_ts, '%-m/%-d/%Y') || '] ' || content) AS line_length, content_length,
  row_number() OVER (ORDER BY note_ts DESC, note_id) AS k FROM notes), {greedy_sql(28000, "date", "lined")}
SELECT f.note_id, row_number() OVER (ORDER BY k) AS pick FROM fold f WHERE picked""",
        "notes",
    ),
)
def pack_recent_notes(spark, sf):
    """The newest notes that fit 28,000 characters."""
    return context.recent_notes(views.notes(spark, sf), 28000, "date").select("note_id", F.col("pick").cast("long").alias("pick"))


#: The stamps of prompt lines in SQL, by style.
SQL_STAMP = {"date": "%-m/%-d/%Y", "datetime": "%a, %b %-d, %Y, %I:%M %p"}


def picked_sql(name: str) -> str:
    """CTEs up to ``picked`` (note_id, note_ts, line, length, cut_to, part): the whole retrieval of a profile, its two folds recursive."""
    p = PROFILES[name]
    line = f"'[' || strftime(note_ts, '{SQL_STAMP[p.timestamp_style]}') || '] ' || content"
    order = "ORDER BY score DESC, note_ts DESC, note_id"
    few = f"chosen AS (SELECT * FROM ranked WHERE rank <= {min(p.selection_limit, p.candidate_limit)})"
    candidates = f"{_candidates_sql(name)},\nchosen AS (SELECT * FROM c WHERE {COVERED})" if p.force_recent else few
    world = WORLD.format(state_budget(p.max_prompt_chars)).removeprefix("WITH ")
    return f"""{scored_sql(name)},
{candidates},
{world},
room AS (SELECT CASE WHEN used = 0 THEN {p.max_prompt_chars} ELSE greatest(0, {p.max_prompt_chars} - used - {COMBINE_OVERHEAD}) END AS b
  FROM (SELECT CAST(coalesce(sum(length(line) + 1) - 1, 0) AS BIGINT) AS used FROM world)),
best AS MATERIALIZED (SELECT note_id, note_ts, content, length(content) AS n_content, {line} AS line, length({line}) AS n_line, row_number() OVER ({order}) AS k FROM chosen WHERE content <> ''),
head AS (SELECT *, n_line > b AS beyond, regexp_replace(substr(content, 1, greatest(120, b - 32)), '\\s+$', '') AS short FROM best, room WHERE k = 1),
fold(k, total, fits, note_id, cost, cut_to) AS (
  SELECT CAST(k AS BIGINT), CAST(CASE WHEN beyond THEN n_line - n_content + length(short) + 2 ELSE n_line + 1 END AS BIGINT), true, note_id,
    CAST(CASE WHEN beyond THEN n_line - n_content + length(short) + 1 ELSE n_line + 1 END AS BIGINT), CAST(CASE WHEN beyond THEN length(short) END AS BIGINT) FROM head
  UNION ALL
  SELECT s.k, CASE WHEN f.total + s.n_line <= b THEN f.total + s.n_line + 1 ELSE f.total END, f.total + s.n_line <= b, s.note_id, s.n_line + 1, NULL
  FROM fold f JOIN best s ON s.k = f.k + 1, room WHERE f.total < b),
taken AS MATERIALIZED (SELECT f.*, note_ts, CASE WHEN cut_to IS NULL THEN line ELSE substr(line, 1, n_line - n_content + cut_to) END AS line FROM fold f JOIN best USING (note_id) WHERE fits),
spare AS MATERIALIZED (SELECT least(CAST(floor(max(b) * {p.short_budget_ratio}::DOUBLE) AS BIGINT), greatest(0, max(b) - coalesce(sum(cost), 0))) - 1 AS room_left FROM room LEFT JOIN taken ON true),
others AS MATERIALIZED (SELECT note_id, note_ts, {line} AS line, length({line}) AS n_line, row_number() OVER ({order}) AS k FROM scored, spare
  WHERE content <> '' AND content_length BETWEEN 1 AND {p.short_max} AND score >= {p.short_min_score}::DOUBLE AND note_id NOT IN (SELECT note_id FROM taken) AND length({line}) <= room_left),
sweep(k, total, fits, note_id) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT s.k, CASE WHEN f.total + s.n_line <= room_left THEN f.total + s.n_line + 1 ELSE f.total END, f.total + s.n_line <= room_left, s.note_id
  FROM sweep f JOIN others s ON s.k = f.k + 1, spare WHERE f.total < room_left),
picked AS (SELECT note_id, note_ts, line, cut_to, 'primary' AS part FROM taken
  UNION ALL SELECT note_id, note_ts, line, NULL, 'sweep' FROM sweep JOIN others USING (note_id) WHERE fits)"""


def _picked_query(name: str, body: str) -> str:
    return with_views(f"WITH RECURSIVE {picked_sql(name)}\n{body}", "notes", "note_embeddings", "current_state")


def _picked(spark, sf, name):
    return context.relevant_notes(views.notes(spark, sf), views.note_embeddings(spark, sf), views.fact_events(spark, sf), _vectors(spark, sf), name, NOW_MS)


def _register_context(name: str) -> None:
    @query(f"retrieve_context_{name}", _picked_query(name, "SELECT note_id, part FROM picked"))
    def retrieve(spark, sf):
        return _picked(spark, sf, name).select("note_id", "part")


for _name in PROFILES:
    _register_context(_name)


@query(
    "retrieve_diagnostics_chat",
    _picked_query(
        "chat",
        """, a AS (SELECT count(*) AS available_notes, CAST(greatest(0, sum(length('[' || strftime(note_ts, '%-m/%-d/%Y') || '] ' || content) + 1) - 1) AS BIGINT) AS full_chars FROM notes),
s AS (SELECT count(*) AS selected_notes, count(*) FILTER (part = 'sweep') AS short_notes, CAST(greatest(0, coalesce(sum(length(line) + 1), 1) - 1) AS BIGINT) AS selected_chars FROM picked)
SELECT *, CASE WHEN full_chars > 0 THEN greatest(0.0::DOUBLE, 1 - selected_chars::DOUBLE / full_chars::DOUBLE) ELSE 0.0::DOUBLE END AS reduction, 'chat' AS profile FROM a, s""",
    ),
)
def diagnostics_chat(spark, sf):
    return context.diagnostics(_picked(spark, sf, "chat"), views.notes(spark, sf), "chat")


def _register_prompt(name: str) -> None:
    @query(f"retrieve_prompt_{name}", _picked_query(name, "SELECT note_id, note_ts, CASE WHEN cut_to IS NULL THEN line ELSE line || '…' END AS line FROM picked"))
    def prompt(spark, sf):
        return context.prompt_lines(_picked(spark, sf, name), name)


for _name in PROFILES:
    _register_prompt(_name)


@query("score_pairs", with_views("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] q FROM embeddings WHERE vec_id % 20 = 0) SELECT query_id, v.note_id, round(greatest(0, list_dot_product(q, v.embedding::DOUBLE[])), 6) AS score FROM q, note_embeddings v", "note_embeddings"))
def score_pairs(spark, sf):
    """Every note against every query, which are the vectors of ids divisible by 20, in blocks of queries."""
    queries = views.table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return scoring.pair_scores(views.note_embeddings(spark, sf).select("note_id", "embedding"), queries).select("query_id", "note_id", F.round("score", 6).alias("score"))


@query("score_norms", with_views("SELECT note_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM (SELECT note_id, embedding::DOUBLE[] AS e FROM note_embeddings)", "note_embeddings"))
def score_norms(spark, sf):
    v = scoring.l2_normalise(F.transform("embedding", lambda x: x * 2))
    back = scoring.dot(v, F.col("embedding"))
    return views.note_embeddings(spark, sf).select("note_id", F.round(back, 6).alias("norm"))


TERMS = ("onthe", "theand", "tion")


@query(
    "score_keyword",
    with_views("SELECT note_id, round((contains(lower(content), 'onthe')::INT + contains(lower(content), 'theand')::INT + contains(lower(content), 'tion')::INT) / 3.0::DOUBLE, 6) AS keyword FROM notes", "notes"),
)
def score_keyword(spark, sf):
    return views.notes(spark, sf).select("note_id", F.round(scoring.keyword_score(F.col("content"), TERMS), 6).alias("keyword"))


@query("score_density", with_views("SELECT note_id, round(CASE WHEN content_length > 0 AND content_length < 150 THEN 0.12 * (1 - content_length / 150.0::DOUBLE) ELSE 0 END, 6) AS bonus FROM notes", "notes"))
def score_density(spark, sf):
    return views.notes(spark, sf).select("note_id", F.round(scoring.density_bonus(F.col("content_length"), PROFILES["chat"]), 6).alias("bonus"))


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "query_terms",
    with_views(f"SELECT DISTINCT id, term FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9-]{{2,}}')) AS term FROM messages WHERE type = 'question') WHERE term NOT IN ({STOP})", "messages"),
)
def query_terms(spark, sf):
    asked = views.messages(spark, sf).filter("type = 'question'")
    return asked.select("id", F.explode(scoring.query_terms(F.col("content"))).alias("term"))
