"""SQL (DuckDB) for operators 11 to 13, written out from their definitions."""

from __future__ import annotations

from .license_scan import PHRASES, default_templates

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan() -> str:
    words = lambda c: f"regexp_extract_all({_LOW.format(c)}, {_WORD})"
    templates = ",\n  ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(default_templates()))
    phrases = ", ".join(f"({_quoted(p)}, {_quoted(label)})" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
each AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {phrases}) v(phrase, label)),
places AS (SELECT e.id, p.label, e.i FROM each e JOIN phrases p ON e.word = p.p[1] JOIN d ON d.id = e.id WHERE d.ws[e.i + 1:e.i + len(p.p)] = p.p),
base AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY 1),
notices AS (SELECT t, label, {words("notice")} AS ws FROM (VALUES
  {templates}) v(t, label, notice)),
sized AS (SELECT t, label, list_distinct(ws) AS tokens, CAST(8 * 2 ** greatest(0, ceil(log2(len(ws) / 8.0))) AS BIGINT) AS size FROM notices),
needed AS (SELECT t, label, size, len(tokens) AS n, ceil(0.9 * len(tokens) - 1e-9) AS need, unnest(tokens) AS word FROM sized),
hits AS (SELECT e.id, n.t, n.label, n.n, n.need, n.word, unnest([e.i // n.size, e.i // n.size - 1]) AS block FROM each e JOIN needed n ON n.word = e.word),
found AS (SELECT id, label, count(DISTINCT word) / CAST(any_value(n) AS DOUBLE) AS share FROM hits WHERE block >= 0 GROUP BY id, t, label, block HAVING count(DISTINCT word) >= any_value(need)),
labels AS (SELECT id, label, true AS own FROM places UNION ALL SELECT id, label, false FROM found),
listed AS (SELECT id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE own), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM labels GROUP BY 1),
best AS (SELECT id, max(share) AS share FROM found GROUP BY 1)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(base.n_base, 0) AS n_base, base.first_word, base.last_word, coalesce(listed.base_labels, '') AS base_labels,
  coalesce(listed.labels, '') AS labels, CASE WHEN base.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0) END AS score
FROM d LEFT JOIN base USING (id) LEFT JOIN listed USING (id) LEFT JOIN best USING (id)"""


def conversation_repair() -> str:
    insert = lambda way, role: f"{{'c': {way}.c + 2, 'a': {way}.a || 'I', 't': list_append({way}.t, '{role}:')}}"
    drop = lambda way: f"{{'c': {way}.c + 3, 'a': {way}.a || 'D', 't': {way}.t}}"

    def take(way: str, initial: str, role: str) -> str:
        cost = f"CASE WHEN gone THEN 1000000000000 WHEN ini = '{initial}' THEN open ELSE open + 2 END"
        return f"{{'c': {way}.c + {cost}, 'a': {way}.a || CASE WHEN ini = '{initial}' THEN 'K' ELSE 'R' END, 't': list_append({way}.t, CASE WHEN ini = '{initial}' THEN role ELSE '{role}' END || ':' || text)}}"

    kept_system = "{'c': z.c + CASE WHEN gone OR ini <> 's' THEN 1000000000000 ELSE open END, 'a': z.a || 'K', 't': list_append(z.t, role || ':' || text)}"
    start = lambda cost: f"{{'c': {cost}, 'a': '', 't': []::VARCHAR[]}}"
    user = lambda of: f"least({of}u, {insert(of + 'z', 'user')}, {insert(of + 's', 'user')}, {insert(of + 'a', 'user')})"
    return rf"""
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, CAST(n AS BIGINT) AS c FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crcs AS (
  SELECT key, 0 AS i, 4294967295 AS c FROM (SELECT DISTINCT key FROM given)
  UNION ALL SELECT key, i + 1, xor(c >> 8, t[1 + CAST(xor(c, ascii(key[i + 1])) & 255 AS INTEGER)]) FROM crcs, crc_table WHERE i < length(key)),
drawn AS (SELECT given.*, xor(c, 4294967295) % 20 AS draw FROM given JOIN crcs ON crcs.key = given.key AND crcs.i = length(given.key)),
hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
turns AS (SELECT id, turn, role, text, role[1] AS ini, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt h JOIN convs c ON h.conv_id IS NOT DISTINCT FROM c.conv_id),
seen AS (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 AS again, lag(ini) OVER (PARTITION BY id ORDER BY i) AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM turns),
judged AS (SELECT *, bare = '' AS is_blank, bare <> '' AND again AS is_duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS is_truncated FROM seen),
rows AS (SELECT id, i, role, text, ini, is_blank OR is_duplicate AS gone, CAST(is_truncated AS INTEGER) AS open FROM judged),
fold AS (
  SELECT id, CAST(0 AS BIGINT) AS i, {start("CAST(0 AS BIGINT)")} AS z, {start("1000000000000")} AS s, {start("1000000000000")} AS u, {start("1000000000000")} AS a FROM convs
  UNION ALL
  SELECT id, i, {drop("z")}, least({drop("s")}, {kept_system}), least({drop("v")}, {take("z", "u", "user")}, {take("s", "u", "user")}, {take("b", "u", "user")}), least({drop("b")}, {take("v", "a", "assistant")})
  FROM (SELECT *, least(a, {insert("v", "assistant")}) AS b FROM (
    SELECT r.*, f.z, f.s, f.a, {user("f.")} AS v FROM fold f JOIN rows r ON r.id = f.id AND r.i = f.i + 1))),
ended AS (SELECT id, least(z, {insert("v", "assistant")}, a) AS way FROM (SELECT id, z, a, {user('')} AS v FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1)),
counts AS (
  SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank, count(*) FILTER (WHERE is_duplicate) AS duplicate,
    count(*) FILTER (WHERE is_truncated) AS truncated, count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  way.c AS cost, way.a AS audit, sha256(array_to_string(way.t, chr(10))) AS repaired_sha256
FROM convs JOIN ended USING (id) LEFT JOIN counts USING (id)"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    distance = "list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT p.id, p.part, min(CAST({distance} AS BIGINT) * 256 + b.e) AS best FROM cut p JOIN book{k} b ON b.part = p.part GROUP BY 1, 2)")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT part, e, j, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM (
    SELECT p.part, n.best % 256 AS e, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS j FROM cut p JOIN near{k} n ON n.id = p.id AND n.part = p.part) GROUP BY ALL)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(any_value(s.x), any_value(b.x)) AS x FROM book{k} b LEFT JOIN (SELECT part, e, list(v ORDER BY j) AS x FROM sums{k} GROUP BY ALL) s ON s.part = b.part AND s.e = b.e GROUP BY ALL)")
    body = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS id FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
cut AS MATERIALIZED (SELECT id, part, ints[part * len(ints) // {parts} + 1:(part + 1) * len(ints) // {parts}] AS x FROM kept, range({parts}) r(part)),
book0 AS MATERIALIZED (SELECT part, id AS e, x FROM cut WHERE id < {entries}),
{body},
coded AS (SELECT id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY 1),
digest AS (SELECT sha256(string_agg(v, ',' ORDER BY part, e, j)) AS codebooks_sha256 FROM (SELECT part, e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (id), digest"""


SQL = {"op11_license_scan": license_scan(), "op12_conversation_repair": conversation_repair(), "op13_vector_codes": vector_codes()}
