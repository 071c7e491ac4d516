"""DuckDB SQL for the results of the queries in :mod:`.evidence`."""

from .oracles import FX, ORACLES, T

ORACLES |= {
    "format_more": FX
    + """SELECT id, CASE WHEN length(cwd) <= 16 THEN cwd ELSE '.../' || split_part(cwd, '/', 3) || '/' || split_part(cwd, '/', 4) END AS path, split_part(cwd, '/', 4) AS short,
 CASE CAST(TIMESTAMP '2024-01-20 16:00:00' AS DATE) - CAST(started_at + INTERVAL 4 HOUR AS DATE) WHEN 0 THEN 'today ' || strftime(started_at + INTERVAL 4 HOUR, '%H:%M') WHEN 1 THEN 'yday ' || strftime(started_at + INTERVAL 4 HOUR, '%H:%M') ELSE strftime(started_at + INTERVAL 4 HOUR, '%b %d %H:%M') END AS time,
 CASE day(started_at) % 6 WHEN 0 THEN 'Opus' WHEN 1 THEN 'GPT-5.3 Codex' WHEN 2 THEN 'Codex' WHEN 3 THEN 'o4-mini' WHEN 4 THEN 'other' ELSE 'unknown' END AS family,
 coalesce(ended_at < TIMESTAMP '2024-01-19 23:00:00', true) AS stale, greatest(CAST(epoch(TIMESTAMP '2024-01-20') AS BIGINT) - CAST(floor(epoch(started_at)) AS BIGINT), 0) AS age, CASE WHEN parent_id IS NULL THEN substr(id, 1, 8) ELSE parent_id || ' → ' || id END AS label FROM fx_sessions""",
    "ls_window": FX + f"SELECT id, 'last 10 days' AS label, (SELECT {T.format('min(started_at)')} FROM fx_sessions) AS \"from\", '2024-01-25 23:59:59' AS \"to\" FROM fx_sessions WHERE started_at >= TIMESTAMP '2024-01-21' AND started_at < TIMESTAMP '2024-01-26' AND NOT (total_tools = 0 AND duration_secs < 30)",
    "ls_envelope": FX + ", c AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM fx_sessions WHERE engine = 'codex') SELECT least(count(*), 7) AS shown, '[' || string_agg('{\"id\":\"' || id || '\"}', ',' ORDER BY id) FILTER (n <= 7) || ']' AS rows, count(*) AS total FROM c",
    "tags_of_sessions": FX + "SELECT session_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM fx_tags WHERE tag <> 't2' GROUP BY session_id",
    "who_filtered": FX + "SELECT f.id, session_id, fact_type, subject FROM fx_facts f JOIN (SELECT id AS session_id, engine, cwd FROM fx_sessions) s USING (session_id) WHERE fact_type = 'file_write' AND ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-28' AND engine = 'codex' AND contains(lower(cwd), 'proj') AND session_id IN (SELECT session_id FROM fx_tags WHERE tag = 't0')",
    "fact_trace": FX + "SELECT session_id, count(*) AS errors, count(*) AS ids, min(id) AS first FROM fx_facts WHERE fact_type = 'error' AND session_id LIKE '%d09' GROUP BY session_id",
    "ingest_plan": FX
    + """, b AS (SELECT session_id, bool_or(fact_type = 'file_read' AND k % 9 = 0) AS called, bool_or(fact_type = 'error' AND exit_code = 0) AS bad FROM fx_facts GROUP BY 1),
 p AS (SELECT id, total_tools + total_turns AS size, total_tools + total_turns - total_tools % 3 + 1 AS off, total_tools % 7 > 0 AS known, peak_context > 12000 OR (total_tools % 5 = 0 AND called) OR (bad AND total_tools % 2 = 0) AS redo FROM fx_sessions JOIN b ON id = session_id)
 SELECT id, size, CASE WHEN NOT known OR redo THEN 'full' WHEN size = off THEN 'skip' WHEN size > off THEN 'tail' ELSE 'full' END AS action FROM p""",
    "handoff_documents": FX
    + """SELECT id, '---' || chr(10) || 'id: ' || id || chr(10) || 'engine: ' || engine || chr(10) || 'date: ' || strftime(started_at, '%Y-%m-%d') || chr(10) || 'duration_minutes: ' || CAST(floor((floor(epoch(coalesce(ended_at, last_event_at))) - floor(epoch(started_at))) / 60) AS BIGINT) || chr(10) || '---' || chr(10) AS head,
 'body of ' || id AS body, coalesce(nullif(total_tools % 3, 0) <> 2, true) AS stale, CAST(2 * total_tools AS INTEGER) AS bytes, CAST(2 * total_tools // 4 AS BIGINT) AS tokens FROM fx_sessions""",
    "handoff_extract": FX + "SELECT session_id, headline, array_to_string(projects, ',') AS projects, array_to_string(keywords, ',') AS keywords, CASE WHEN CAST(substr(session_id, 4) AS INTEGER) % 3 = 2 THEN substance ELSE least(substance + 2, 3) END AS substance FROM fx_handoffs WHERE headline <> '' AND len(keywords) > 0",
    "orphan_parents": FX + f", k AS (SELECT * FROM fx_sessions WHERE id NOT LIKE '%10' AND parent_id NOT IN (SELECT id FROM fx_sessions WHERE id NOT LIKE '%10')) SELECT id, parent_id, {T.format('min(started_at) OVER (PARTITION BY parent_id)')} AS started_at, '/made' AS cwd FROM k",
    "open_threads": FX
    + """, t AS (SELECT DISTINCT session_id, ord, text FROM fx_turns WHERE kind = 'assistant_reply'), b AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY ord DESC) AS back, len(string_split_regex(text, '\\r?\\n')) AS n FROM t),
 l AS (SELECT session_id, ord, n AS line_no, 'TODO: item ' || ord AS thread FROM b WHERE back <= 2 UNION ALL SELECT session_id, ord, n + 1, 'We Still Need it' FROM b WHERE back <= 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ord, line_no, thread) AS INTEGER) AS nth FROM l) SELECT session_id, nth, thread FROM r WHERE nth <= 5""",
    "child_index": FX
    + """, s AS (SELECT * FROM fx_sessions WHERE parent_id IS NULL),
 e AS (SELECT session_id AS parent, k, event_id, ts, event_id % 2 AS half, 'a' || lpad(k::VARCHAR, 7, '0') || lpad((user_id % 3)::VARCHAR, 4, '0') || lpad(event_id::VARCHAR, 5, '0') AS agent FROM ev WHERE event_type = 'purchase' AND session_id IN (SELECT id FROM s)),
 f AS (SELECT *, substr(agent, 1, 8) AS c8, substr(agent, 1, 12) AS c12, CASE k % 4 WHEN 0 THEN substr(agent, 1, 14) WHEN 1 THEN agent ELSE 'agent-' || agent || '-x' END AS file FROM e WHERE k % 4 < 3),
 st AS (SELECT file, min(ts) FILTER (k % 2 = 0) AS started FROM f GROUP BY 1),
 wa AS (SELECT c8, min(parent) AS p FROM f WHERE half = 1 GROUP BY 1), wb AS (SELECT c8, min(parent) AS p FROM f WHERE half = 0 AND c8 NOT IN (SELECT c8 FROM wa) GROUP BY 1), w8 AS (SELECT * FROM wa UNION ALL SELECT * FROM wb),
 xa AS (SELECT c12, min(parent) AS p FROM f JOIN w8 USING (c8) WHERE half = 1 AND parent <> w8.p GROUP BY 1), xb AS (SELECT c12, min(parent) AS p FROM f JOIN w8 USING (c8) WHERE half = 0 AND parent <> w8.p AND c12 NOT IN (SELECT c12 FROM xa) GROUP BY 1), w12 AS (SELECT * FROM xa UNION ALL SELECT * FROM xb),
 n AS (SELECT f.*, CASE WHEN parent = w8.p THEN c8 WHEN parent = w12.p THEN c12 END AS id FROM f JOIN w8 USING (c8) LEFT JOIN w12 USING (c12)),
 g AS (SELECT id, half, any_value(parent) AS parent, any_value(k) AS k, arg_max(file, {'l': length(file), 'f': file}) AS file FROM n WHERE id IS NOT NULL GROUP BY id, half),
 m AS (SELECT id, arg_min(parent, half) AS parent, arg_min(k, half) AS k, arg_min(file, half) AS file FROM g GROUP BY id),
 kids AS (SELECT m.id, m.parent AS parent_id, 'subagent' AS session_type, s.cwd, coalesce(st.started, s.started_at) AS started_at, CASE m.k % 3 WHEN 0 THEN 'helper' WHEN 2 THEN 'scout' END AS tags FROM m JOIN st USING (file) JOIN s ON s.id = m.parent)
 SELECT id, parent_id, session_type, cwd, """
    + T.format("started_at")
    + """ AS started_at, tags FROM kids
 UNION ALL SELECT id, parent_id, CASE WHEN id IN (SELECT parent_id FROM kids) THEN 'coordinator' ELSE session_type END, cwd, """
    + T.format("started_at")
    + """, NULL FROM s""",
}

ORACLES |= {
    "forked_sessions": FX
    + """, s AS (SELECT '0' || substr(id, 2, 4) || 'd' || substr(id, 7, 2) AS id, engine, CASE WHEN id LIKE '%d10' AND engine = 'codex' THEN '0' || substr(id, 2, 4) || 'd05' END AS p, CASE WHEN id LIKE '%d10' AND engine = 'codex' AND total_tools % 2 = 0 THEN 'scout' END AS t FROM fx_sessions WHERE parent_id IS NULL)
 SELECT id, engine, p AS parent_id, CASE WHEN p IS NOT NULL THEN 'subagent' WHEN engine = 'codex' AND id IN (SELECT p FROM s WHERE p IS NOT NULL) THEN 'coordinator' ELSE 'standalone' END AS session_type, t AS subagent_type FROM s""",
}
