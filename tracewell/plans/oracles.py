"""DuckDB SQL for the results of the registered queries, on the same tables."""

FX = """
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, day(ts) AS dd,
    'u' || lpad(CAST(user_id AS VARCHAR), 4, '0') || 'd' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS session_id FROM events),
f0 AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'file_write' WHEN 'purchase' THEN 'command' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'user_prompt' END AS fact_type,
    '/repo' || (user_id % 5) || '/src/mod' || (k % 10) || '/file' || k || '.rs' AS path,
    CASE k % 5 WHEN 0 THEN 'cargo build' WHEN 1 THEN 'git commit -m wip && cargo test' WHEN 2 THEN 'RUST_LOG=1 sudo rg todo | head -5' WHEN 3 THEN 'rm -rf target; ls' ELSE 'echo "a && b" | wc' END AS cmd FROM ev),
fx_facts AS (
  SELECT event_id AS id, session_id, ts, nullif(sum(CASE WHEN fact_type = 'user_prompt' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS turn_number, fact_type,
    CASE WHEN fact_type IN ('file_read', 'file_write') THEN path WHEN fact_type IN ('command', 'error') THEN cmd END AS subject,
    CASE WHEN fact_type IN ('file_read', 'file_write') THEN '{"file_path":"' || path || '"' || CASE WHEN fact_type = 'file_write' AND k % 2 = 0 THEN ',"old_string":"x"' ELSE '' END || '}'
      WHEN fact_type = 'command' THEN cmd WHEN fact_type = 'error' THEN 'Process exited with code ' || (k % 4) ELSE 'Please fix item ' || k END AS detail,
    CASE WHEN fact_type IN ('command', 'error') THEN k % 4 END AS exit_code, CASE WHEN fact_type IN ('command', 'error') THEN k % 4 = 0 END AS success, k FROM f0),
s0 AS (
  SELECT session_id, user_id, dd, min(ts) AS started_at, max(ts) AS last_event_at, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_input_tokens, CAST(sum(10 * k) AS BIGINT) AS total_output_tokens,
    CAST(sum(100 * k) AS BIGINT) AS cache_read_tokens, CAST(sum(7 * k) AS BIGINT) AS cache_creation_tokens, CAST(sum(k % 3) AS BIGINT) AS reasoning_tokens, CAST(max(CAST(round(value * 100) AS BIGINT) + 107 * k) AS BIGINT) AS peak_context,
    count(*) - count(*) FILTER (event_type = 'signup') AS total_tools, count(*) FILTER (event_type = 'signup') AS total_turns,
    CASE WHEN dd % 5 <> 0 AND dd > 5 THEN 'u' || lpad(CAST(user_id AS VARCHAR), 4, '0') || 'd' || lpad(CAST(dd - dd % 5 AS VARCHAR), 2, '0') END AS parent_id FROM ev GROUP BY session_id, user_id, dd),
s1 AS (
  SELECT session_id AS id, CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'gemini' END AS engine, CASE user_id % 5 WHEN 0 THEN 'opus-x' WHEN 1 THEN 'haiku-x' WHEN 2 THEN 'gpt-5.4' WHEN 3 THEN 'gpt-5.4-mini' END AS model,
    '/work/team' || (user_id % 4) || '/Proj' || (user_id % 5) AS cwd, started_at, CASE WHEN n % 7 <> 0 THEN last_event_at END AS ended_at, last_event_at, parent_id,
    CASE WHEN parent_id IS NOT NULL THEN 'subagent' WHEN session_id IN (SELECT parent_id FROM s0 WHERE parent_id IS NOT NULL) THEN 'coordinator' ELSE 'standalone' END AS session_type,
    total_input_tokens, total_output_tokens, cache_read_tokens, cache_creation_tokens, reasoning_tokens, peak_context, total_tools, total_turns FROM s0),
fx_sessions AS (
  SELECT *, round(((total_input_tokens / 1000000.0::DOUBLE) * r_in + (total_output_tokens / 1000000.0::DOUBLE) * r_out + (cache_read_tokens / 1000000.0::DOUBLE) * r_cr + (cache_creation_tokens / 1000000.0::DOUBLE) * r_cw + (reasoning_tokens / 1000000.0::DOUBLE) * r_out) * 100.0::DOUBLE) / 100.0::DOUBLE AS cost,
    greatest(CAST(floor(epoch(coalesce(ended_at, TIMESTAMP '2024-01-31'))) AS BIGINT) - CAST(floor(epoch(started_at)) AS BIGINT), 0) AS duration_secs
  FROM s1 JOIN (VALUES ('opus-x', 15.0::DOUBLE, 75.0::DOUBLE, 1.5::DOUBLE, 18.75::DOUBLE), ('haiku-x', 0.25::DOUBLE, 1.25::DOUBLE, 0.025::DOUBLE, 0.3::DOUBLE), ('gpt-5.4', 2.5::DOUBLE, 10.0::DOUBLE, 0.25::DOUBLE, 0.0::DOUBLE), ('gpt-5.4-mini', 0.15::DOUBLE, 0.6::DOUBLE, 0.015::DOUBLE, 0.0::DOUBLE), ('', 3.0::DOUBLE, 15.0::DOUBLE, 0.3::DOUBLE, 3.75::DOUBLE)) r(m, r_in, r_out, r_cr, r_cw) ON r.m = coalesce(model, '')),
fx_tags AS (SELECT DISTINCT session_id, 't' || (k % 6) AS tag FROM ev WHERE k % 4 = 0),
h0 AS (SELECT d.*, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents d LEFT JOIN labels l USING (doc_id)),
fx_handoffs AS (
  SELECT 'doc' || doc_id AS session_id, array_to_string(w[1:8], ' ') AS headline, [source, lang] AS projects, w[9:14] AS keywords, CAST(2 * quality + toxic AS INTEGER) AS substance, n_chars // 50 AS duration_minutes,
    DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS started_on FROM h0),
fx_turns AS (SELECT 'c' || conv_id AS session_id, turn AS ord, CASE role WHEN 'user' THEN 'user_prompt' WHEN 'assistant' THEN 'assistant_reply' ELSE 'info' END AS kind, coalesce(text, '') AS text FROM conversations)
"""
T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
NOT_NOISE = "NOT (total_tools = 0 AND duration_secs < 30)"
WHO = "FROM fx_facts f JOIN (SELECT id AS session_id, engine, cwd, parent_id FROM fx_sessions) s USING (session_id)"


def who(where: str, more: str = "") -> str:
    return FX + f"SELECT f.id, session_id, engine, fact_type, subject, exit_code {WHO} WHERE {where} {more}"


GROUPED = """, g AS (SELECT f.*, engine, parent_id {who} WHERE fact_type = 'file_write' AND subject LIKE '/repo1/src/%'),
 d AS (SELECT session_id, subject, max(ts) AS t, max(id) AS i FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, i DESC) AS n FROM d)
SELECT session_id, engine, parent_id, count(*) AS fact_count, {t} AS latest_ts, (SELECT string_agg(subject, ' | ' ORDER BY n) FROM r WHERE r.session_id = g.session_id AND n <= 5) AS subjects
FROM g GROUP BY session_id, engine, parent_id""".format(who=WHO, t=T.format("max(ts)"))

ERRORS = """, e AS (SELECT session_id, coalesce(subject, detail) AS key, coalesce(exit_code, 0) AS exit_code, fact_type = 'error' AS is_error, ts, id, detail, fact_type FROM fx_facts WHERE fact_type = 'error' OR (fact_type = 'command' AND exit_code <> 0)),
 r AS (SELECT *, row_number() OVER (PARTITION BY session_id, key, exit_code ORDER BY is_error DESC, CASE WHEN is_error THEN -epoch_us(ts) ELSE epoch_us(ts) END, CASE WHEN is_error THEN -id ELSE id END) AS pick,
   first_value(ts) OVER (PARTITION BY session_id, key, exit_code ORDER BY ts, id) AS t0, first_value(id) OVER (PARTITION BY session_id, key, exit_code ORDER BY ts, id) AS i0 FROM e)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t0, i0, key) AS nth, key, exit_code, substr(detail, 1, 280) AS snippet, fact_type AS source FROM r WHERE pick = 1"""

FILES = """, p AS (SELECT session_id, CASE WHEN fact_type = 'file_read' THEN 'read' WHEN detail LIKE '%old_string%' THEN 'edited' ELSE 'written' END AS action, subject AS path, ts, id FROM fx_facts WHERE fact_type IN ('file_read', 'file_write')),
 m AS (SELECT session_id, action, path, min({{'t': ts, 'i': id}}) AS first FROM p GROUP BY ALL), files AS (SELECT session_id, action, row_number() OVER (PARTITION BY session_id, action ORDER BY first) AS nth, path FROM m)
""".replace("{{", "{").replace("}}", "}")

RECALL = """, q AS (SELECT unnest([{terms}]) AS t), x AS (
 SELECT session_id, started_on, substance, duration_minutes, list_distinct(flatten(list_transform(projects, lambda p: regexp_extract_all(lower(coalesce(p, '')), '[a-z0-9]+')))) AS p,
   list_distinct(keywords) AS k, list_filter(list_distinct(regexp_extract_all(lower(headline), '[a-z0-9]+')), lambda w: NOT list_contains(['the','a','an','is','was','are','were','it','its','in','on','at','to','for','of','with','and','or','but','not','this','that','by','from'], w)) AS h FROM fx_handoffs),
 df AS (SELECT t, count(*) FILTER (list_contains(p, t) OR list_contains(k, t) OR list_contains(h, t)) AS df, count(*) AS n FROM q, x GROUP BY t),
 sc AS (SELECT session_id, started_on, substance, duration_minutes, coalesce(sum(CASE WHEN df > 0 THEN greatest(ln(n / df), 0) ELSE 0 END * (3.0 * list_contains(p, t)::INT + 2.0 * list_contains(k, t)::INT + 2.5 * list_contains(h, t)::INT)), 0) AS base FROM x, df GROUP BY ALL),
 b AS (SELECT session_id, started_on, base, greatest(DATE '2024-01-31' - started_on, 1) AS age, 1 + 0.1 * ln(duration_minutes + 1.0) AS longer FROM sc WHERE substance >= 1),
 r AS (SELECT session_id, started_on, base, base * (CASE WHEN age <= 14 THEN 1 + 1 / sqrt(age) ELSE pow(0.5, (age - 14) / 7.0) END) * longer AS s FROM b)
SELECT session_id, CAST(started_on AS VARCHAR) AS started_on, CASE WHEN base > 0 THEN round(s, 6) ELSE 0.0 END AS score FROM r WHERE base > 0 OR (SELECT count(*) FROM r WHERE base > 0) = 0"""

BM25 = """, t AS (SELECT {doc} AS doc, {keep} AS keep, list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) <= 40) AS t FROM {src}),
 st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), h AS (SELECT doc, keep, len(t) AS len, unnest(t) AS term FROM t), tf AS (SELECT doc, keep, len, term, count(*) AS tf FROM h WHERE term IN ({terms}) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term), st WHERE keep GROUP BY doc"""

DEC = "(fact_type IN ('user_prompt', 'assistant_reply', 'git_op') AND regexp_matches(lower(concat_ws(' ', subject, detail)), 'decid|choose|selected|plan|will|next|use |switch|migrate'))"

ORACLES = {
    "ls_filter": FX + f"SELECT id, engine, {T.format('started_at')} AS started_at, duration_secs, cost FROM fx_sessions WHERE engine = 'claude' AND started_at >= TIMESTAMP '2024-01-05' AND started_at <= TIMESTAMP '2024-01-20' AND lower(cwd) LIKE '%proj3%' AND session_type <> 'subagent' AND {NOT_NOISE}",
    "ls_top_tokens": FX + f"SELECT id, total_input_tokens + total_output_tokens AS tokens FROM fx_sessions WHERE {NOT_NOISE} ORDER BY tokens DESC, id LIMIT 25",
    "ls_top_cost": FX + f"SELECT id, cost FROM fx_sessions WHERE {NOT_NOISE} ORDER BY cost DESC, id LIMIT 25",
    "ls_tags_any": FX + f"SELECT id, engine FROM fx_sessions WHERE EXISTS (SELECT 1 FROM fx_tags t WHERE t.session_id = id AND tag = 't2') AND {NOT_NOISE}",
    "ls_tags_all": FX + f"SELECT id, engine FROM fx_sessions WHERE (SELECT count(DISTINCT tag) FROM fx_tags t WHERE t.session_id = id AND tag IN ('t0', 't2')) = 2 AND {NOT_NOISE}",
    "ls_totals": FX + "SELECT CASE WHEN grouping(engine) = 1 THEN 'all' ELSE engine END AS level, engine, count(*) AS sessions, CAST(sum(total_input_tokens) AS BIGINT) AS tokens_in, CAST(sum(total_output_tokens) AS BIGINT) AS tokens_out, round(sum(cost) * 100) / 100 AS cost FROM fx_sessions GROUP BY GROUPING SETS ((engine), ())",
    "ls_headline": FX + ", fp AS (SELECT session_id, detail, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(turn_number, 0), ts, id) AS n FROM fx_facts WHERE fact_type = 'user_prompt') SELECT s.id, CASE WHEN length(detail) > 60 THEN substr(detail, 1, 57) || '...' ELSE detail END AS headline FROM fx_sessions s LEFT JOIN fp ON fp.session_id = s.id AND n = 1",
    "who_read": who("fact_type = 'file_read' AND contains(lower(subject), 'mod3/file')"),
    "who_wrote_folder": who("fact_type = 'file_write' AND subject LIKE '/repo1/src/%'"),
    "who_touched": who("fact_type IN ('file_read', 'file_write', 'command') AND (contains(lower(subject), 'file7') OR contains(lower(detail), 'file7'))"),
    "who_failed": who("fact_type = 'command' AND (exit_code <> 0 OR NOT success)"),
    "who_deleted": who("fact_type IN ('command', 'file_write') AND ((regexp_matches(lower(detail), 'rm |rm -|unlink|remove|del ') AND contains(lower(detail), 'target')) OR (fact_type = 'file_write' AND contains(lower(subject), 'target')))"),
    "who_installed": who("fact_type = 'command' AND f.id % 3 = 0"),
    "who_ran": who("fact_type = 'command' AND k % 5 IN (0, 1)"),
    "who_newest": who("fact_type = 'command'", "ORDER BY f.ts DESC, f.id DESC LIMIT 50"),
    "who_group": FX + GROUPED,
    "inspect_files": FX + FILES + "SELECT * FROM files",
    "inspect_commands": FX + "SELECT session_id, id, detail AS command, coalesce(exit_code, 0) AS exit_code FROM fx_facts WHERE fact_type = 'command'",
    "inspect_errors": FX + ERRORS,
    "inspect_git": FX + "SELECT session_id, id, 'commit' AS operation, detail AS message FROM fx_facts WHERE fact_type = 'command' AND detail LIKE 'git commit%'",
    "inspect_counts": FX + FILES + ", a AS (SELECT session_id, count(*) FILTER (action = 'read') AS files_read, count(*) FILTER (action = 'written') AS files_written, count(*) FILTER (action = 'edited') AS files_edited FROM files GROUP BY 1), c AS (SELECT session_id, count(*) FILTER (fact_type = 'command') AS commands, count(*) FILTER (fact_type = 'command' AND detail LIKE 'git commit%') AS git FROM fx_facts GROUP BY 1), e AS (SELECT session_id, count(DISTINCT coalesce(subject, detail) || '|' || coalesce(exit_code, 0)) AS errors FROM fx_facts WHERE fact_type = 'error' OR (fact_type = 'command' AND exit_code <> 0) GROUP BY 1) SELECT session_id, coalesce(files_read, 0) AS files_read, coalesce(files_written, 0) AS files_written, coalesce(files_edited, 0) AS files_edited, coalesce(commands, 0) AS commands, coalesce(errors, 0) AS errors, coalesce(git, 0) AS git FROM c LEFT JOIN a USING (session_id) LEFT JOIN e USING (session_id) WHERE commands > 0 OR errors > 0 OR files_read IS NOT NULL",
    "token_breakdown": FX + "SELECT id, total_input_tokens, total_output_tokens, cache_read_tokens, cache_creation_tokens, reasoning_tokens, peak_context, cost, CASE WHEN total_turns = 0 THEN 0 ELSE total_input_tokens // total_turns END AS input_per_turn, CASE WHEN total_turns = 0 THEN 0 ELSE total_output_tokens // total_turns END AS output_per_turn FROM fx_sessions",
    "children_rollup": FX + "SELECT parent_id, count(*) AS children, CAST(sum(total_input_tokens + total_output_tokens + cache_read_tokens + cache_creation_tokens) AS BIGINT) AS tokens, max(greatest(CAST(floor(epoch(last_event_at)) AS BIGINT) - CAST(floor(epoch(started_at)) AS BIGINT), 0)) AS longest_secs, CAST(sum(total_tools) AS BIGINT) AS tools FROM fx_sessions WHERE parent_id IS NOT NULL AND total_turns > 0 AND (total_input_tokens + total_output_tokens + cache_read_tokens + cache_creation_tokens > 0 OR total_tools > 0) GROUP BY parent_id",
    "child_activity": FX + ", c AS (SELECT s.parent_id, f.session_id, fact_type, subject, min({'t': f.ts, 'i': f.id}) AS first, count(*) AS n FROM fx_facts f JOIN fx_sessions s ON s.id = f.session_id WHERE s.parent_id IS NOT NULL AND fact_type IN ('file_read', 'file_write', 'command') GROUP BY ALL) SELECT parent_id, session_id, coalesce(string_agg(subject, ',' ORDER BY first) FILTER (fact_type = 'file_read'), '') AS files_read, coalesce(string_agg(subject, ',' ORDER BY first) FILTER (fact_type = 'file_write'), '') AS files_written, CAST(coalesce(sum(n) FILTER (fact_type = 'command'), 0) AS BIGINT) AS commands FROM c GROUP BY ALL",
    "orphans": FX + f"SELECT c.parent_id, count(*) AS children, {T.format('min(c.started_at)')} AS started_at, arg_min(c.cwd, c.started_at) AS cwd, '_recovered' AS tag FROM fx_sessions c WHERE c.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_sessions p WHERE p.id = c.parent_id) GROUP BY c.parent_id",
    "coordinators": FX + "SELECT session_type, count(*) AS n FROM fx_sessions GROUP BY session_type",
    "handoff_candidates": FX + "SELECT id, engine, total_turns FROM fx_sessions WHERE total_turns >= 2 AND started_at >= TIMESTAMP '2024-01-10'",
    "handoff_context": FX + f", g AS (SELECT *, CASE WHEN {DEC} THEN 'decision' WHEN fact_type = 'command' THEN 'command' WHEN fact_type = 'error' THEN 'error' WHEN fact_type IN ('file_read', 'file_write') THEN 'file' END AS grp FROM (SELECT * REPLACE (substr(session_id, 1, 5) AS session_id) FROM fx_facts)), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, grp ORDER BY ts, id) AS nth, count(*) OVER (PARTITION BY session_id, grp) AS n, CASE grp WHEN 'command' THEN 40 WHEN 'error' THEN 20 WHEN 'file' THEN 40 ELSE 20 END AS cap FROM g WHERE grp IS NOT NULL), k AS (SELECT *, n <= cap OR nth <= cap / 4.0 OR nth > n - (cap - cap // 4) AS kept FROM r) SELECT session_id, grp, max(n) AS n, max(n) - count(*) FILTER (kept) AS skipped, coalesce(string_agg(substr(coalesce(detail, subject), 1, 400), chr(10) ORDER BY nth) FILTER (kept), '') AS text FROM k GROUP BY session_id, grp",
    "handoff_validate": FX + "SELECT session_id, CASE WHEN strlen(headline) < 5 THEN 'headline too short' WHEN NOT substance BETWEEN 0 AND 3 THEN 'substance out of range' WHEN substance >= 1 AND len(projects) = 0 THEN 'no projects' WHEN substance >= 1 AND len(keywords) = 0 THEN 'no keywords' END AS reason FROM fx_handoffs",
    "recall_scored": FX + RECALL.format(terms="'src3', 'en', 'ither', 'erea'"),
    "recall_fallback": FX + RECALL.format(terms="'zzzqqq'"),
    "postings": r"WITH t AS (SELECT doc_id AS doc, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: strlen(x) <= 40) AS t FROM documents), h AS (SELECT doc, len(t) AS doc_len, unnest(t) AS term FROM t), p AS (SELECT doc, doc_len, term, count(*) AS tf FROM h GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, min(doc) AS first_doc, CAST(max(doc_len) AS INTEGER) AS longest FROM p GROUP BY term",
    "bm25_top": "WITH z AS (SELECT 1)" + BM25.format(doc="doc_id", keep="true", col="text", src="documents", terms="'license', 'apache', 'password'") + " ORDER BY score DESC, doc LIMIT 100",
    "bm25_fields": FX + BM25.format(doc="id", keep="fact_type = 'command'", col="detail", src="fx_facts", terms="'cargo', 'todo', 'code'"),
    "phrase": FX + ", x AS (SELECT id AS doc FROM fx_facts WHERE detail = 'RUST_LOG=1 sudo rg todo | head -5') SELECT doc, 1::BIGINT AS places FROM x",
    "snippet": "SELECT doc_id, CASE WHEN p = 0 THEN CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END ELSE substr(t, greatest(p - 60, 1), 120) END AS snippet FROM (SELECT doc_id, coalesce(text, '') AS t, strpos(lower(coalesce(text, '')), 'license') AS p FROM documents)",
    "strip_tags": "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' ')) AS text_md5 FROM pages",
    "turn_ordinals": FX + ", u AS (SELECT session_id, ord, kind, nullif(sum(CASE WHEN kind = 'user_prompt' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord, kind, text ROWS UNBOUNDED PRECEDING), 0) AS turn FROM fx_turns) SELECT session_id, CAST(turn AS BIGINT) AS turn, count(*) AS n FROM u GROUP BY session_id, turn",
    "usage_dedup": FX + ", r AS (SELECT session_id, k, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY session_id, k ORDER BY ts, event_id) AS n FROM ev) SELECT session_id, CAST(sum(v) AS BIGINT) AS total_input_tokens, CAST(sum(10 * k) AS BIGINT) AS total_output_tokens, CAST(max(v + 107 * k) AS BIGINT) AS peak_context FROM r WHERE n = 1 GROUP BY session_id",
    "exit_backfill": FX + ", c AS (SELECT event_id, user_id, k, ts FROM ev WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, k, ts FROM ev WHERE event_type = 'error'), l AS (SELECT user_id, k, arg_max(event_id, {'t': ts, 'i': event_id}) AS last FROM e GROUP BY ALL) SELECT c.event_id AS id, CASE WHEN last IS NOT NULL THEN c.k % 4 END AS exit_code, CASE WHEN last IS NOT NULL THEN c.k % 4 = 0 END AS success FROM c LEFT JOIN l USING (user_id, k)",
    "error_facts": FX + ", e AS (SELECT session_id, id, k, exit_code, detail, row_number() OVER (PARTITION BY session_id, k ORDER BY id) AS n FROM fx_facts WHERE fact_type = 'error' AND exit_code <> 0) SELECT session_id, id AS ord, exit_code, detail FROM e WHERE n = 1",
    "git_facts": FX + "SELECT session_id, id, 'git_op' AS fact_type FROM fx_facts WHERE fact_type = 'command' AND regexp_matches(detail, '^\\s*git (commit|push|checkout|rebase|merge|pull|cherry-pick|reset|add)')",
    "session_bounds": FX + f", b AS (SELECT session_id, arg_min(ts, id) AS a, arg_max(ts, id) AS z, count(*) AS events FROM fx_facts GROUP BY session_id) SELECT session_id, {T.format('a')} AS started_at, {T.format('z')} AS last_event_at, events FROM b",
    "last_call_join": FX + ", c AS (SELECT event_id, user_id, k, event_type FROM ev WHERE event_type IN ('purchase', 'error')), l AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS call FROM c) SELECT event_id AS result, call FROM l WHERE event_type = 'error'",
    "resolve_prefix": FX + "SELECT min(id) AS id, count(*) AS n, CASE WHEN count(*) = 1 THEN 'prefix' ELSE 'ambiguous' END AS state FROM fx_sessions WHERE id LIKE 'u0008d%' HAVING count(*) > 0",
    "latest": FX + f"SELECT engine, arg_max(id, {{'t': started_at, 'i': id}}) AS id, {T.format('max(started_at)')} AS started_at FROM fx_sessions GROUP BY engine",
    "tags_list": FX + "SELECT tag, count(*) AS sessions FROM fx_tags GROUP BY tag",
    "status": FX + f"SELECT 'sessions' AS measure, CAST(count(*) AS VARCHAR) AS value FROM fx_sessions UNION ALL SELECT 'first_start', {T.format('min(started_at)')} FROM fx_sessions UNION ALL SELECT 'last_start', {T.format('max(started_at)')} FROM fx_sessions UNION ALL SELECT 'last_event', {T.format('max(last_event_at)')} FROM fx_sessions UNION ALL SELECT 'engine ' || engine, CAST(count(*) AS VARCHAR) FROM fx_sessions GROUP BY engine UNION ALL SELECT 'facts', CAST(count(*) AS VARCHAR) FROM fx_facts UNION ALL SELECT 'handoffs', CAST(count(*) AS VARCHAR) FROM fx_handoffs",
    "actions_window": FX + "SELECT session_id, count(*) AS actions FROM fx_facts WHERE fact_type IN ('file_read', 'file_write', 'command') AND ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY session_id",
    "tokens_per_minute": FX + f", b AS (SELECT session_id, time_bucket(INTERVAL 30 minutes, ts, TIMESTAMP '1970-01-01') AS w, sum(CAST(round(value * 100) AS BIGINT)) AS t FROM ev GROUP BY ALL) SELECT session_id, {T.format('w')} AS window_start, round(t / 30.0 * 10) / 10 AS tokens_per_minute FROM b",
    "latest_action": FX + f", r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS n FROM fx_facts WHERE fact_type IN ('file_read', 'file_write', 'command')) SELECT session_id, CASE fact_type WHEN 'file_read' THEN 'Read' WHEN 'file_write' THEN 'Write' ELSE 'Bash' END AS kind, substr(detail, 1, 120) AS summary, {T.format('ts')} AS ts FROM r WHERE n = 1",
    "activity_sessions": f"WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 hours THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, {T.format('min(ts)')} AS start, count(*) AS events FROM s GROUP BY user_id, n",
    "delta_merge": FX + "SELECT session_id AS id, total_input_tokens, total_turns, total_tools, peak_context FROM s0",
    "upsert_latest": FX + "SELECT id, CASE WHEN session_type = 'subagent' THEN total_turns + 1 ELSE total_turns END AS total_turns FROM fx_sessions",
    "prune": FX + "SELECT fact_type, count(*) AS kept FROM fx_facts WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY fact_type",
    "turn_islands": FX + ", t AS (SELECT session_id, ord, max(CASE WHEN kind = 'assistant_reply' THEN 1 ELSE 0 END) AS is_text FROM fx_turns GROUP BY ALL), i AS (SELECT *, coalesce(sum(is_text) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM t) SELECT session_id, CAST(island AS BIGINT) AS island, count(*) AS turns, min(ord) AS first_ord, max(ord) AS last_ord, max(is_text) = 1 AS has_text FROM i GROUP BY session_id, island",
    "open_threads": FX + ", d AS (SELECT DISTINCT session_id, ord, text FROM fx_turns WHERE kind = 'assistant_reply'), b AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY ord DESC) AS back FROM d), l AS (SELECT session_id, ord, text, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line_no, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM b WHERE back <= 2), m AS (SELECT *, trim(regexp_replace(trim(line), '^[-*#]+', '')) AS thread FROM l WHERE regexp_matches(lower(line), 'todo|fixme|next step|remain|still need')) SELECT session_id, nth, thread FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ord, line_no, thread) AS nth, thread FROM m WHERE thread <> '' AND strlen(thread) < 200) WHERE nth <= 5",
    "format_scalars": FX + """SELECT id, CASE WHEN duration_secs >= 86400 THEN (duration_secs // 86400) || 'd ' || ((duration_secs % 86400) // 3600) || 'h' WHEN duration_secs >= 3600 THEN (duration_secs // 3600) || 'h ' || ((duration_secs % 3600) // 60) || 'm' WHEN duration_secs >= 60 THEN (duration_secs // 60) || 'm ' || (duration_secs % 60) || 's' ELSE duration_secs || 's' END AS duration,
      CASE WHEN total_input_tokens >= 1000000 THEN printf('%.1fM', total_input_tokens / 1000000.0) WHEN total_input_tokens >= 1000 THEN (total_input_tokens // 1000) || 'K' ELSE CAST(total_input_tokens AS VARCHAR) END AS tokens, regexp_extract(cwd, '([^/]+)/*$', 1) AS short_cwd, format('{:,}', cache_read_tokens) AS grouped, regexp_replace(cwd, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM fx_sessions""",
    **{f"logs_to_facts_{x}": FX + "SELECT 'log' || session_id AS session_uid, fact_type, count(*) AS n FROM fx_facts WHERE fact_type <> 'error' GROUP BY ALL UNION ALL SELECT 'log' || session_id, 'git_op', count(*) FROM fx_facts WHERE fact_type = 'command' AND detail LIKE 'git commit%' GROUP BY session_id UNION ALL SELECT 'log' || session_id, 'error', count(*) FROM fx_facts WHERE fact_type = 'command' AND exit_code <> 0 GROUP BY session_id" for x in "abc"},
    "needle_scan": FX + "SELECT session_id AS file, min(id) AS ord FROM fx_facts WHERE fact_type = 'command' AND k = 42 GROUP BY session_id",
    "stream_ingest": FX + f", w AS (SELECT time_bucket(INTERVAL 60 minutes, ts, TIMESTAMP '1970-01-01') AS s, fact_type, count(*) AS n FROM fx_facts GROUP BY ALL) SELECT {T.format('s')} AS start, fact_type, n FROM w WHERE s + INTERVAL 60 minutes <= (SELECT max(ts) - INTERVAL 10 seconds FROM events)",
}

ERROR_KEYS = """, f AS (SELECT *, CASE k % 4 WHEN 0 THEN subject WHEN 3 THEN detail ELSE 'make x' || (k % 6) END AS key, CASE WHEN k % 4 = 2 THEN 1 ELSE exit_code END AS code,
   CASE WHEN k % 4 IN (1, 2) THEN 'Command: /bin/bash -lc ' || chr(39) || 'make x' || (k % 6) || chr(39) || chr(10) || 'failed' ELSE detail END AS said FROM fx_facts WHERE fact_type = 'error'),
 m AS (SELECT session_id, key, code, min({'t': ts, 'i': id}) AS first, arg_max(said, {'t': ts, 'i': id}) AS snippet FROM f GROUP BY ALL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first, key) AS nth, key, code AS exit_code, snippet FROM m"""

AGENTS_A = """, y AS (SELECT *, last_value(CASE WHEN fact_type = 'command' THEN 't' || (k % 3) END IGNORE NULLS) OVER (PARTITION BY session_id, subject ORDER BY id ROWS UNBOUNDED PRECEDING) AS agent_type FROM fx_facts WHERE fact_type IN ('command', 'error')),
 z AS (SELECT *, row_number() OVER (PARTITION BY session_id, k % 7 ORDER BY id DESC) AS n FROM y WHERE fact_type = 'error')
SELECT session_id, 'ag' || (k % 7) AS agent_id, subject AS prompt, 'completed' AS status, k::BIGINT AS tokens, id AS millis, 0::BIGINT AS tools, subject AS description, agent_type FROM z WHERE n = 1"""

AGENTS_B = """, l AS (SELECT *, lag(fact_type) OVER w AS pt, lag(k) OVER w AS pk, lag(subject) OVER w AS ps FROM fx_facts WHERE fact_type <> 'user_prompt' WINDOW w AS (PARTITION BY session_id, fact_type IN ('command', 'error'), k % 5 ORDER BY id)),
 sp AS (SELECT session_id, 'ag' || (k % 7) AS agent_id, min(id) AS f, max(id) AS l, arg_max(ps, id) AS prompt, arg_max('t' || (pk % 3), id) AS agent_type FROM l WHERE fact_type = 'error' AND pt = 'command' GROUP BY ALL),
 cl AS (SELECT session_id, 'ag' || (pk % 7) AS agent_id, id, CASE WHEN k % 2 = 0 THEN 'done' ELSE 'errored' END AS state FROM l WHERE fact_type = 'file_read' AND pt = 'file_write'),
 j AS (SELECT session_id, agent_id, f, prompt, agent_type, arg_max(state, cl.id) FILTER (cl.id > sp.l) AS state FROM sp LEFT JOIN cl USING (session_id, agent_id) GROUP BY session_id, agent_id, f, prompt, agent_type)
SELECT session_id, agent_id, row_number() OVER (PARTITION BY session_id ORDER BY f) AS nth, prompt, coalesce(state, 'unknown') AS status, prompt AS description, agent_type FROM j"""

INGEST = """, r AS (SELECT *, CAST(substr(session_id, 2, 4) AS INTEGER) AS u FROM fx_facts WHERE fact_type <> 'error'), e AS (SELECT *, CASE u % 3 WHEN 0 THEN 'claude' ELSE 'codex' END AS engine FROM r WHERE u % 3 < 2)
SELECT engine, engine || '-' || (u % 10) AS session_uid, '/w' || arg_min(k, id) AS cwd, CASE WHEN engine = 'claude' THEN 'm' || arg_min(k, id) END AS model, count(*) FILTER (fact_type = 'user_prompt') AS total_turns, count(*) FILTER (fact_type <> 'user_prompt') AS total_tools,
  count(*) + count(*) FILTER (fact_type = 'command' AND k % 5 = 1) AS facts, count(*) FILTER (fact_type = 'user_prompt') AS last_turn FROM e GROUP BY engine, u % 10 HAVING count(*) FILTER (fact_type = 'user_prompt') > 0"""

TOOLS = """, t AS (SELECT session_id, id, k % 7 AS n, '/p/' || k AS p FROM fx_facts WHERE fact_type <> 'user_prompt')
SELECT session_id, id, CASE WHEN n < 2 THEN 'file_read' WHEN n = 4 THEN 'task_spawn' WHEN n = 6 THEN 'file_write' ELSE 'command' END AS fact_type, CASE n WHEN 3 THEN '{"x":1}' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 'first' ELSE p END AS subject,
  CASE n WHEN 0 THEN '{"dir":"' || p || '"}' WHEN 1 THEN '{"cwd":"' || p || '","pattern":"x"}' WHEN 2 THEN p WHEN 3 THEN '{"x":1}' WHEN 4 THEN '{"description":"' || p || '"}' WHEN 5 THEN '{"url":"' || p || '"}' ELSE '{"file_path":"first","path":"' || p || '"}' END AS detail, NULL::INTEGER AS exit_code FROM t"""

REPORT = """, f AS (SELECT engine, total_tools + CASE WHEN total_tools % 5 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN total_turns = 0 THEN total_tools END AS old, engine = 'codex' AND total_tools % 7 = 0 AS bad, last_event_at FROM fx_sessions)
SELECT engine, count(*) FILTER (NOT bad AND size IS DISTINCT FROM old) AS indexed, count(*) FILTER (NOT bad AND size IS NOT DISTINCT FROM old) AS skipped, count(*) FILTER (bad) AS errors, CASE WHEN bool_or(bad) THEN '2024-01-02 00:00:00' ELSE {t} END AS seen_to FROM f GROUP BY engine""".format(t=T.format("greatest(max(last_event_at), TIMESTAMP '2024-01-02')"))

SEARCHED = "fx_facts LEFT JOIN (SELECT id AS session_id, engine, cwd, session_type, parent_id FROM fx_sessions) q USING (session_id)"
FILTERED = ", b AS (" + FX + BM25.format(doc="id", keep="(fact_type = 'command' AND engine = 'codex' AND contains(cwd, 'Proj1') AND ts >= TIMESTAMP '2024-01-10')", col="detail", src=SEARCHED, terms="'cargo', 'todo', 'code'") + f") SELECT id, session_id, score, session_type, parent_id FROM b JOIN (SELECT * FROM {SEARCHED}) x ON doc = id"
BRIEF = "'work of ' || id || ' (' || CAST(CAST(started_at AS DATE) AS VARCHAR) || ')' || chr(10) || 'projects: ' || cwd || chr(10) || 'keywords: ' || engine"

ORACLES |= {
    "tool_facts": FX + TOOLS,
    "ingest_files": FX + INGEST,
    "detect_engines": FX + "SELECT DISTINCT CASE k % 4 WHEN 0 THEN '/x/' WHEN 1 THEN '/h/.codex/sessions/' WHEN 2 THEN '/h/.gemini/tmp/' ELSE '/h/.claude/projects/' END || k AS file, CASE WHEN k % 8 = 7 THEN 'gemini' WHEN k % 5 IN (1, 4) THEN 'claude' WHEN k % 5 = 2 OR k % 4 = 1 THEN 'codex' WHEN k % 4 = 2 THEN 'gemini' WHEN k % 4 = 3 THEN 'claude' END AS engine FROM ev WHERE k < 80",
    "agents_a": FX + AGENTS_A,
    "agents_b": FX + AGENTS_B,
    "child_progress": FX + "SELECT session_id, 'ag' || (k % 7) AS agent_id, count(*) AS records, arg_max(k, id) FILTER (k % 2 = 0)::BIGINT AS tokens, max(id) FILTER (k % 2 = 1) AS millis, NULL::BIGINT AS tools FROM fx_facts WHERE fact_type = 'file_read' GROUP BY session_id, k % 7",
    "search_filtered": FX + FILTERED,
    "recall_full": FX + ", s AS (SELECT session_id, list_sort(list(DISTINCT subject) FILTER (fact_type IN ('file_read', 'file_write'))) AS f, list_sort(list(DISTINCT detail) FILTER (fact_type = 'error')) AS e FROM fx_facts GROUP BY 1) SELECT id AS session_id, coalesce(len(f), 0) AS n_files, md5(coalesce(array_to_string(f, ','), '')) AS files_md5, coalesce(array_to_string(e, ','), '') AS errors FROM fx_sessions LEFT JOIN s ON id = session_id WHERE total_turns > 0",
    "session_dates": FX + "SELECT event_id, CASE WHEN k % 4 < 3 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM ev",
    "parse_lists": FX + """SELECT event_id, CASE k % 9 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' WHEN 2 THEN 'plain, text' WHEN 6 THEN '{"a":1}' WHEN 7 THEN '"x"' WHEN 8 THEN '[broken' ELSE '' END AS items FROM ev""",
    "clean_subjects": FX + "SELECT event_id, CASE k % 4 WHEN 0 THEN 'src/a' || k || '.rs' WHEN 1 THEN 'src/b' || k WHEN 2 THEN 'src/c' || k ELSE '*** Update File:  ' END AS subject FROM ev",
    "error_keys": FX + ERROR_KEYS,
    "cache_fallback": FX + ", d AS (SELECT session_id, sum(100 * k) AS r, sum(7 * k) AS c FROM (SELECT DISTINCT session_id, k FROM ev) GROUP BY 1) SELECT id, CAST(CASE WHEN CAST(substr(id, 2, 4) AS INTEGER) % 2 = 0 THEN r ELSE cache_read_tokens END AS BIGINT) AS cache_read_tokens, CAST(CASE WHEN CAST(substr(id, 2, 4) AS INTEGER) % 2 = 0 THEN c ELSE cache_creation_tokens END AS BIGINT) AS cache_creation_tokens FROM fx_sessions JOIN d ON id = session_id",
    "tag_sessions": FX + "SELECT id, CASE session_type WHEN 'subagent' THEN '[sub]' WHEN 'coordinator' THEN '[coord]' ELSE '-' END AS badge FROM fx_sessions JOIN fx_tags ON id = session_id WHERE tag = 't4'",
    "sessions_of_day": FX + f"SELECT id, {T.format('started_at')} AS started_at FROM fx_sessions WHERE CAST(started_at AS DATE) = DATE '2024-01-11'",
    "artefacts": FX + "SELECT id, kind, '/r/data/' || engine || '/' || kind || strftime(started_at, '/%Y/%m/%d/') || id || '.md' AS path, engine = 'claude' AND kind = 'sessions' AS there FROM fx_sessions, (VALUES ('sessions'), ('handoffs')) v(kind)",
    "discovered": FX + "SELECT engine, id, CASE WHEN total_turns > 0 THEN strftime(started_at, '%Y-%m-%dT%H:%M:%S') END AS started_at FROM fx_sessions WHERE total_turns = 0 OR started_at >= TIMESTAMP '2024-01-12'",
    "ingest_report": FX + REPORT,
    "stream_rollup": FX + "SELECT session_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS input, CAST(sum(10 * k) AS BIGINT) AS output, max(CAST(round(value * 100) AS BIGINT) + 100 * k) AS peak_context FROM ev GROUP BY 1",
}

FIRST_PROMPTS = ", fp AS (SELECT session_id, detail, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(turn_number, 0), ts, id) AS n FROM fx_facts WHERE fact_type = 'user_prompt')"
ORACLES |= {
    "recall_by_id": FX + f"(SELECT id AS session_id, {BRIEF} AS text FROM fx_sessions WHERE total_turns > 0 ORDER BY started_at DESC, id LIMIT 1) UNION ALL (SELECT id, {BRIEF} FROM fx_sessions WHERE total_turns > 0 AND id = 'u0008d05')",
    "inspect_tasks": FX + FIRST_PROMPTS + " SELECT id, CASE WHEN total_turns > 0 AND id LIKE '%0' THEN 'work of ' || id WHEN session_type = 'subagent' AND total_tools % 2 = 0 THEN 'child ' || id ELSE detail END AS task FROM fx_sessions LEFT JOIN fp ON id = session_id AND n = 1",
}

TAIL = """, t AS (SELECT *, k % 9 <> 4 AND fact_type <> 'user_prompt' AS used, k % 9 <> 4 AND fact_type = 'user_prompt' AS prompted, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM fx_facts)
SELECT engine, session_id, CASE WHEN bool_or(CASE engine WHEN 'claude' THEN used ELSE prompted END) THEN session_id END AS session_uid, strftime(arg_max(ts, id) FILTER (used), '%Y-%m-%dT%H:%M:%S') AS last_event, count(*) FILTER (used AND 3 * k + id % 5 > 0) AS samples,
 CAST(coalesce(sum(3 * k + id % 5) FILTER (used), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(3 * k) FILTER (used), 0) AS BIGINT) AS input_tokens FROM t, (VALUES ('claude'), ('codex')) v(engine) WHERE back <= 10 GROUP BY engine, session_id"""
DETAILS = """, h AS (SELECT DISTINCT CASE WHEN CAST(substr(session_id, 2, 4) AS INTEGER) % 7 = 0 THEN '/p/none-' || session_id || '.jsonl' WHEN CAST(substr(session_id, 2, 4) AS INTEGER) % 3 = 1 THEN '/c/rollout-2024-01-01-' || session_id || '.jsonl' ELSE '/p/' || session_id || '-more.jsonl' END AS file,
  CASE WHEN CAST(substr(session_id, 2, 4) AS INTEGER) % 7 = 0 THEN 'none-' || substr(session_id, 1, 3) ELSE session_id END AS id FROM fx_facts WHERE fact_type = 'command' AND k = 42)
SELECT file, h.id, model, cwd, session_type, {e} AS last_event_at, total_turns AS turns, total_input_tokens, total_output_tokens, '/r/data/' || engine || strftime(started_at, '/sessions/%Y/%m/%d/') || s.id || '.md' AS transcript, engine = 'claude' AS transcript_there, total_turns > 0 AS handoff_there, CASE WHEN total_turns > 0 THEN {e} END AS handoff_at
FROM h LEFT JOIN fx_sessions s ON s.id = h.id""".format(e=T.format("last_event_at"))
PLACES = """ SELECT id AS session_id, CASE n % 4 WHEN 0 THEN ' /docs/' || id || '.md' WHEN 1 THEN '~/h/' || id || '.md' WHEN 2 THEN '' END AS content_path,
 CASE WHEN n % 4 = 0 AND n % 3 = 0 THEN '/docs/' || id || '.md' WHEN n % 4 = 1 AND n % 5 <> 0 THEN '/home/u/h/' || id || '.md' WHEN total_turns > 0 AND n % 5 = 0 THEN '/r/one' || d || id || '.md' WHEN total_turns > 0 AND engine = 'claude' THEN '/r/two' || d || id || '.md' END AS path
 FROM (SELECT *, total_tools AS n, strftime(started_at, '/%Y/%m/%d/') AS d FROM fx_sessions)"""
ORACLES |= {
    "runtime_tail": FX + TAIL,
    "child_models": FX + "SELECT c.session_id, 'agent_no_' || (c.k % 7) AS agent_id, 'agent_no' AS short_id, arg_max(CASE WHEN c.k % 2 = 0 THEN 'm' || (c.id % 3) ELSE 'sonnet' END, c.id) AS model FROM fx_facts c WHERE c.fact_type = 'command' AND EXISTS (SELECT 1 FROM fx_facts r WHERE r.session_id = c.session_id AND r.k = c.k AND r.fact_type = 'error') GROUP BY c.session_id, c.k % 7",
    "needle_details": FX + DETAILS,
    "document_paths": FX + PLACES,
}


from . import evidence_sql, stores_sql  # noqa: E402, F401  add their SQL
