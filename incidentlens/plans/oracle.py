"""The same results in plain SQL over the given tables, written independently of the jobs."""

from __future__ import annotations

_EDGE = r"[^\p{L}\p{Nd}\p{Mn}_]"


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def redact(text: str) -> str:
    out = _replace(text, r'(?i)(authorization\s*[:=]\s*)?bearer\s+[^\s",;)]+', "***")
    out = _replace(out, r'(?i)(password|passwd|pwd|token|secret|api[_-]?key|authorization)\s*[:=]\s*"?[^\s",;)]+"?', "***")
    out = _replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "***")
    out = _replace(out, r"(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])", r"\1***\2")
    return _replace(out, r"(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])", r"\1***\2")


def _whole_word(text: str, pattern: str, by: str) -> str:
    """Twice, because two neighbours share the character between them."""
    framed = f"(^|{_EDGE}){pattern}($|{_EDGE})"
    return _replace(_replace(text, framed, rf"\1{by}\2"), framed, rf"\1{by}\2")


def normalize(text: str) -> str:
    out = redact(text)
    out = _replace(out, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "{uuid}")
    out = _replace(out, r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?", "{ts}")
    out = _whole_word(out, r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "{ip}")
    out = _whole_word(out, "[0-9a-fA-F]{16,}", "{hex}")
    out = _whole_word(out, "[0-9]+", "{n}")
    return _replace(out, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


_SCOPE = "'svc-' || ({0} % 5) AS project_id, CASE WHEN {0} % 2 = 0 THEN 'local' ELSE 'staging' END AS environment"
_FROM, _TO = "TIMESTAMP '2024-01-28 00:00:00'", "TIMESTAMP '2024-01-30 00:00:00'"
_EXC = r"nullif(regexp_extract(regexp_extract(stack_trace, '([\w$.]+(?:Exception|Error))', 1), '([^.]*)$', 1), '')"
_FRAME = r"nullif(regexp_replace(regexp_extract(stack_trace, '\n\s*at ([^\n]+)', 1), ':[0-9]+\)', ')', 'g'), '')"

ENTITIES = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  {_SCOPE.format('user_id')} FROM events),
lg AS (SELECT project_id, environment, ts AS occurred_at, event_id AS arrival_seq, k, user_id, event_type,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' WHEN 'click' THEN 'warn' ELSE 'INFO' END AS level,
  'com.example.' || event_type AS logger, 't-' || event_id AS trace_id,
  event_type || ' order ' || event_id || ' failed for user ' || user_id || ' from 10.0.' || (user_id % 256)
    || '.7 token=abc' || event_id AS message,
  CASE WHEN event_type = 'error' THEN 'java.lang.'
    || CASE k % 3 WHEN 0 THEN 'NullPointer' WHEN 1 THEN 'IllegalState' ELSE 'IllegalArgument' END
    || 'Exception: k=' || k || chr(10) || chr(9) || 'at com.example.S' || (k % 3) || '.run(S.java:' || event_id || ')' END AS stack_trace
  FROM ev),
span AS (SELECT project_id, environment, CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) AS low, CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) AS high FROM ev GROUP BY ALL),
rq AS (SELECT 'req-' || project_id || '-' || environment || '-' || strftime(day, '%Y%m%d') || '-' || hours || 'h' AS request_id, project_id, environment,
  day + to_hours(shift) AS from_ts, day + to_hours(shift + hours) AS to_ts, day(day) % 3 * 15 + 10 AS max_results FROM (
    SELECT project_id, environment, 48 AS hours, 0 AS shift, unnest(generate_series(low, high, INTERVAL 2 DAY)) AS day FROM span
    UNION ALL SELECT project_id, environment, 20, 5, unnest(generate_series(low, high, INTERVAL 6 DAY)) FROM span)),
chg AS (SELECT 'event-' || event_id AS evidence_id, project_id, environment, event_id AS change_seq, ts AS occurred_at,
  CASE event_id % 3 WHEN 0 THEN 'DEPLOYMENT' WHEN 1 THEN 'ROLLBACK' ELSE 'CONFIG_CHANGE' END AS type,
  '{{password=***, version=v' || k || '}}' AS attributes
  FROM ev WHERE event_type = 'signup'),
met AS (SELECT 'metric-' || event_id AS evidence_id, project_id, environment, event_id AS metric_seq, ts AS observed_at, value,
  CASE event_id % 8 WHEN 0 THEN 'db_pool_pending_connections' WHEN 1 THEN 'http_p95_seconds'
    WHEN 2 THEN 'request_latency_ms' ELSE 'cpu_usage_percent' END AS metric
  FROM ev WHERE event_type = 'purchase'),
raw_sql AS (SELECT project_id, environment, 'select * from t_' || (user_id % 3) || ' where id = ?' AS sql_template,
  CAST(round(value * 10) AS BIGINT) AS duration_ms, ts AS occurred_at FROM ev WHERE event_type = 'view'),
prj AS (SELECT project_id, list(DISTINCT environment) AS environments, substr(project_id, 5) AS number FROM ev GROUP BY project_id),
dbs AS (SELECT project_id, CASE number WHEN '1' THEN 'mysql' WHEN '2' THEN 'postgresql' WHEN '4' THEN 'mysql' END AS kind FROM prj),
sess AS (SELECT *, project_id || '/' || environment || '/' || strftime(month - INTERVAL 26 YEAR, '%Y-%m') AS snapshot_id,
    month + INTERVAL 60 SECOND AS captured_at,
    CASE WHEN pid % 7 <> 0 THEN month + to_seconds(pid % 61) END AS xact_start
  FROM (SELECT {_SCOPE.format('o_custkey')}, o_orderkey AS pid, date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 26 YEAR AS month,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'idle' ELSE 'idle in transaction' END AS state,
    o_orderpriority AS priority, o_orderstatus <> 'P' AS granted FROM orders)),
snap AS (SELECT project_id, environment, snapshot_id, captured_at,
  count(*) FILTER (state = 'active') AS active_connections, count(*) FILTER (state = 'idle') AS idle_connections,
  count(*) FILTER (state = 'active' AND priority IN ('1-URGENT', '2-HIGH')) AS waiting_connections,
  count(*) FILTER (captured_at - xact_start > INTERVAL 30 SECOND) AS long_transactions,
  count(*) FILTER (NOT granted) AS lock_waits
  FROM sess GROUP BY ALL),
mysnap AS (SELECT project_id, environment, snapshot_id, captured_at, running AS active_connections, greatest(0, connected - running) AS idle_connections,
  CAST(0 AS BIGINT) AS waiting_connections, CAST(0 AS BIGINT) AS long_transactions, CAST(0 AS BIGINT) AS lock_waits
  FROM (SELECT project_id, environment, snapshot_id, captured_at, coalesce(max(v) FILTER (n = 1), 0) AS running, coalesce(max(v) FILTER (n = 0), 0) AS connected
  FROM (SELECT project_id, environment, project_id || '/' || environment || '/' || strftime(ts, '%Y-%m-%d') AS snapshot_id,
    date_trunc('day', ts)::TIMESTAMP AS captured_at, event_id % 4 AS n, CAST(k AS BIGINT) AS v FROM ev WHERE k % 10 <> 3)
  GROUP BY project_id, environment, snapshot_id, captured_at)),
own_snap AS (SELECT * FROM snap WHERE project_id = 'svc-2' UNION ALL SELECT * FROM mysnap WHERE project_id IN ('svc-1', 'svc-4')),
health AS (SELECT r.request_id, s.snapshot_id, r.to_ts,
    coalesce(s.project_id <> 'svc-1', false) AS available,
    CASE WHEN coalesce(s.project_id <> 'svc-1', false) THEN NULL WHEN d.kind = 'mysql' THEN 'MySQL unavailable'
      ELSE 'PostgreSQL unavailable' END AS unavailable_reason,
    CASE WHEN s.project_id <> 'svc-1' THEN active_connections ELSE 0 END AS active_connections,
    CASE WHEN s.project_id <> 'svc-1' THEN idle_connections ELSE 0 END AS idle_connections,
    CASE WHEN s.project_id <> 'svc-1' THEN waiting_connections ELSE 0 END AS waiting_connections,
    CASE WHEN s.project_id <> 'svc-1' THEN long_transactions ELSE 0 END AS long_transactions,
    CASE WHEN s.project_id <> 'svc-1' THEN lock_waits ELSE 0 END AS lock_waits
  FROM rq r JOIN dbs d ON d.project_id = r.project_id AND d.kind IS NOT NULL
  LEFT JOIN own_snap s ON s.project_id = r.project_id AND s.environment = r.environment AND s.captured_at <= r.to_ts
  QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY s.captured_at DESC NULLS LAST) = 1),
rl AS (SELECT r.request_id, r.from_ts, r.to_ts, r.max_results, l.* FROM lg l JOIN rq r ON l.project_id = r.project_id
  AND l.environment = r.environment AND l.occurred_at BETWEEN r.from_ts AND r.to_ts),
kl AS (SELECT * FROM rl WHERE upper(level) IN ('WARN', 'ERROR')),
parts AS (SELECT request_id, project_id, environment, occurred_at, arrival_seq, level, from_ts, to_ts, message, trace_id,
  {_EXC} AS exception_class, {normalize('message')} AS message_template, {_FRAME} AS top_stack_frame FROM kl),
clu0 AS (SELECT request_id, project_id, environment, to_ts - from_ts > INTERVAL 1 DAY AS has_baseline, exception_class, message_template, top_stack_frame,
    project_id || '|' || environment || '|' || coalesce(exception_class, 'null') || '|'
      || coalesce(message_template, 'null') || '|' || coalesce(top_stack_frame, 'null') AS cluster_key,
    count(*) AS count, count(*) FILTER (occurred_at >= to_ts - INTERVAL 1 DAY) AS current_count,
    count(*) FILTER (occurred_at < to_ts - INTERVAL 1 DAY) AS baseline_count,
    min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, min(arrival_seq) AS first_seq,
    arg_min(level, arrival_seq) AS level, arg_min(message, arrival_seq) AS first_message, arg_min(trace_id, arrival_seq) AS sample_trace
  FROM parts GROUP BY ALL),
clu AS (SELECT *, 'log-' || cluster_seq AS evidence_id FROM (SELECT *,
  row_number() OVER (PARTITION BY request_id ORDER BY first_seq) AS cluster_seq,
  current_count >= 5 AND (NOT has_baseline OR current_count >= baseline_count * 1.2::DOUBLE) AS spike FROM clu0)),
rc AS (SELECT r.request_id, c.* FROM chg c JOIN rq r ON c.project_id = r.project_id AND c.environment = r.environment
  AND c.occurred_at BETWEEN r.from_ts AND r.to_ts),
rm AS (SELECT r.request_id, m.*, metric || ' rose for *** ***' AS description FROM met m JOIN rq r ON m.project_id = r.project_id
  AND m.environment = r.environment AND m.observed_at BETWEEN r.from_ts AND r.to_ts),
rs AS (SELECT request_id, project_id, environment, sql_template, count(*) AS occurrences,
    (2 * sum(duration_ms)::BIGINT + count(*)) // (2 * count(*)) AS avg_duration_ms, max(duration_ms) AS max_duration_ms,
    min(occurred_at) AS first_seen, 'sql-' || substr(md5(sql_template), 1, 12) AS evidence_id
  FROM (SELECT r.request_id, q.* FROM raw_sql q JOIN rq r ON q.project_id = r.project_id AND q.environment = r.environment
    AND q.occurred_at BETWEEN r.from_ts AND r.to_ts) GROUP BY ALL),
dep AS (SELECT request_id, 1 AS position, 'deployment-regression' AS label, '发布后引入异常' AS title, 'STRONG' AS strength,
    d AS id_1, c AS id_2 FROM (SELECT rc.request_id, rc.evidence_id AS d, clu.evidence_id AS c,
    row_number() OVER (PARTITION BY rc.request_id ORDER BY change_seq, count DESC, cluster_seq) AS n
  FROM rc JOIN clu ON rc.request_id = clu.request_id AND spike AND type IN ('DEPLOYMENT', 'ROLLBACK')
    AND last_seen BETWEEN occurred_at - INTERVAL 6 HOUR AND occurred_at + INTERVAL 48 HOUR) WHERE n = 1),
near AS (SELECT rs.request_id, rs.evidence_id AS s, rm.evidence_id AS m, avg_duration_ms, metric_seq,
    metric LIKE '%pool%' OR metric LIKE '%connection%' AS pool, metric LIKE '%p95%' OR metric LIKE '%latency%' AS latency
  FROM rs JOIN rm ON rs.request_id = rm.request_id
    AND observed_at BETWEEN first_seen - INTERVAL 6 HOUR AND first_seen + INTERVAL 6 HOUR),
pool AS (SELECT request_id, 2 AS position, 'slow-sql-pool-contention' AS label, '慢 SQL 导致连接池等待' AS title, 'STRONG' AS strength,
    s AS id_1, m AS id_2 FROM near WHERE pool
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY avg_duration_ms DESC, s, metric_seq) = 1),
lat AS (SELECT request_id, 2 AS position, 'slow-sql-latency-correlation' AS label, '慢 SQL 与接口延迟时间相关' AS title, 'MODERATE' AS strength,
    s AS id_1, m AS id_2 FROM near WHERE latency AND request_id NOT IN (SELECT request_id FROM pool)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY avg_duration_ms DESC, s, metric_seq) = 1),
cand AS (SELECT * FROM dep UNION ALL SELECT * FROM pool UNION ALL SELECT * FROM lat),
evid AS (
  SELECT request_id, evidence_id, 1 AS type_ord, 'LOG_CLUSTER' AS type,
    CASE WHEN spike THEN '突增 ' ELSE '' END || coalesce(exception_class, message_template, 'null') || ' ×' || count AS description,
    row_number() OVER (PARTITION BY request_id ORDER BY spike DESC, count DESC, cluster_seq) AS rank_no FROM clu
  UNION ALL SELECT request_id, evidence_id, 2, 'METRIC', description,
    row_number() OVER (PARTITION BY request_id ORDER BY metric_seq) FROM rm
  UNION ALL SELECT request_id, evidence_id, 3, 'SLOW_SQL',
    'avg=' || avg_duration_ms || 'ms ×' || occurrences || ': ' || sql_template,
    row_number() OVER (PARTITION BY request_id ORDER BY avg_duration_ms DESC, evidence_id) FROM rs
  UNION ALL SELECT request_id, evidence_id, 4, 'CHANGE_EVENT', type || ' ' || attributes,
    row_number() OVER (PARTITION BY request_id ORDER BY change_seq) FROM rc
  UNION ALL SELECT request_id, 'dbhealth-1', 5, 'DB_HEALTH',
    '连接 active=' || active_connections || ' idle=' || idle_connections || ' waiting=' || waiting_connections
      || '; 长事务 ' || long_transactions || '; 锁等待 ' || lock_waits, 1 FROM health WHERE available),
kept AS (SELECT * FROM evid WHERE rank_no <= CASE type_ord WHEN 1 THEN 20 WHEN 2 THEN 20 WHEN 3 THEN 15 WHEN 4 THEN 20 ELSE 1 END),
tight AS (SELECT * FROM evid WHERE rank_no <= CASE type_ord WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 1 END),
tl AS (
  SELECT request_id, occurred_at AS at, 'CHANGE' AS category, type AS description, evidence_id, 1 AS o, 0 AS w, change_seq AS s FROM rc
  UNION ALL SELECT request_id, first_seen, 'LOG', CASE WHEN spike THEN '异常突增: ' ELSE '异常: ' END
    || coalesce(exception_class, message_template, level) || ' ×' || count, evidence_id, 2, -count, cluster_seq FROM clu
  UNION ALL SELECT request_id, observed_at, 'METRIC', description, evidence_id, 3, 0, metric_seq FROM rm
  UNION ALL SELECT request_id, first_seen, 'SLOW_SQL', '慢 SQL avg=' || avg_duration_ms || 'ms: ' || sql_template, evidence_id, 4, 0, 0 FROM rs
  UNION ALL SELECT h.request_id, h.to_ts, 'DB_HEALTH', e.description, e.evidence_id, 5, 0, 0
    FROM health h JOIN evid e ON e.request_id = h.request_id AND e.type_ord = 5),
ktl AS (SELECT tl.*, row_number() OVER (PARTITION BY request_id ORDER BY "at" NULLS LAST, o, w, s, evidence_id) AS position
  FROM tl WHERE EXISTS (SELECT 1 FROM kept k WHERE k.request_id = tl.request_id AND k.evidence_id = tl.evidence_id)),
kcand AS (SELECT c.* FROM cand c WHERE EXISTS (SELECT 1 FROM kept k WHERE k.request_id = c.request_id AND k.evidence_id = id_1)
  AND EXISTS (SELECT 1 FROM kept k WHERE k.request_id = c.request_id AND k.evidence_id = id_2)),
una AS (SELECT r.request_id, string_agg(label, ';' ORDER BY label) AS unavailable FROM rq r JOIN (
  SELECT DISTINCT project_id, environment, CASE event_type WHEN 'error' THEN 'log' WHEN 'purchase' THEN 'metric' WHEN 'view' THEN 'slow-sql'
    WHEN 'signup' THEN 'change-event' ELSE 'db-health' END || ':Source' || (k % 6) || ' ('
    || CASE k % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' ELSE 'rejected' END || ')' AS label
  FROM ev WHERE k % 6 < 3) s ON s.project_id = r.project_id AND s.environment = r.environment GROUP BY r.request_id),
digest AS (SELECT project_id, environment, CASE WHEN event_type <> 'signup' THEN 'SELECT ' || event_type || ' FROM t WHERE k = ' || (k % 20) END AS sql_template,
  count(*) AS occurrences, CAST((sum(CAST(round(value * 100) AS BIGINT))::BIGINT * 100000000) // count(*) AS DOUBLE) / 1e9 AS avg_ms,
  CAST(max(CAST(round(value * 100) AS BIGINT)) * 100000000 AS DOUBLE) / 1e9 AS max_ms
  FROM ev GROUP BY project_id, environment, event_type, k % 20),
ranked AS (SELECT r.request_id, d.project_id, 'dbsql-' || n AS evidence_id, n, sql_template, occurrences, r.max_results,
    CAST(floor(avg_ms + 0.5) AS BIGINT) AS avg_duration_ms, CAST(floor(max_ms + 0.5) AS BIGINT) AS max_duration_ms, r.from_ts AS first_seen
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, environment ORDER BY avg_ms DESC, sql_template) AS n
    FROM digest WHERE sql_template IS NOT NULL) d JOIN rq r ON r.project_id = d.project_id AND r.environment = d.environment),
sub AS (SELECT event_id AS received_seq, CASE WHEN k % 13 = 0 THEN 'svc-unknown' ELSE project_id END AS project_id,
  CASE WHEN k % 13 = 1 THEN 'moon' ELSE environment END AS environment,
  CASE WHEN k % 13 = 2 THEN '  ' ELSE 'DEPLOYMENT' END AS type, CASE WHEN k % 13 <> 3 THEN ts END AS occurred_at, k % 13 AS m, k,
  CASE WHEN k % 13 IN (4, 5) THEN '{{}}' ELSE '{{api_key=***, note=by ***, version=v' || k || '}}' END AS attributes
  FROM ev WHERE event_type = 'signup'),
subv AS (SELECT s.*, CASE WHEN trim(type) = '' THEN 'blank-type' WHEN occurred_at IS NULL THEN 'missing-time'
    WHEN p.project_id IS NULL THEN 'unknown-project' WHEN NOT list_contains(p.environments, s.environment) THEN 'unknown-environment'
    WHEN m = 4 THEN 'null-attribute' END AS reject_reason
  FROM sub s LEFT JOIN prj p ON p.project_id = s.project_id),
ask AS (SELECT 'ask-' || conv_id || '-' || turn || '-' || role AS request_id, conv_id, turn, text,
  CASE conv_id % 11 WHEN 0 THEN 'svc-unknown' WHEN 1 THEN ' ' ELSE 'svc-' || (conv_id % 5) END AS project_id,
  CASE WHEN conv_id % 11 = 2 THEN 'moon' WHEN turn % 2 = 0 THEN 'local' ELSE 'staging' END AS environment,
  (conv_id % 50) * 3600 + turn AS span FROM conversations),
stored AS (SELECT 'diag-' || conv_id AS diagnosis_id, {_SCOPE.format('conv_id')}, turn AS version, conv_id,
  {_FROM} + to_minutes(conv_id) + to_seconds(turn) AS created_at FROM conversations),
stored_json AS (SELECT diagnosis_id, project_id, environment, version, created_at, CASE WHEN conv_id % 7 = 3 THEN '{{"diagnosisId":' ELSE
  '{{"diagnosisId":"' || diagnosis_id || '","projectId":"' || project_id || '","environment":"' || environment || '","summary":"version '
  || version || '","ruleFallback":' || CASE WHEN version % 2 = 0 THEN 'true' ELSE 'false' END || '}}' END AS report_json FROM stored),
latest AS (SELECT * FROM stored_json QUALIFY row_number() OVER (PARTITION BY diagnosis_id ORDER BY version DESC) = 1),
heads AS (SELECT r.request_id, substr(project_id, 5) AS n, r.project_id, r.environment,
  (SELECT count(*) FROM kcand c WHERE c.request_id = r.request_id) AS n_cand FROM rq r)
"""

_LABEL = "CASE {0} % 3 WHEN 0 THEN 'deployment-regression' WHEN 1 THEN 'slow-sql-pool-contention' ELSE 'slow-sql-latency-correlation' END"
SCORED = f"""
, ids AS (SELECT DISTINCT conv_id FROM conversations),
sc_cand AS (SELECT conv_id, {_LABEL.format('(turn + conv_id - 1)')} AS label, 'log-' || turn AS a, 'sql-' || (conv_id % 3) AS b
  FROM conversations WHERE role = 'assistant'),
sc_cited AS (SELECT conv_id, label, a AS id FROM sc_cand UNION ALL SELECT conv_id, label, b FROM sc_cand),
sc_evid AS (SELECT conv_id, 'log-' || (turn + 1) AS id FROM conversations WHERE role = 'user'
  UNION SELECT conv_id, 'sql-' || (conv_id % 4) FROM conversations WHERE role = 'user'),
scored AS (SELECT *, root_cause_hit AND evidence_cited AND no_fabricated_ids AND model_answered AND summary_present AS passed FROM (
  SELECT conv_id AS report_id, hit AS root_cause_hit, hit AND missing_ids = 0 AS evidence_cited, fabricated_ids = 0 AS no_fabricated_ids,
    conv_id % 5 <> 0 AS model_answered, conv_id % 7 <> 0 AS summary_present, missing_ids, fabricated_ids
  FROM (SELECT i.conv_id,
    EXISTS (SELECT 1 FROM sc_cand c WHERE c.conv_id = i.conv_id AND c.label = {_LABEL.format('i.conv_id')}) AS hit,
    (SELECT count(*) FROM (SELECT i.conv_id AS cid, 'log-1' AS id UNION ALL SELECT i.conv_id, 'sql-' || (i.conv_id % 3)) q
      WHERE NOT EXISTS (SELECT 1 FROM sc_cited s WHERE s.conv_id = q.cid AND s.id = q.id AND s.label = {_LABEL.format('q.cid')})) AS missing_ids,
    (SELECT count(DISTINCT s.id) FROM sc_cited s WHERE s.conv_id = i.conv_id
      AND NOT EXISTS (SELECT 1 FROM sc_evid e WHERE e.conv_id = s.conv_id AND e.id = s.id)) AS fabricated_ids
    FROM ids i)))
"""

_LINES = r"""
, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
marked AS (SELECT *, {head} AS head FROM ln),
numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS event_no FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, event_no ORDER BY n) - 1 AS i FROM numbered WHERE event_no > 0),
seen AS (SELECT *, coalesce(sum(CASE WHEN i > 0 THEN length(line) END)
  OVER (PARTITION BY doc_id, event_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS text_before FROM placed),
sized AS (SELECT *, coalesce(sum(CASE WHEN i > 0 THEN length(line) + CASE WHEN text_before > 0 THEN 1 ELSE 0 END END)
  OVER (PARTITION BY doc_id, event_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stack_before FROM seen),
bounded AS (SELECT doc_id, CAST(event_no AS BIGINT) AS event_no, max(CASE WHEN i = 0 THEN line END) AS head, count(*) AS n_lines,
  nullif(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (i BETWEEN 1 AND 100 AND stack_before < 16384), ''), '^\n+', ''), '') AS stack,
  coalesce(bool_or(i > 100 OR (i > 0 AND stack_before >= 16384)), false) AS truncated FROM sized GROUP BY doc_id, event_no),
ended AS (SELECT *, CASE WHEN truncated THEN stack || chr(10) || '…' ELSE stack END AS stack_trace FROM bounded)
"""
_EVERY_HEAD = _LINES.replace("{head}", "regexp_matches(line, '^[A-Z]')")
_FIRST_HEAD = _LINES.replace("{head}", "n = 1")

_STAMP = "strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%g')"
_CANDIDATE_ROWS = "SELECT request_id, label, title, strength, id_1 || ';' || id_2 AS evidence_ids FROM "
_DIGEST = "SELECT request_id, evidence_id, sql_template, occurrences, avg_duration_ms, max_duration_ms, first_seen, '{0}' AS source FROM ranked WHERE n <= max_results"

_ACTIONS = """CASE label WHEN 'deployment-regression' THEN '核对发布版本对应的提交,定位空值处理改动。;人工评估是否回滚到上一个稳定版本。'
  WHEN 'slow-sql-pool-contention' THEN '人工运行 EXPLAIN 评估该 SQL 模板的索引情况。;检查连接池容量与慢查询是否需要分离读负载。'
  ELSE '人工运行 EXPLAIN 评估该 SQL 模板的索引情况。;补充连接池指标或 traceId,进一步验证慢 SQL 与接口延迟的因果关系。' END"""
_EXPLANATIONS = """CASE label WHEN 'deployment-regression' THEN '异常突增的时间窗口紧跟在一次发布之后,提示新版本可能引入了缺陷。'
  WHEN 'slow-sql-pool-contention' THEN '高耗时 SQL 与连接池等待同时出现,慢查询占用连接,导致接口整体变慢。'
  ELSE '高耗时 SQL 与接口延迟在时间上相关,但当前证据不足以确认因果关系。' END"""
_NARRATED = f"""
, told AS (SELECT h.request_id,
  CASE WHEN n_cand = 0 THEN '未发现明确根因。已聚合 ' || (SELECT count(*) FROM kept k WHERE k.request_id = h.request_id AND type_ord = 1)
    || ' 类日志与 ' || (SELECT count(*) FROM ktl t WHERE t.request_id = h.request_id) || ' 条时间线证据,建议人工进一步排查。'
  ELSE '最可能的原因是' || (SELECT arg_min(title, position) FROM kcand c WHERE c.request_id = h.request_id) || '(证据强度 '
    || (SELECT arg_min(strength, position) FROM kcand c WHERE c.request_id = h.request_id) || ')。详见根因候选与时间线。' END AS summary,
  coalesce((SELECT string_agg({_EXPLANATIONS}, ';' ORDER BY position) FROM kcand c WHERE c.request_id = h.request_id), '') AS explanations,
  coalesce((SELECT string_agg({_ACTIONS}, ';' ORDER BY position) FROM kcand c WHERE c.request_id = h.request_id),
    '扩大时间范围或接入更多证据源后重试诊断。') AS actions FROM heads h)
"""
_MODEL_EXPLANATION = """CASE WHEN label = 'deployment-regression' AND n = '1' THEN 'deploy told'
  WHEN label = 'deployment-regression' AND n = '3' THEN 'told later'
  WHEN label = 'slow-sql-pool-contention' AND n IN ('1', '3') THEN 'pool told' END"""
_REPORT = """SELECT h.request_id, h.project_id, h.environment, {summary} AS summary, {fallback} AS rule_fallback,
  coalesce((SELECT string_agg(evidence_id, ';' ORDER BY position) FROM ktl t WHERE t.request_id = h.request_id), '') AS timeline_ids,
  coalesce((SELECT string_agg(label, ';' ORDER BY position) FROM kcand c WHERE c.request_id = h.request_id), '') AS labels,
  {explanations} AS explanations, {actions} AS actions,
  coalesce((SELECT string_agg(evidence_id, ';' ORDER BY type_ord, rank_no) FROM kept k WHERE k.request_id = h.request_id), '') AS evidence_ids,
  {unavailable} AS unavailable, 'AI 生成的排障建议,仅供人工核验。请在执行任何变更前复查证据。' AS disclaimer,
  (SELECT count(*) FROM kept k WHERE k.request_id = h.request_id AND type_ord = 1) AS log_clusters_kept,
  (SELECT count(*) FROM evid k WHERE k.request_id = h.request_id AND type_ord = 2 AND rank_no > 20) AS metrics_truncated,
  (SELECT count(*) FROM evid e WHERE e.request_id = h.request_id) > (SELECT count(*) FROM kept k WHERE k.request_id = h.request_id) AS any_truncated
  FROM heads h """
_UNA = "coalesce((SELECT unavailable FROM una u WHERE u.request_id = h.request_id), '')"


def _budget_columns() -> str:
    columns = []
    for name, ordinal, cap in (("log_clusters", 1, 20), ("slow_sql", 3, 15), ("metrics", 2, 20), ("change_events", 4, 20)):
        rows = f"(SELECT count(*) FROM evid e WHERE e.request_id = r.request_id AND type_ord = {ordinal} AND rank_no"
        columns += [f"{rows} <= {cap}) AS {name}_kept", f"{rows} > {cap}) AS {name}_truncated"]
    return ", ".join(columns)


def _queries() -> dict[str, tuple[str, str]]:
    """Query name to (extra common tables, select)."""
    q: dict[str, tuple[str, str]] = {}

    def add(name: str, select: str, extra: str = "") -> None:
        q[name] = (extra, select)

    add("multiline_log_events", f"""SELECT project_id, environment, date_trunc('milliseconds', occurred_at)::TIMESTAMP AS occurred_at, level, logger,
      message, stack_trace, {_EXC} AS exception_class FROM lg WHERE level IN ('WARN', 'ERROR')""")
    add("multiline_documents", "SELECT doc_id, event_no, head, n_lines, stack_trace FROM ended", _EVERY_HEAD)
    add("stack_bounds", "SELECT doc_id, stack_trace, truncated FROM ended", _FIRST_HEAD)
    add("parse_heads", f"""SELECT arrival_seq, CASE arrival_seq % 3 WHEN 0 THEN {_STAMP} WHEN 1 THEN replace({_STAMP}, ' ', 'T') || '+08:00'
      ELSE replace({_STAMP}, '.', ',') END AS ts, upper(level) AS level,
      CASE arrival_seq % 3 WHEN 0 THEN 'worker-' || (arrival_seq % 4) WHEN 1 THEN 'main' END AS thread, logger, message AS msg
      FROM lg WHERE arrival_seq % 7 <> 0""")
    add("strip_ansi", "SELECT arrival_seq, level || ' ' || message AS line FROM lg")
    add("parse_timestamps", """SELECT arrival_seq, CASE arrival_seq % 6 WHEN 0 THEN ms WHEN 1 THEN ms - INTERVAL 8 HOUR WHEN 2 THEN ms - INTERVAL 8 HOUR
      WHEN 3 THEN ms + INTERVAL 210 MINUTE WHEN 5 THEN date_trunc('second', ms)::TIMESTAMP - INTERVAL 8 HOUR END AS occurred_at
      FROM (SELECT arrival_seq, date_trunc('milliseconds', occurred_at)::TIMESTAMP AS ms FROM lg)""")
    add("zone_shift", "SELECT arrival_seq, occurred_at + INTERVAL 5 HOUR AS utc, occurred_at + INTERVAL 8 HOUR AS wallclock FROM lg")
    add("scan_log_table", f"""SELECT request_id, utc AS occurred_at, level, trace_id, message, stack_trace, {_EXC} AS exception_class, rank_no FROM (
      SELECT r.request_id, r.max_results, l.*, l.occurred_at - INTERVAL 8 HOUR AS utc,
        row_number() OVER (PARTITION BY r.request_id ORDER BY l.occurred_at DESC, arrival_seq) AS rank_no
      FROM lg l JOIN rq r ON l.project_id = r.project_id AND l.environment = r.environment
        AND l.occurred_at - INTERVAL 8 HOUR BETWEEN r.from_ts AND r.to_ts WHERE upper(level) IN ('WARN', 'ERROR')) WHERE rank_no <= max_results""")
    add("route_log_sources", """SELECT l.project_id, environment, arrival_seq, level,
      CASE number WHEN '1' THEN 'local-file' WHEN '2' THEN 'jdbc' ELSE 'mock' END AS source_type FROM lg l JOIN prj p ON p.project_id = l.project_id
      WHERE number IN ('0', '3') OR (number = '1' AND level IN ('WARN', 'ERROR')) OR (number = '2' AND upper(level) IN ('WARN', 'ERROR'))""")
    add("level_filter", """SELECT arrival_seq, level, 'table' AS mode FROM lg WHERE upper(level) IN ('WARN', 'ERROR')
      UNION ALL SELECT arrival_seq, level, 'file' FROM lg WHERE level IN ('WARN', 'ERROR')""")
    add("logs_first_n", """SELECT request_id, arrival_seq, rank_no FROM (SELECT request_id, arrival_seq,
      row_number() OVER (PARTITION BY request_id ORDER BY arrival_seq) AS rank_no FROM rl) WHERE rank_no <= 25""")
    add("recent_logs", """SELECT request_id, occurred_at, arrival_seq, rank_no FROM (SELECT request_id, occurred_at, arrival_seq, max_results,
      row_number() OVER (PARTITION BY request_id ORDER BY occurred_at DESC, arrival_seq) AS rank_no FROM kl) WHERE rank_no <= max_results""")
    add("request_evidence", "SELECT request_id, arrival_seq, occurred_at FROM rl")
    add("metrics_in_range", """SELECT request_id, evidence_id, metric, observed_at, value AS baseline_value, rank_no FROM (SELECT *,
      row_number() OVER (PARTITION BY request_id ORDER BY metric_seq) AS rank_no FROM rm) WHERE rank_no <= 10""")
    add("slow_sql_in_range", """SELECT request_id, evidence_id, sql_template, first_seen, occurrences, rank_no FROM (SELECT r.request_id, d.*,
      row_number() OVER (PARTITION BY r.request_id ORDER BY evidence_id, first_seen) AS rank_no
      FROM (SELECT project_id, environment, sql_template, CAST(occurred_at AS DATE) AS day, min(occurred_at) AS first_seen, count(*) AS occurrences,
        'sql-' || substr(md5(sql_template), 1, 12) AS evidence_id FROM raw_sql GROUP BY ALL) d
      JOIN rq r ON r.project_id = d.project_id AND r.environment = d.environment AND d.first_seen BETWEEN r.from_ts AND r.to_ts) WHERE rank_no <= 4""")
    add("changes_in_range", "SELECT request_id, evidence_id, type, occurred_at FROM rc")
    add("recent_changes", """SELECT request_id, evidence_id, type, occurred_at, row_number() OVER (PARTITION BY request_id ORDER BY occurred_at, change_seq) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY occurred_at DESC, change_seq DESC) AS n FROM rc) WHERE n <= 3""")
    add("slow_sql_rollup", """SELECT project_id, environment, 'sql-' || substr(md5(sql_template), 1, 12) AS evidence_id, sql_template, count(*) AS occurrences,
      (2 * sum(duration_ms)::BIGINT + count(*)) // (2 * count(*)) AS avg_duration_ms, max(duration_ms) AS max_duration_ms, min(occurred_at) AS first_seen
      FROM raw_sql GROUP BY project_id, environment, sql_template""")
    add("unavailable_sources", "SELECT request_id, unavailable FROM una")
    add("mysql_digest", _DIGEST.format("mysql-digest"))
    add("pg_statements", _DIGEST.format("pg_stat_statements"))
    add("route_slow_sql", """SELECT r.project_id, request_id, evidence_id, sql_template, occurrences, avg_duration_ms, max_duration_ms,
      CASE kind WHEN 'mysql' THEN 'mysql-digest' ELSE 'pg_stat_statements' END AS source
      FROM ranked r JOIN dbs d ON d.project_id = r.project_id WHERE kind IS NOT NULL AND n <= 10
      UNION ALL SELECT r.project_id, request_id, evidence_id, sql_template, occurrences, avg_duration_ms, max_duration_ms, 'log'
      FROM rs r JOIN dbs d ON d.project_id = r.project_id WHERE kind IS NULL""")
    add("mysql_health", """SELECT project_id, environment, snapshot_id, captured_at, active_connections, idle_connections, waiting_connections,
      long_transactions FROM mysnap""")
    add("pg_health", """SELECT project_id, environment, snapshot_id, captured_at, active_connections, idle_connections, waiting_connections,
      long_transactions FROM snap""")
    add("long_transactions", """SELECT snapshot_id, 'postgresql' AS engine, 'pid=' || pid || ' age=' || CASE WHEN pid % 61 = 0 THEN '00:01:00' ELSE '00:00:' || lpad(CAST(60 - pid % 61 AS VARCHAR), 2, '0') END
      || ' query=update stock set *** where id = ' || pid AS entry FROM sess WHERE captured_at - xact_start > INTERVAL 30 SECOND
      UNION ALL SELECT snapshot_id, 'mysql', 'trx=' || pid || ' started=' || strftime(xact_start, '%Y-%m-%d %H:%M:%S')
      || ' query=update stock set *** where id = ' || pid FROM sess WHERE xact_start < captured_at - INTERVAL 30 SECOND""")
    add("lock_waits", """SELECT snapshot_id, 'postgresql' AS engine, 'pid=' || pid || ' locktype=tuple mode=***' || substr(priority, length(split_part(priority, ' ', 1)) + 1) AS entry
      FROM sess WHERE NOT granted
      UNION ALL SELECT snapshot_id, 'mysql', 'blocking=' || pid || ' waiting=' || (pid + 1) FROM sess WHERE NOT granted""")
    add("health_status", """SELECT request_id, snapshot_id, available, unavailable_reason, active_connections, idle_connections, waiting_connections,
      long_transactions, lock_waits FROM health""")
    add("ingest_changes", """SELECT 'event-' || (100 + row_number() OVER (ORDER BY received_seq)) AS evidence_id, project_id, environment, type, occurred_at, attributes
      FROM subv WHERE reject_reason IS NULL""")
    posts = """, posts AS (SELECT n * 10 + CAST(substr(project_id, 5) AS INT) * 2 + (environment = 'local')::INT AS received_seq, n, project_id, environment, received_at, events, biggest, total
      FROM (SELECT event_id // 40 AS n, project_id, environment, max(ts) AS received_at, count(*) AS events, max(b) AS biggest, sum(b) AS total
        FROM (SELECT *, CASE WHEN k = 77 THEN 20000 ELSE 100 + k END AS b FROM ev WHERE event_type IN ('signup', 'click')) GROUP BY ALL)),
      named AS (SELECT *, CASE received_seq % 11 WHEN 1 THEN ' ' ELSE 'post-' || project_id || '-' || (n // 2) END AS request_id,
        CASE WHEN received_seq % 11 = 3 THEN 'svc-9' ELSE project_id END AS token_project FROM posts),
      reasoned AS (SELECT *, CASE WHEN received_seq % 11 = 1 THEN 'blank-request-id' WHEN received_seq % 11 = 3 THEN 'project-mismatch' WHEN received_seq % 11 = 4 THEN 'environment-not-allowed'
        WHEN received_seq % 11 = 2 THEN 'stale' WHEN events > 5 THEN 'too-many-events' WHEN total > 1048576 THEN 'batch-too-large' WHEN biggest > 16384 THEN 'event-too-large' END AS r FROM named),
      judged AS (SELECT *, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY token_project, request_id, r IS NULL ORDER BY received_at, received_seq) > 1 THEN 'duplicate' END) AS reject_reason FROM reasoned)"""
    add("judge_batches", "SELECT received_seq, request_id, project_id, environment, events::INT AS events, reject_reason FROM judged", posts)
    add("batch_events", """SELECT j.received_seq * 1000000 + row_number() OVER (PARTITION BY j.received_seq ORDER BY event_id) - 1 AS received_seq, j.project_id, j.environment,
      upper(event_type) AS type, ts AS occurred_at, '{version=v' || k || '}' AS attributes
      FROM judged j JOIN ev ON ev.event_id // 40 = j.n AND ev.project_id = j.project_id AND ev.environment = j.environment AND event_type IN ('signup', 'click')
      WHERE reject_reason IS NULL""", posts)
    add("batch_audit", """SELECT token_project, project_id, coalesce(reject_reason, 'accepted') AS result, count(*) AS batches, sum(events)::BIGINT AS events
      FROM judged GROUP BY ALL""", posts)
    add("evidence_audit", """SELECT request_id, count(*) AS rows, sum(length(evidence_id) + length(type) + length(description))::BIGINT AS characters,
      sum(CAST('0x' || substr(h, 1, 15) AS BIGINT))::VARCHAR || '-' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT))::VARCHAR AS payload_digest
      FROM (SELECT *, md5('=' || evidence_id || chr(31) || '=' || type || chr(31) || '=' || description) AS h FROM kept) GROUP BY request_id""")
    add("report_upsert", "SELECT * FROM latest")
    add("report_find", "SELECT * FROM latest WHERE diagnosis_id = 'diag-5'")
    add("report_history", """SELECT json_extract_string(report_json, '$.diagnosisId') AS diagnosis_id, json_extract_string(report_json, '$.projectId') AS project_id,
      json_extract_string(report_json, '$.environment') AS environment, created_at, json_extract_string(report_json, '$.summary') AS summary,
      json_extract_string(report_json, '$.ruleFallback') = 'true' AS rule_fallback
      FROM (SELECT * FROM latest WHERE project_id = 'svc-2' ORDER BY created_at DESC, diagnosis_id DESC LIMIT 10) WHERE json_valid(report_json)""")
    add("redact_documents", f"SELECT doc_id, {redact('text')} AS text FROM documents")
    add("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS text FROM documents")
    add("limit_stack", """SELECT doc_id, CASE WHEN len(string_split(rtrim(text, chr(10)), chr(10))) > 12
      THEN array_to_string(string_split(text, chr(10))[1:12], chr(10)) || chr(10) || '…' ELSE text END AS text FROM documents""")
    add("normalize_messages", f"SELECT doc_id, {normalize('text')} AS template FROM documents")
    add("redact_attributes", "SELECT received_seq, attributes FROM sub")
    add("exception_class", f"SELECT arrival_seq, {_EXC} AS exception_class FROM lg")
    add("top_frame", f"SELECT arrival_seq, {_FRAME} AS frame FROM lg")
    add("exc_class_fallback", """SELECT arrival_seq, CASE WHEN arrival_seq % 3 = 0 THEN 'GivenException'
      ELSE split_part(stack_trace, ':', 1) END AS exception_class FROM lg""")
    add("sanitize_logs", f"""SELECT arrival_seq, {redact('message')} AS message, stack_trace,
      CASE WHEN stack_trace IS NULL THEN '{{}}' ELSE '{{exceptionClass=' || {_EXC} || '}}' END AS attributes FROM lg""")
    add("sanitize_changes", "SELECT evidence_id, attributes FROM chg")
    add("sanitize_slow_sql", "SELECT sql_template || ' -- ***' AS sql_template, count(*) AS rows FROM raw_sql GROUP BY ALL")
    add("sanitize_metrics", "SELECT evidence_id, metric || ' rose for *** ***' AS description FROM met")
    add("redact_question", f"""SELECT request_id, CASE WHEN conv_id % 11 = 3 THEN '  ' ELSE {redact("text || ' token=' || conv_id")} END AS question FROM ask""")
    add("cluster_keys", f"""SELECT arrival_seq, project_id || '|' || environment || '|' || coalesce({_EXC}, 'null') || '|'
      || {normalize('message')} || '|' || coalesce({_FRAME}, 'null') AS cluster_key FROM lg WHERE upper(level) IN ('WARN', 'ERROR')""")
    add("strength", """SELECT event_id, CASE WHEN k % 4 >= 2 AND (k % 2 = 0 OR k % 3 = 0) THEN 'STRONG' WHEN k % 4 >= 2 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM ev""")
    add("classify_metrics", """SELECT evidence_id, metric LIKE '%pool%' OR metric LIKE '%connection%' AS is_pool,
      metric LIKE '%p95%' OR metric LIKE '%p99%' OR metric LIKE '%latency%' OR metric LIKE '%duration%' AS is_latency FROM met""")
    add("validate_requests", """SELECT request_id, CASE WHEN trim(a.project_id) = '' THEN 'blank-project_id' WHEN conv_id % 11 = 3 THEN 'blank-question'
      WHEN p.project_id IS NULL THEN 'unknown-project' WHEN NOT list_contains(environments, environment) THEN 'unknown-environment'
      WHEN span <= 0 THEN 'bad-range' WHEN span > 48 * 3600 THEN 'span-too-long' END AS reject_reason
      FROM ask a LEFT JOIN prj p ON p.project_id = a.project_id""")
    add("validate_events", "SELECT received_seq, reject_reason FROM subv")
    add("log_clusters", f"""SELECT request_id, evidence_id, cluster_key, exception_class, message_template, top_stack_frame, level, count, baseline_count,
      spike, first_seen, last_seen, {redact('first_message')} AS sample_message, sample_trace FROM clu""")
    add("spikes", "SELECT request_id, evidence_id, exception_class, message_template, current_count, baseline_count, last_seen FROM clu WHERE spike")
    add("cluster_ids", "SELECT request_id, evidence_id, cluster_key, first_seq FROM clu")
    add("deployment_regression", _CANDIDATE_ROWS + "dep")
    add("pool_contention", _CANDIDATE_ROWS + "pool")
    add("latency_correlation", _CANDIDATE_ROWS + "lat")
    add("budget_logs", """SELECT t.request_id, t.evidence_id, count, spike, rank_no FROM tight t
      JOIN clu c ON c.request_id = t.request_id AND c.evidence_id = t.evidence_id WHERE type_ord = 1""")
    add("budget_slow_sql", """SELECT t.request_id, t.evidence_id, avg_duration_ms, rank_no FROM tight t
      JOIN rs c ON c.request_id = t.request_id AND c.evidence_id = t.evidence_id WHERE type_ord = 3""")
    add("budget_metrics", """SELECT t.request_id, t.evidence_id, metric, rank_no FROM kept t
      JOIN rm c ON c.request_id = t.request_id AND c.evidence_id = t.evidence_id WHERE type_ord = 2""")
    add("budget_changes", """SELECT t.request_id, t.evidence_id, c.type, rank_no FROM tight t
      JOIN rc c ON c.request_id = t.request_id AND c.evidence_id = t.evidence_id WHERE type_ord = 4""")
    asked = """, question AS (SELECT request_id, list_filter(regexp_extract_all(lower('why does ' || CASE day(from_ts) // 2 % 4 WHEN 0 THEN 'IllegalStateException'
        WHEN 1 THEN 'rows of T_1' WHEN 2 THEN 'the view order' ELSE 'it' END || ' break in ' || project_id || '? ***'), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3) AS terms FROM rq)"""
    hits = r"(SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')) AS w) WHERE list_contains(terms, w))"
    gap = """(SELECT min(abs(epoch_us(c.occurred_at) - epoch_us(x.{0}))) FROM rc c WHERE c.request_id = x.request_id AND type IN ('DEPLOYMENT', 'ROLLBACK'))"""
    add("asked_clusters", f"""SELECT request_id, evidence_id, question_hits, level, count, deployment_gap_us, rank_no FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY question_hits > 0 DESC, upper(level) = 'ERROR' DESC, count DESC,
        deployment_gap_us NULLS LAST, cluster_seq) AS rank_no FROM (SELECT x.*, {hits.format("concat_ws(' ', exception_class, message_template, top_stack_frame)")} AS question_hits,
        {gap.format('last_seen')} AS deployment_gap_us FROM clu x JOIN question q ON q.request_id = x.request_id)) WHERE rank_no <= 3""", asked)
    add("asked_slow_sql", f"""SELECT request_id, evidence_id, question_hits, avg_duration_ms, deployment_gap_us, rank_no FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY question_hits > 0 DESC, avg_duration_ms DESC, occurrences DESC,
        deployment_gap_us NULLS LAST, evidence_id) AS rank_no FROM (SELECT x.*, {hits.format('sql_template')} AS question_hits,
        {gap.format('first_seen')} AS deployment_gap_us FROM rs x JOIN question q ON q.request_id = x.request_id)) WHERE rank_no <= 1""", asked)
    add("trace_links", """SELECT 'stmt-' || s.event_id AS evidence_id, s.project_id, s.environment, linked_id,
        CASE tier WHEN 1 THEN 'TRACE_ID' WHEN 2 THEN 'REQUEST_SCOPED' WHEN 3 THEN 'MODULE_SCOPED' WHEN 4 THEN 'TEMPORAL_ONLY' END AS correlation_type,
        gap_us, coalesce(tier < 4, false) AS definite, CASE WHEN tier = 1 THEN 'STRONG' WHEN tier IS NULL THEN 'WEAK' ELSE 'MODERATE' END AS strength
      FROM traced s LEFT JOIN best b ON b.event_id = s.event_id WHERE s.event_type = 'view'""", """,
      traced AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN 't-' || user_id || '-' || (event_id % 11) END AS trace,
        CASE WHEN event_id % 5 <> 0 THEN '/api/' || (user_id % 7) END AS uri, user_id % 3 AS src, k % 4 AS module,
        CASE WHEN event_id % 3 <> 0 THEN k % 3 END AS exc FROM ev),
      pairs AS (SELECT s.event_id, 'log-' || e.event_id AS linked_id, e.ts AS seen, abs(epoch_us(s.ts) - epoch_us(e.ts)) AS gap_us,
        CASE WHEN s.trace = e.trace THEN 1 WHEN gap_us > 3600000000 THEN NULL WHEN s.uri = e.uri AND s.src = e.src THEN 2
          WHEN s.module = e.module AND s.exc = e.exc THEN 3 ELSE 4 END AS tier
        FROM traced s JOIN traced e USING (project_id, environment) WHERE s.event_type = 'view' AND e.event_type = 'error'),
      best AS (SELECT * FROM pairs WHERE tier IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier, gap_us, seen, linked_id) = 1)""")
    add("budget_report", f"""SELECT *, log_clusters_truncated + slow_sql_truncated + metrics_truncated + change_events_truncated > 0 AS any_truncated
      FROM (SELECT request_id, {_budget_columns()} FROM rq r)""")
    add("evidence_text", "SELECT request_id, evidence_id, type, description FROM evid")
    add("evidence", "SELECT request_id, evidence_id, type, description, rank_no FROM kept WHERE type_ord < 5")
    add("timeline", """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY "at" NULLS LAST, o, w, s, evidence_id) AS position,
      "at", category, description, evidence_id FROM tl""")
    add("timeline_integrity", """SELECT request_id, "at", category, evidence_id FROM tl
      WHERE EXISTS (SELECT 1 FROM tight k WHERE k.request_id = tl.request_id AND k.evidence_id = tl.evidence_id)""")
    add("candidate_integrity", _CANDIDATE_ROWS + """cand c WHERE (SELECT count(*) FROM tight k
      WHERE k.request_id = c.request_id AND k.evidence_id IN (id_1, id_2)) = 2""")
    raw = """raw AS (SELECT conv_id || '-' || turn AS request_id, CASE (conv_id + turn) % 9 WHEN 0 THEN '' WHEN 1 THEN '{ broken' WHEN 2 THEN '"string"'
      WHEN 3 THEN '[1,2,3]' WHEN 4 THEN '{"unrelated":true}' WHEN 5 THEN '{"summary":5}'
      WHEN 6 THEN '{"summary":"only ' || conv_id || '-' || turn || '"}'
      ELSE '{"summary":"answer ' || conv_id || '-' || turn || '","rootCauseCandidates":[{"label":"deployment-regression","title":"t","explanation":"because '
        || conv_id || '-' || turn || '","evidenceIds":["log-' || turn || '",7]},{"label":" ","explanation":"dropped"},{"label":"slow-sql-pool-contention","explanation":" "},{"label":"deployment-regression","explanation":"second"}],"recommendedActions":["check '
        || conv_id || '-' || turn || '","review"]}' END AS raw_json FROM conversations)"""
    add("parse_model_output", """SELECT request_id, valid, CASE WHEN valid THEN json_extract_string(j, '$.summary') END AS summary,
      coalesce(array_to_string(list_transform(c, lambda x: x.label), ';'), '') AS labels,
      coalesce(array_to_string(list_transform(c, lambda x: coalesce(x.explanation, '')), ';'), '') AS explanations,
      coalesce(array_to_string(list_transform(c, lambda x: coalesce(array_to_string(x."evidenceIds", ','), '')), ';'), '') AS evidence_ids,
      coalesce(array_to_string(CAST(json_transform(CASE WHEN valid THEN j ELSE '{}' END, '{"recommendedActions":["VARCHAR"]}').recommendedActions AS VARCHAR[]), ';'), '') AS actions
      FROM (SELECT *, list_filter(json_transform(CASE WHEN valid THEN j ELSE '{}' END, '{"rootCauseCandidates":[{"label":"VARCHAR","explanation":"VARCHAR","evidenceIds":["VARCHAR"]}]}').rootCauseCandidates,
          lambda x: trim(x.label) <> '') AS c FROM (SELECT request_id, j, coalesce(json_type(j, '$.summary') = 'VARCHAR', false) AS valid
        FROM (SELECT request_id, CASE WHEN json_valid(raw_json) THEN raw_json ELSE '{}' END AS j FROM raw)))""", ", " + raw)
    add("merge_explanations", f"SELECT c.request_id, label, {_MODEL_EXPLANATION} AS explanation FROM kcand c JOIN heads h ON h.request_id = c.request_id")
    add("narrate", "SELECT request_id, summary, explanations, actions FROM told", _NARRATED)
    add("assign_report_ids", """SELECT q.request_id, 'diag-20240128-' || CASE WHEN f.number < 1000 THEN lpad(CAST(f.number AS VARCHAR), 3, '0') ELSE CAST(f.number AS VARCHAR) END AS diagnosis_id
      FROM (SELECT request_id, row_number() OVER (ORDER BY request_id) AS n FROM ask) q
      JOIN (SELECT number, row_number() OVER (ORDER BY number) AS n FROM (SELECT unnest(range(1, (SELECT count(*) FROM ask) + (SELECT count(DISTINCT conv_id) FROM conversations) + 1)) AS number)
        WHERE number NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 1)) f ON f.n = q.n""")
    add("reports", _REPORT.format(
        summary="t.summary", fallback="false", explanations="t.explanations", actions="t.actions", unavailable=_UNA,
    ) + "JOIN told t ON t.request_id = h.request_id", _NARRATED)
    valid = "n IN ('1', '2', '3')"
    add("fallback_reports", _REPORT.format(
        summary=f"""CASE WHEN {valid} THEN 'answer for ' || h.request_id WHEN n_cand > 0 THEN '模型不可用,以下为规则分析得出的候选根因(降级报告)。'
          ELSE '模型不可用,且规则未识别出明确根因。已返回聚合证据与时间线供人工排查。' END""",
        fallback=f"NOT {valid}",
        explanations=f"""coalesce((SELECT string_agg(coalesce({_MODEL_EXPLANATION}, ''), ';' ORDER BY position) FROM kcand c WHERE c.request_id = h.request_id), '')""",
        actions=f"CASE WHEN {valid} THEN 'step one;step two' ELSE '结合时间线与证据进行人工复核。' END",
        unavailable=f"{_UNA} || CASE WHEN {valid} THEN '' WHEN {_UNA} = '' THEN 'model:rules (error)' ELSE ';model:rules (error)' END"))
    add("stored_reports_roundtrip", """SELECT diagnosis_id, h.project_id, h.environment, TIMESTAMP '2024-02-01 00:00:00' AS created_at, summary, false AS rule_fallback
      FROM heads h JOIN told USING (request_id) JOIN (SELECT request_id, 'diag-20240128-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0')
        ELSE CAST(n AS VARCHAR) END AS diagnosis_id FROM (SELECT request_id, row_number() OVER (ORDER BY request_id) AS n FROM rq)) i USING (request_id)""", _NARRATED)
    own = """, own AS (SELECT *, row_number() OVER (ORDER BY {order}) AS seq FROM (SELECT occurred_at {shift} AS tm, {level} AS level, trace_id, message, stack_trace,
        project_id, environment FROM lg WHERE upper(level) IN ('WARN', 'ERROR'))),
      own_parts AS (SELECT o.*, request_id, to_ts, to_ts - from_ts > INTERVAL 1 DAY AS has_baseline, """ + f"{_EXC} AS e, {normalize('message')} AS m, {_FRAME} AS f" + """
        FROM own o JOIN rq r ON r.project_id = o.project_id AND r.environment = o.environment AND tm BETWEEN from_ts AND to_ts),
      own_clu AS (SELECT request_id, has_baseline, project_id || '|' || environment || '|' || coalesce(e, 'null') || '|' || coalesce(m, 'null') || '|' || coalesce(f, 'null') AS cluster_key,
        arg_min(level, seq) AS level, count(*) AS count, count(*) FILTER (tm < to_ts - INTERVAL 1 DAY) AS baseline_count,
        count(*) FILTER (tm >= to_ts - INTERVAL 1 DAY) AS current_count, min(tm) AS first_seen, max(tm) AS last_seen, min(seq) AS first_seq
        FROM own_parts GROUP BY ALL)"""
    own_rows = """SELECT request_id, 'log-' || row_number() OVER (PARTITION BY request_id ORDER BY first_seq) AS evidence_id, cluster_key, level, count, baseline_count,
      current_count >= 5 AND (NOT has_baseline OR current_count >= baseline_count * 1.2::DOUBLE) AS spike, first_seen, last_seen FROM own_clu"""
    add("log_view_clusters", own_rows, own.replace("{order}", "tm DESC, level, trace_id, message").replace("{shift}", "- INTERVAL 8 HOUR")
        .replace("{level}", "level"))
    add("textlog_clusters", own_rows, own.replace("{order}", "tm").replace("occurred_at {shift}", "date_trunc('milliseconds', occurred_at)::TIMESTAMP")
        .replace("{level}", "upper(level)"))
    add("diagnose_candidates", _CANDIDATE_ROWS + "kcand")
    add("diagnose_evidence", "SELECT request_id, evidence_id, type, description FROM kept")
    add("diagnose_timeline", "SELECT request_id, position, \"at\", category, description, evidence_id FROM ktl")
    add("score_reports", "SELECT * FROM scored", SCORED)
    add("score_summary", "SELECT count(*) FILTER (passed) AS passed, count(*) AS scenarios FROM scored", SCORED)
    return q


def all_sql() -> dict[str, str]:
    return {name: f"WITH {ENTITIES}{extra}\n{select}" for name, (extra, select) in _queries().items()}
