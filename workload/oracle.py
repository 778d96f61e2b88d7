"""The expected answer of each query as DuckDB SQL over the source columns.

Nothing here reads a rendered line: values are computed from the columns the lines were
rendered from, so the SQL shares no pattern with the library.
"""

SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)"

EVENTS = """
WITH base AS (
  SELECT event_id, user_id, event_type, event_id + 1 AS line_number,
    date_trunc('second', ts) AS t,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip,
    CASE event_type WHEN 'signup' THEN 'PUT' WHEN 'purchase' THEN 'POST'
      WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
    '/' || event_type || '/' || (event_id % 50) AS path,
    CAST(CASE event_type WHEN 'view' THEN 200 WHEN 'purchase' THEN 201 WHEN 'signup' THEN 302
      WHEN 'click' THEN 404 ELSE 500 END AS INTEGER) AS status,
    CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS size,
    CAST(event_id % 997 AS DOUBLE) / 1000 AS rt,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS status_level,
    CASE event_type WHEN 'view' THEN 'info' WHEN 'purchase' THEN 'notice' WHEN 'signup' THEN 'debug'
      WHEN 'click' THEN 'warn' ELSE 'error' END AS level,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' WHEN 'signup' THEN 'debug'
      ELSE 'info' END AS word_level,
    CASE event_type WHEN 'view' THEN 'page shown' WHEN 'purchase' THEN 'order placed'
      WHEN 'signup' THEN 'debug trail of signup' WHEN 'click' THEN 'Warning: slow click'
      ELSE 'unhandled Exception' END AS words,
    event_id % 100 <> 99 AS ok, event_id % 7 <> 3 AS filled, event_id // 2500 AS log,
    CASE WHEN user_id % 3 = 0 THEN 'web-a' ELSE 'web-b' END AS site
  FROM events)
"""

TEXT, NO_TIME = "CAST(NULL AS VARCHAR)", "CAST(NULL AS TIMESTAMP)"
NO_HTTP = dict(
    ip=TEXT, method=TEXT, path=TEXT, status="CAST(NULL AS INTEGER)", size="CAST(NULL AS BIGINT)",
    user_agent=TEXT, response_time="CAST(NULL AS DOUBLE)",
)
ACCESS = dict(
    timestamp="t", level="status_level", message="method || ' ' || path || ' HTTP/1.1'",
    ip="ip", method="method", path="path", status="status", size="size",
)
NGINX = ACCESS | dict(source="'nginx'", user_agent="'agent/' || (user_id % 7)", response_time="rt")
APACHE = ACCESS | dict(
    source="'apache'", response_time="CAST(NULL AS DOUBLE)",
    user_agent="CASE WHEN event_id % 2 = 0 THEN 'agent/' || (user_id % 7) END",
)
NGINX_ERROR = NO_HTTP | dict(
    timestamp="t", level="level", message="words || ', client: ' || ip", source="'nginx-error'"
)
JSON = dict(
    timestamp="t",
    level="""CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'purchase' THEN 'level-35' ELSE level END
             ELSE CASE event_type WHEN 'purchase' THEN 'warn' ELSE level END END""",
    message="words || ' ' || event_id", source="'json'", ip="ip", method="method", path="path",
    status="status", size="nullif(size, 0)", user_agent=TEXT, response_time="nullif(rt, 0)",
)
NUMBERED = "words || ' ' || event_id"
SYSLOG = NO_HTTP | dict(
    timestamp="t", level="word_level", message=NUMBERED, source="'syslog:app-' || event_type"
)
TIMESTAMPED = NO_HTTP | dict(timestamp="t", level="level", message=NUMBERED, source="'custom'")
BRACKETED = TIMESTAMPED | dict(timestamp="CASE WHEN event_id % 2 = 0 THEN t END")
PLAIN = NO_HTTP | dict(timestamp=NO_TIME, level="word_level", message=NUMBERED, source="'plain'")
CORRUPT = NO_HTTP | dict(
    timestamp=NO_TIME, level="'info'", message="'corrupt ' || event_id", source="'plain'"
)
USER = NO_HTTP | dict(
    timestamp="t", level="CASE WHEN event_id % 5 = 0 THEN 'info' ELSE level END", message="words",
    source="'custom'", ip="ip", method="method", path="path", status="status",
    size="CASE WHEN event_id % 10 <> 0 THEN size END",
)


def either(cases: list[tuple[str, dict]], last: dict) -> dict:
    def pick(name):
        whens = " ".join(f"WHEN {c} THEN {e[name]}" for c, e in cases)
        return f"CASE {whens} ELSE {last[name]} END"

    return {name: pick(name) for name in last}


def entries(columns: dict, where: str = "ok") -> str:
    doubles = {n: f"CAST({columns[n]} AS DOUBLE)" for n in ("status", "size")}
    listed = ", ".join(f"{sql} AS {name}" for name, sql in (columns | doubles).items())
    return f"{EVENTS} SELECT line_number, {listed} FROM base WHERE {where}"


def custom(columns: dict) -> str:
    """In the custom format a corrupt line is a plain one."""
    return entries(either([("NOT ok", CORRUPT)], columns), "true")


MIXED = either([("event_id % 3 = 0", NGINX_ERROR)], NGINX)
CASCADE = either(
    [("event_id % 4 = 0", SYSLOG), ("event_id % 4 = 1", TIMESTAMPED), ("event_id % 4 = 2", BRACKETED)],
    PLAIN,
)
FILTERED = "line_number, t AS timestamp, status_level AS level, ip, path, CAST(status AS DOUBLE) AS status"
RAW = "lower(ip || ' - - ' || method || ' ' || path || ' HTTP/1.1 agent/' || (user_id % 7))"
HOUR = "strftime(t, '%Y-%m-%dT%H')"
ISO = "strftime(t, '%Y-%m-%dT%H:%M:%S') || '.000Z'"


def matching(where: str) -> str:
    return f"{EVENTS} SELECT {FILTERED} FROM base WHERE ok AND {where}"


def counts(key: str, name: str, where: str = "true") -> str:
    return f"{EVENTS} SELECT {key} AS {name}, count(*) AS count FROM base WHERE ok AND {where} GROUP BY 1"


def top(key: str, n: int, name: str | None = None) -> str:
    return f"""{EVENTS} SELECT {key} AS {name or key}, count(*) AS count FROM base WHERE ok GROUP BY 1
        ORDER BY count DESC, min(line_number), 1 LIMIT {n}"""


RANKED = f"""{EVENTS}, ranked AS (
  SELECT rt, row_number() OVER (ORDER BY rt) AS rank, count(*) OVER () AS n FROM base WHERE ok),
times AS (
  SELECT round(avg(rt), 6) AS avg_response_time,
    max(CASE WHEN rank = ceil(CAST(0.95 AS DOUBLE) * n) THEN rt END) AS p95_response_time,
    max(CASE WHEN rank = ceil(CAST(0.99 AS DOUBLE) * n) THEN rt END) AS p99_response_time
  FROM ranked)
"""
TOTALS = """count(*) AS total_lines, count(*) FILTER (ok) AS parsed_lines,
  count(*) FILTER (NOT ok) AS failed_lines"""
SITE_LINES = f"""{EVENTS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY event_id) AS n,
    count(*) OVER (PARTITION BY site) AS total
  FROM base WHERE filled)
"""
FILE_LINES = f"""{EVENTS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY log ORDER BY event_id) AS n,
    count(*) OVER (PARTITION BY log) AS total,
    CASE log % 4 WHEN 0 THEN 'apache' WHEN 1 THEN 'nginx' WHEN 2 THEN 'json' ELSE 'custom' END AS format
  FROM base WHERE filled),
shown AS (
  SELECT *, CASE format
      WHEN 'json' THEN {JSON['level']}
      WHEN 'custom' THEN CASE WHEN ok THEN word_level ELSE 'info' END
      ELSE status_level END AS shown_level,
    CASE WHEN format <> 'custom' THEN status END AS shown_status,
    CASE WHEN format <> 'custom' THEN path END AS shown_path,
    CASE WHEN format <> 'custom' THEN method END AS shown_method,
    CASE WHEN format <> 'custom' THEN size END AS shown_size,
    CASE WHEN format = 'nginx' THEN rt WHEN format = 'json' THEN nullif(rt, 0) END AS shown_rt
  FROM numbered WHERE ok OR format = 'custom')
"""
LONG_PATHS = f"""{EVENTS}, longer AS (
  SELECT *, path || repeat('/part-9', line_number % 17) AS long,
    method || ' ' || path || ' HTTP/1.1' || repeat('/part-9', line_number % 17) AS said FROM base WHERE ok)
"""
VIEW_ROW = """upper(shown_level) AS level, CAST(shown_status AS DOUBLE) AS status, shown_method AS method,
  CASE WHEN format <> 'custom' THEN path WHEN ok THEN words || ' ' || event_id ELSE 'corrupt ' || event_id END AS detail"""
EARLY = "event_id % 2500 < 1300 AND log % 4 <> 3"
FILE_REPORT = """log, format, n AS line_number, shown_level AS level, CAST(shown_status AS DOUBLE) AS status,
  shown_path AS path"""
TEXT_LINES = f"""
pieces AS (SELECT k, file, unnest(parts) AS v, unnest(range(1, len(parts) + 1)) AS pos FROM texts),
stripped AS (SELECT k, file, pos, trim(v, {SPACES}) AS raw FROM pieces),
lines AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k, pos) AS n FROM stripped WHERE raw <> ''),
levels AS (SELECT *, CASE
    WHEN lower(raw) LIKE '%error%' OR lower(raw) LIKE '%exception%' OR lower(raw) LIKE '%fatal%'
      OR lower(raw) LIKE '%critical%' THEN 'error'
    WHEN lower(raw) LIKE '%warn%' THEN 'warn'
    WHEN lower(raw) LIKE '%debug%' OR lower(raw) LIKE '%trace%' THEN 'debug'
    ELSE 'info' END AS level FROM lines)
"""
CSV_TEXT = "line_number || ',' || {time} || ',' || {level} || ',' || {rest}"

ORACLE = {
    "parse_apache": entries(APACHE),
    "parse_apache_offset": entries(APACHE),
    "parse_nginx_access": entries(NGINX),
    "parse_nginx_error": entries(NGINX_ERROR),
    "parse_nginx_mixed": entries(MIXED),
    "parse_json": entries(JSON),
    "parse_syslog": custom(SYSLOG),
    "parse_simple_ts": custom(TIMESTAMPED),
    "parse_bracketed": custom(BRACKETED),
    "parse_plain": custom(PLAIN),
    "parse_custom_cascade": custom(CASCADE),
    "parse_user_pattern": entries(USER),
    "parse_documents": f"""WITH texts AS (
        SELECT doc_id AS k, source AS file, string_split(text, chr(10)) AS parts FROM documents), {TEXT_LINES}
        SELECT file, n AS line_number, level, raw AS message, 'plain' AS source FROM levels""",
    "parse_conversations": f"""WITH texts AS (
        SELECT conv_id AS k, role AS file, string_split(text, chr(10)) AS parts FROM conversations), {TEXT_LINES}
        SELECT file, level, 'plain' AS source, count(*) AS count, CAST(sum(length(raw)) AS BIGINT) AS chars
        FROM levels GROUP BY ALL""",
    "rejects": f"""{EVENTS} SELECT line_number, 'corrupt ' || event_id AS raw, 'apache' AS format
        FROM base WHERE NOT ok""",
    "format_predicates": f"""{EVENTS} SELECT line_number,
        ok AND log % 4 IN (0, 1) AS apache,
        ok AND (log % 4 = 1 OR (log % 4 = 0 AND event_id % 2 = 0)) AS nginx,
        ok AND log % 4 = 2 AS json, ok AND log % 4 = 3 AS syslog
        FROM base WHERE filled""",
    "detect_format": f"""{FILE_LINES} SELECT DISTINCT log, format FROM numbered""",
    "detect_format_files": f"""{FILE_LINES} SELECT DISTINCT log, format FROM numbered""",
    "number_lines": f"""{SITE_LINES} SELECT site AS file, n AS line_number,
        CAST(length(CASE WHEN NOT ok THEN 'corrupt ' || event_id ELSE
          ip || ' - u' || user_id || ' [01/Jan/2024:00:00:00 +0000] "' || method || ' ' || path
          || ' HTTP/1.1" ' || status || ' '
          || CASE WHEN event_id % 10 = 0 THEN '-' ELSE CAST(size AS VARCHAR) END
          || CASE WHEN event_id % 2 = 0 THEN ' "http://ref.example/" "agent/' || (user_id % 7) || '"' ELSE '' END
        END) AS INTEGER) AS chars FROM numbered""",
    "number_lines_files": f"""{FILE_LINES} SELECT log, n AS line_number, NOT ok AS corrupt FROM numbered""",
    "head_n": f"""{SITE_LINES} SELECT site AS file, n AS line_number, ip, path, status
        FROM numbered WHERE ok AND n <= 50""",
    "tail_n": f"""{SITE_LINES} SELECT site AS file, n AS line_number, ip, path, status
        FROM numbered WHERE ok AND n > total - 50""",
    "parse_report_files": f"""{FILE_LINES} SELECT {FILE_REPORT} FROM shown WHERE n <= 50""",
    "parse_report_tail_files": f"""{FILE_LINES} SELECT {FILE_REPORT} FROM shown WHERE n > total - 20""",
    "filter_report_files": f"""{FILE_LINES} SELECT log, format, shown_level AS level, count(*) AS count
        FROM shown WHERE shown_level IN ('error', 'warn') GROUP BY ALL""",
    "stats_report_files": f"""{FILE_LINES}, ranked AS (
        SELECT shown_rt AS rt, row_number() OVER (ORDER BY shown_rt) AS rank, count(*) OVER () AS n
        FROM shown WHERE shown_rt IS NOT NULL)
        SELECT (SELECT count(*) FROM numbered) AS total_lines, count(*) AS parsed_lines,
          (SELECT count(*) FROM numbered) - count(*) AS failed_lines,
          CAST(sum(shown_size) AS BIGINT) AS total_bytes,
          strftime(min(t) FILTER (ok), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS "from",
          count(*) FILTER (shown_level = 'error') AS errors,
          count(*) FILTER (shown_method = 'GET') AS gets,
          count(DISTINCT {HOUR}) FILTER (ok AND shown_level = 'error') AS error_hours,
          (SELECT rt FROM ranked WHERE rank = ceil(CAST(0.99 AS DOUBLE) * n)) AS p99_response_time
        FROM shown""",
    "filter_level": matching("status_level IN ('error', 'warn')"),
    "filter_status": matching("status IN (404, 500)"),
    "filter_ip": matching("ip IN ('10.0.0.7', '10.0.0.16')"),
    "filter_method": matching("method IN ('POST', 'PUT')"),
    "filter_path": matching("event_type IN ('purchase', 'view') AND CAST(event_id % 50 AS VARCHAR) LIKE '1%'"),
    "filter_time": matching("t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"),
    "filter_contains": matching("user_id % 7 = 3"),
    "filter_not_contains": matching("user_id % 7 <> 3"),
    "filter_all": matching("""status_level IN ('info', 'warn') AND status IN (200, 404, 302)
        AND method = 'GET' AND user_id < 100 AND event_type IN ('view', 'click')
        AND t BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' AND user_id % 7 <> 5"""),
    "filter_untimed": f"""{EVENTS} SELECT line_number, CASE WHEN event_id % 2 = 0 THEN t END AS timestamp
        FROM base WHERE ok AND level = 'error' AND (event_id % 2 = 1 OR t >= TIMESTAMP '2024-01-15')""",
    "filter_summary": f"""{EVENTS}, c AS (SELECT count(*) AS total,
        count(*) FILTER (status IN (404, 500) AND path LIKE '%/click/%') AS matched FROM base WHERE ok)
        SELECT total, matched, round(100.0 * matched / total, 1)::DOUBLE AS percentage FROM c""",
    "level_distribution": counts("status_level", "level"),
    "status_distribution": counts("(status // 100) || 'xx'", "status_class"),
    "method_distribution": counts("method", "method"),
    "errors_per_hour": counts(HOUR, "hour", "status = 500"),
    "top_paths": top("path", 10),
    "top_ips": top("ip", 10),
    "response_times": f"{RANKED} SELECT * FROM times",
    "stats_counts": f"{EVENTS} SELECT {TOTALS} FROM base",
    "stats_time_range": f"{EVENTS} SELECT min(t) AS first_time, max(t) AS last_time FROM base WHERE ok",
    "total_bytes": f"""{EVENTS}, c AS (SELECT CAST(sum(size) AS BIGINT) AS total_bytes FROM base WHERE ok)
        SELECT total_bytes, round(total_bytes / CAST(1048576 AS DOUBLE), 2) AS megabytes FROM c""",
    "stats_summary": f"""{RANKED} SELECT {TOTALS}, min(t) FILTER (ok) AS first_time,
        max(t) FILTER (ok) AS last_time, any_value(avg_response_time) AS avg_response_time,
        any_value(p95_response_time) AS p95_response_time,
        any_value(p99_response_time) AS p99_response_time,
        CAST(sum(size) FILTER (ok) AS BIGINT) AS total_bytes FROM base, times""",
    "stats_one_pass": f"""{EVENTS}, facts AS (
        SELECT 'level' AS dimension, status_level AS key, line_number FROM base WHERE ok
        UNION ALL SELECT 'status', (status // 100) || 'xx', line_number FROM base WHERE ok
        UNION ALL SELECT 'method', method, line_number FROM base WHERE ok
        UNION ALL SELECT 'error_hour', {HOUR}, line_number FROM base WHERE ok AND status = 500
        UNION ALL SELECT 'path', path, line_number FROM base WHERE ok
        UNION ALL SELECT 'ip', ip, line_number FROM base WHERE ok)
        SELECT dimension, key, count(*) AS count, min(line_number) AS first_line FROM facts GROUP BY 1, 2""",
    "distribution_shares": f"""{EVENTS}, facts AS (
        SELECT 'level' AS dimension, status_level AS key FROM base WHERE ok
        UNION ALL SELECT 'status', (status // 100) || 'xx' FROM base WHERE ok)
        SELECT dimension, key, count(*) AS count,
          round(100.0 * count(*) / (SELECT count(*) FROM base WHERE ok), 1)::DOUBLE AS percentage
        FROM facts GROUP BY 1, 2""",
    "top_of_tally": top("path", 25),
    "stats_document": f"""{RANKED}, ips AS (
        SELECT ip, count(*) AS c FROM base WHERE ok GROUP BY 1 ORDER BY c DESC, min(line_number), 1 LIMIT 1 OFFSET 4)
        SELECT {TOTALS}, CAST(sum(size) FILTER (ok) AS BIGINT) AS total_bytes,
          strftime(min(t) FILTER (ok), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS "from",
          strftime(max(t) FILTER (ok), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS "to",
          count(*) FILTER (ok AND status_level = 'error') AS errors,
          count(*) FILTER (ok AND status = 404) AS client_errors,
          count(*) FILTER (ok AND method = 'GET') AS gets,
          count(DISTINCT {HOUR}) FILTER (ok AND status = 500) AS error_hours,
          (SELECT path FROM base WHERE ok GROUP BY 1 ORDER BY count(*) DESC, min(line_number), 1 LIMIT 1) AS first_path,
          (SELECT ip FROM ips) AS fifth_ip, (SELECT c FROM ips) AS fifth_ip_count,
          (SELECT p95_response_time FROM times) AS p95_response_time
        FROM base""",
    "csv_projection": f"""{EVENTS} SELECT line_number AS line, {ISO} AS timestamp, status_level AS level,
        CAST(status AS DOUBLE) AS status, method, path, method || ' ' || path || ' HTTP/1.1' AS message, ip,
        CAST(nullif(size, 0) AS DOUBLE) AS size, nullif(rt, 0) AS response_time FROM base WHERE ok""",
    "csv_rows": f"""{EVENTS} SELECT CASE WHEN event_id % 3 = 0
          THEN line_number || ',' || {ISO} || ',' || level || ',,,,"' || words || ', client: ' || ip || '",,,'
          ELSE line_number || ',' || {ISO} || ',' || status_level || ',' || status || ',' || method || ','
            || path || ',' || method || ' ' || path || ' HTTP/1.1,' || ip || ','
            || coalesce(CAST(nullif(size, 0) AS VARCHAR), '') || ','
            || coalesce(CAST(nullif(rt, 0) AS VARCHAR), '') END AS value
        FROM base WHERE ok""",
    "json_projection": f"""{EVENTS} SELECT line_number AS line, {ISO} AS timestamp, status_level AS level,
        method || ' ' || path || ' HTTP/1.1' AS message, 'nginx' AS source, ip, method, path, CAST(status AS DOUBLE) AS status,
        CAST(size AS DOUBLE) AS size,
        rt AS "responseTime" FROM base WHERE ok""",
    "json_rows": f"""{EVENTS} SELECT '{{"line":' || line_number || ',"timestamp":'
        || CASE WHEN ok AND event_id % 2 = 0 THEN '"' || {ISO} || '"' ELSE 'null' END
        || ',"level":"' || CASE WHEN ok THEN level ELSE 'info' END
        || '","message":"' || CASE WHEN ok THEN words || ' ' ELSE 'corrupt ' END || event_id
        || '","source":"' || CASE WHEN ok THEN 'custom' ELSE 'plain' END || '"}}' AS value FROM base""",
    "preview": f"""{EVENTS} SELECT line_number AS line, strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp,
        upper(CASE WHEN event_id % 3 = 0 THEN level ELSE status_level END) AS level,
        CAST(CASE WHEN event_id % 3 <> 0 THEN status END AS DOUBLE) AS status,
        CASE WHEN event_id % 3 <> 0 THEN method END AS method,
        CASE WHEN event_id % 3 = 0 THEN words || ', client: ' || ip ELSE path END AS detail
        FROM base WHERE ok""",
    "has_http_entries": f"{EVENTS} SELECT count(*) > 0 AS has_http FROM base WHERE ok",
    "highlighted": f"""{EVENTS} SELECT line_number,
        CASE WHEN method = 'POST' THEN '<<POST>>' ELSE method END || ' '
        || CASE WHEN event_type = 'view' THEN '<</view>>/' || (event_id % 50) ELSE path END
        || ' HTTP/1.1' AS message FROM base WHERE ok""",
    "parquet_by_day": f"""{EVENTS} SELECT strftime(t, '%Y-%m-%d') AS event_date, count(*) AS count,
        CAST(sum(size) AS BIGINT) AS bytes FROM base WHERE ok AND t >= TIMESTAMP '2024-01-15' GROUP BY 1""",
    "live_counts_stream": f"""{EVENTS} SELECT date_trunc('hour', t) AS window_start, status_level AS level,
        (status // 100) || 'xx' AS status_class, count(*) AS count FROM base WHERE ok GROUP BY 1, 2, 3""",
    "follow_numbered_stream": f"""{FILE_LINES} SELECT log, n AS line_number, NOT ok AS corrupt FROM numbered""",
    "follow_report_stream": f"""{FILE_LINES} SELECT
        CASE WHEN ok THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS timestamp, upper(shown_level) AS level,
        CAST(shown_status AS DOUBLE) AS status, shown_method AS method,
        CASE WHEN format = 'custom' THEN words || ' ' || event_id
          ELSE replace(path, '/click', '<</click>>') END AS detail
        FROM shown WHERE shown_level IN ('error', 'warn')""",
    "follow_late_file_stream": f"""{FILE_LINES} SELECT
        CASE WHEN ok THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS timestamp, {VIEW_ROW}
        FROM shown""",
    "follow_backlog_stream": f"""{FILE_LINES}, seen AS (
        SELECT *, count(*) FILTER ({EARLY}) OVER (PARTITION BY log) AS early FROM numbered)
        SELECT log, n AS line, {VIEW_ROW}
        FROM shown JOIN (SELECT event_id, early FROM seen) USING (event_id) WHERE NOT ({EARLY}) OR n > early - 10""",
    "follow_rotation_stream": f"""{FILE_LINES}, seen AS (
        SELECT event_id, row_number() OVER (PARTITION BY log, {EARLY} ORDER BY event_id) AS line FROM numbered)
        SELECT log, line, {VIEW_ROW} FROM shown JOIN seen USING (event_id)""",
    "stream_folder_levels": f"{FILE_LINES} SELECT log, count(*) AS lines FROM numbered GROUP BY 1",
    "json_sink": f"""{EVENTS} SELECT '{{"line":' || line_number || ',"timestamp":"' || {ISO} || '","level":"' || status_level
        || '","message":"' || method || ' ' || path || ' HTTP/1.1","source":"nginx","ip":"' || ip || '","method":"' || method
        || '","path":"' || path || '","status":' || status || ',"size":' || size || ',"responseTime":'
        || CASE WHEN rt = 0 THEN '0' ELSE CAST(rt AS VARCHAR) END || '}}' AS value FROM base WHERE ok""",
    "csv_sink": f"""{EVENTS} SELECT line_number || ',' || {ISO} || ',' || status_level || ',' || status || ',' || method || ','
        || path || ',' || method || ' ' || path || ' HTTP/1.1,' || ip || ','
        || coalesce(CAST(nullif(size, 0) AS VARCHAR), '') || ',' || coalesce(CAST(nullif(rt, 0) AS VARCHAR), '') AS value
        FROM base WHERE ok""",
    "stats_json_text": f"""{EVENTS}, paths AS (
        SELECT path, count(*) AS c FROM base WHERE ok GROUP BY 1 ORDER BY c DESC, min(line_number), 1 LIMIT 1),
        ips AS (SELECT ip FROM base WHERE ok GROUP BY 1 ORDER BY count(*) DESC, min(line_number), 1 LIMIT 1 OFFSET 2)
        SELECT CAST(count(*) AS VARCHAR) AS total_lines, CAST(CAST(sum(size) FILTER (ok) AS BIGINT) AS VARCHAR) AS total_bytes,
          strftime(min(t) FILTER (ok), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS first,
          CAST(count(*) FILTER (ok AND status_level = 'info') AS VARCHAR) AS infos,
          CAST(count(*) FILTER (ok AND status // 100 = 2) AS VARCHAR) AS found,
          CAST(count(*) FILTER (ok AND method = 'PUT') AS VARCHAR) AS puts,
          (SELECT path FROM paths) AS path, (SELECT CAST(c AS VARCHAR) FROM paths) AS path_count, (SELECT ip FROM ips) AS third_ip
        FROM base""",
    "filter_summary_text": f"""{EVENTS}, c AS (SELECT count(*) AS total,
        count(*) FILTER (status IN (404, 500) AND path LIKE '%/click/%') AS matched FROM base WHERE ok)
        SELECT '{{"total":' || total || ',"matched":' || matched || ',"percentage":"'
          || printf('%.1f', round(100.0 * matched / total, 1)) || '"}}' AS value FROM c""",
    "preview_cut": f"""{LONG_PATHS} SELECT line_number AS line, CASE WHEN line_number % 2 = 0 THEN method END AS method,
        CASE WHEN line_number % 2 = 0 THEN CASE WHEN length(long) > 40 THEN left(long, 37) || '...' ELSE long END
          ELSE CASE WHEN length(said) > 80 THEN left(said, 77) || '...' ELSE said END END AS detail FROM longer""",
    "top_paths_cut": f"""{LONG_PATHS} SELECT CASE WHEN length(long) > 35 THEN left(long, 32) || '...' ELSE long END AS path, count
        FROM (SELECT long, count(*) AS count FROM longer GROUP BY 1 ORDER BY count DESC, min(line_number), 1 LIMIT 50)""",
}
