"""The same results in SQL, written from the events' own columns rather than from the Spark code."""

from __future__ import annotations

from huntframe import config
from huntframe.fixtures import LOG_SQL
from huntframe.operators.parse_windows import EVENT_NAMES, LOGON_TYPES
from huntframe.operators.signatures import SIGNATURES
from huntframe.operators.tags import TECHNIQUES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _log(sql: str) -> str:
    return f"{LOG_SQL}{sql if sql.startswith(',') else ' ' + sql}"


def _severity(score: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'CRITICAL' WHEN {score} >= 50 THEN 'HIGH' WHEN {score} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"


def _time(ts: str, name: str = "ts") -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S') AS {name}"


def _brief(kind: str, source: str, score: str, more: str = "", ip: str = "source_ip", user: str = "username", ts: str = "ts", count: str = "n") -> str:
    """The columns of a finding from a derived table."""
    return f"SELECT '{kind}' AS finding_type, {ip} AS source_ip, {user} AS username, {_time(ts)}, ({score})::INTEGER AS severity_score, {_severity(score)} AS severity, ({count})::BIGINT AS count{', ' + more if more else ''} FROM {source}"


def _failure(words: tuple, processes: tuple) -> str:
    return f"(lower(process) IN ({', '.join(map(_quoted, processes))}) AND regexp_matches(lower(message), '{'|'.join(words)}'))"


_NULL = "NULL::VARCHAR"
_Z = "CASE WHEN std > 0 THEN ({x} - mean) / std ELSE 0 END AS z"


def _stats(source: str, x: str) -> str:
    return f"SELECT n, s / n AS mean, sqrt(greatest((n * q - s * s) / (n * n), 0)) AS std FROM (SELECT count({x})::DOUBLE AS n, sum({x})::DOUBLE AS s, sum({x}::HUGEINT * {x})::DOUBLE AS q FROM {source})"


_FAIL_STAT = _failure(config.FAILURE_WORDS_STATISTICAL, config.AUTH_PROCESSES_STATISTICAL)
_FAIL_TEMP = _failure(config.FAILURE_WORDS_TEMPORAL, config.AUTH_PROCESSES_TEMPORAL)
_FAIL_ML = _failure(config.FAILURE_WORDS_ML, config.AUTH_PROCESSES_ML)
_OFF = "(hour(ts) < 7 OR hour(ts) >= 20)"
_SENSITIVE = f"process IN ({', '.join(map(_quoted, config.SENSITIVE_PROCESSES))})"
_AUTH = f"process IN ({', '.join(map(_quoted, config.AUTH_PROCESSES_TEMPORAL))})"
_WEEKEND = f"(isodow(ts) >= 6 AND {_SENSITIVE})"

#: hits: (seq, finding_type, base_score, k) of every signature on the log; k is its place.
_HITS = ", hits AS (" + " UNION ALL ".join(
    f"SELECT seq, '{s.name}' AS finding_type, {s.score} AS base_score, {k} AS k FROM log WHERE " + " OR ".join(f"regexp_matches({f}, {_quoted(s.pattern)})" for f in s.fields)
    for k, s in enumerate(SIGNATURES)
) + ")"

_AUTH_SPIKE = f", auth AS (SELECT source_ip, arg_min(username, seq) AS username, min(ts) AS ts, count(*) AS n, min(seq) AS first_seq, arg_min(left(raw, 200), seq) AS first_line, list(left(raw, 200) ORDER BY seq)[1:5] AS evidence FROM log WHERE {_FAIL_STAT} GROUP BY source_ip HAVING count(*) >= 5)"
_LARGE = f", sizes AS (SELECT * FROM log WHERE bytes_sent > 0), stats AS ({_stats('sizes', 'bytes_sent')}), large AS (SELECT *, {_Z.format(x='bytes_sent')} FROM sizes, stats), big AS (SELECT *, least(100, 45 + trunc(z * 8))::INTEGER AS score FROM large WHERE z >= 3 AND n >= 20)"
_TRAVEL = ", steps AS (SELECT *, lag(source_ip) OVER w AS ip_a, lag(ts) OVER w AS before, lag(raw) OVER w AS raw_a FROM log WINDOW w AS (PARTITION BY username ORDER BY ts, seq)), travel AS (SELECT *, (epoch_us(ts) - epoch_us(before)) // 1000000 AS gap FROM steps WHERE ip_a <> source_ip AND epoch_us(ts) - epoch_us(before) <= 300000000)"
#: fnd: the findings that merging, correlation and the summaries work on.
_FND = (
    _LARGE + _AUTH_SPIKE + _TRAVEL + f""", fnd AS (
  SELECT 'Statistical Detector' AS detector, 'large_response_bytes' AS finding_type, score, source_ip, {_NULL} AS username, ts, 1 AS n, 1 AS r, 3 AS rule, seq AS first_seq, [left(raw, 200)] AS evidence FROM big
  UNION ALL SELECT 'Statistical Detector', 'auth_failure_spike', least(100, 35 + least(n, 60))::INTEGER, source_ip, username, ts, n, 1, 4, first_seq, evidence FROM auth
  UNION ALL SELECT 'Temporal Detector', 'impossible_travel', 70, source_ip, username, ts, 2, 3, 3, seq, [left(raw_a, 200), left(raw, 200)] FROM travel
), fs AS (SELECT *, {_severity('score')} AS severity FROM fnd)"""
)
_MERGED = (
    _FND + """, placed AS (
  SELECT *, row_number() OVER w AS place, coalesce(score > max(score) OVER (PARTITION BY finding_type, source_ip, username ORDER BY r, rule, first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS record
  FROM fs WINDOW w AS (PARTITION BY finding_type, source_ip, username ORDER BY r, rule, first_seq)
), best AS (
  SELECT *, first_value(place) OVER (PARTITION BY finding_type, source_ip, username ORDER BY score DESC, place) AS winner FROM placed
), lines AS (
  SELECT finding_type, source_ip, username, line, row_number() OVER (PARTITION BY finding_type, source_ip, username ORDER BY turn, pos) AS p
  FROM (SELECT finding_type, source_ip, username, CASE WHEN record THEN -place ELSE place END AS turn, unnest(evidence) AS line, generate_subscripts(evidence, 1) AS pos FROM best)
), firsts AS (
  SELECT finding_type, source_ip, username, line, row_number() OVER (PARTITION BY finding_type, source_ip, username ORDER BY p) AS p FROM (SELECT finding_type, source_ip, username, line, min(p) AS p FROM lines GROUP BY 1, 2, 3, 4)
), shown AS (
  SELECT finding_type, source_ip, username, string_agg(line, '|' ORDER BY p) AS evidence, count(*) AS lines FROM firsts WHERE p <= 10 GROUP BY 1, 2, 3
), counts AS (
  SELECT finding_type, source_ip, username, max(n) AS n FROM best WHERE place >= winner GROUP BY 1, 2, 3
), merged AS (
  SELECT b.detector, b.finding_type, b.source_ip, b.username, b.ts, b.score, b.severity, c.n, s.lines, s.evidence, b.r, b.rule, b.first_seq
  FROM best b JOIN counts c ON b.finding_type = c.finding_type AND b.source_ip = c.source_ip AND b.username IS NOT DISTINCT FROM c.username
  JOIN shown s ON b.finding_type = s.finding_type AND b.source_ip = s.source_ip AND b.username IS NOT DISTINCT FROM s.username
  WHERE b.place = b.winner
), raised AS (
  SELECT m.*, d.k, least(100, m.score + CASE d.k WHEN 1 THEN 0 WHEN 2 THEN 10 WHEN 3 THEN 20 ELSE 30 END)::INTEGER AS new_score
  FROM merged m JOIN (SELECT source_ip, count(DISTINCT detector) AS k FROM merged GROUP BY 1) d USING (source_ip)
)"""
)
_SYSLOG_MESSAGE = "CASE seq % 10 WHEN 4 THEN 'Invalid user ' || username || ' from ' || source_ip WHEN 5 THEN 'Accepted publickey for ' || username || ' from ' || source_ip || ' port 22' WHEN 6 THEN 'su: FAILED SU (to root) x to root by ' || username WHEN 7 THEN 'new user: name=' || username WHEN 8 THEN 'warn: link from ' || source_ip ELSE 'Failed password for ' || username || ' from ' || source_ip END"
_WINDOWS_CODE = "CASE seq % 5 WHEN 0 THEN '4624' WHEN 1 THEN '4625' WHEN 2 THEN '4720' WHEN 3 THEN '9999' ELSE '1102' END"
_WINDOWS_NAME = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in EVENT_NAMES.items()) + " ELSE 'Event ' || {c} END"
_WINDOWS = f""", w AS (
  SELECT seq, ts, source_ip, username, seq % 10 AS form, CASE seq % 10 WHEN 1 THEN '4625' WHEN 2 THEN '4688' WHEN 3 THEN '4740' ELSE {_WINDOWS_CODE} END AS code FROM log WHERE seq % 10 <> 5
), windows AS (
  SELECT seq, CASE WHEN form IN (2, 4) THEN NULL WHEN form = 1 THEN ts - INTERVAL 2 HOUR ELSE ts END AS ts, CASE WHEN form IN (2, 4) THEN NULL ELSE ts END AS ts_local, CASE WHEN form IN (1, 2, 3, 4) THEN NULL ELSE source_ip END AS source_ip,
         CASE WHEN form IN (1, 4) THEN NULL ELSE username END AS username, CASE form WHEN 1 THEN 'h2' WHEN 2 THEN 'h3' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'h1' END AS hostname,
         CASE WHEN form IN (1, 2, 3, 4) THEN NULL ELSE 'lsass.exe' END AS process, CASE WHEN form = 4 THEN NULL ELSE code END AS event_id, CASE form WHEN 4 THEN NULL WHEN 2 THEN 'ERROR' ELSE 'INFO' END AS log_level,
         CASE WHEN form = 4 THEN 'no json at all' ELSE {_WINDOWS_NAME.format(c='code')} || CASE WHEN form IN (1, 2, 3) THEN '' ELSE ' [RemoteInteractive (RDP)]' END END AS message, form <> 4 AS parse_ok
  FROM w
)"""
_FEATURES = f""", f AS (
  SELECT source_ip AS source, count(*) AS total_requests, count(DISTINCT http_path) AS unique_paths, count(*) FILTER (http_status >= 400) / count(*) * 100 AS error_rate_pct,
         coalesce(sum(bytes_sent) FILTER (bytes_sent <> 0)::DOUBLE / count(*) FILTER (bytes_sent <> 0), 0) AS avg_bytes, count(DISTINCT user_agent) AS unique_user_agents,
         count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000, 0.01) AS rpm, count(*) FILTER ({_FAIL_ML}) AS auth_failures,
         count(*) FILTER ({_OFF}) / count(*) * 100 AS off_hours_pct, count(*) FILTER (http_method = 'POST') / count(*) * 100 AS post_ratio_pct
  FROM log GROUP BY source_ip HAVING count(*) >= 3
)"""
_ROUNDED = ("error_rate_pct", "avg_bytes", "rpm", "off_hours_pct", "post_ratio_pct")
_NAMES = ("total_requests", "unique_paths", "error_rate_pct", "avg_bytes", "unique_user_agents", "rpm", "auth_failures", "off_hours_pct", "post_ratio_pct")
_SPIKES = f", rpm AS (SELECT source_ip, date_trunc('minute', ts) AS minute, count(*) AS requests FROM log GROUP BY ALL), busiest AS (SELECT source_ip, max(requests) AS max_rpm, sum(requests) AS n FROM rpm GROUP BY 1), stats AS ({_stats('busiest', 'max_rpm')}), spikes AS (SELECT b.source_ip, b.max_rpm, b.n, {_Z.format(x='max_rpm')}, (SELECT arg_min(ts, seq) FROM log l WHERE l.source_ip = b.source_ip) AS ts FROM busiest b, (SELECT mean, std FROM stats) s)"
_PATHS = f", paths AS (SELECT source_ip, count(DISTINCT http_path) AS n, arg_min(ts, seq) AS ts FROM log GROUP BY 1), stats AS ({_stats('paths', 'n')}), pz AS (SELECT p.*, {_Z.format(x='p.n')} FROM paths p, (SELECT mean, std FROM stats) s)"
_BURST = ", b AS (SELECT source_ip, ts, seq, lag(ts, 2) OVER (PARTITION BY source_ip ORDER BY ts, seq) AS began FROM log), burst AS (SELECT source_ip, arg_min(began, epoch_us(ts)::HUGEINT * 1000000000 + seq) AS ts FROM b WHERE epoch_us(ts) - epoch_us(began) <= 3600000000 GROUP BY 1)"


def _keyed(where: str, least: int, more: str = "") -> str:
    """Groups by address, first row in time order."""
    return f"(SELECT source_ip, arg_min(username, epoch_us(ts)::HUGEINT * 1000000000 + seq) AS username, min(ts) AS ts, max(ts) AS last, count(*) AS n FROM log WHERE {where} GROUP BY source_ip HAVING count(*) >= {least}{more})"


#: Parsed access and syslog lines: the columns that detectors read. Lines tell whole seconds.
_ACCESS_LOG = """, parsed AS (
  SELECT seq, CASE WHEN seq % 50 > 3 THEN date_trunc('second', ts) WHEN seq % 50 = 0 THEN TIMESTAMP '2024-10-10 13:55:36' END AS ts, CASE WHEN seq % 50 > 3 THEN source_ip END AS source_ip, CASE WHEN seq % 50 > 3 THEN username END AS username,
         NULL::VARCHAR AS process, CASE WHEN seq % 50 > 3 THEN http_method || ' ' || http_path || ' HTTP/1.1' WHEN seq % 50 = 2 THEN 'broken ' || seq ELSE message END AS message, CASE WHEN seq % 50 > 3 THEN http_path END AS http_path,
         CASE WHEN seq % 50 > 3 THEN http_status END AS http_status, CASE WHEN seq % 50 > 3 THEN bytes_sent END AS bytes_sent, CASE WHEN seq % 50 > 3 THEN user_agent END AS user_agent,
         CASE seq % 50 WHEN 0 THEN '[Thu Oct 10 13:55:36 2024] [error] [pid 12] ' || message WHEN 1 THEN '[Thu Oct 10 13:55:36.123456 2024] [warn] ' || message WHEN 2 THEN 'broken ' || seq ELSE raw END AS raw
  FROM log WHERE seq % 50 <> 3
)"""
_SYSLOG_LOG = f""", told AS (SELECT *, {_SYSLOG_MESSAGE} AS text, 'host' || seq % 3 AS host FROM log WHERE seq % 10 <> 3), parsed AS (
  SELECT seq, CASE WHEN seq % 10 <> 2 THEN date_trunc('second', ts) END AS ts, CASE WHEN seq % 10 NOT IN (2, 6, 7) THEN source_ip END AS source_ip, CASE WHEN seq % 10 NOT IN (2, 7, 8) THEN username END AS username,
         CASE WHEN seq % 10 <> 2 THEN process END AS process, CASE WHEN seq % 10 <> 2 THEN text ELSE 'broken ' || seq END AS message, NULL::VARCHAR AS http_path, NULL::INTEGER AS http_status, NULL::BIGINT AS bytes_sent, NULL::VARCHAR AS user_agent,
         CASE seq % 10 WHEN 1 THEN '<34>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || host || ' ' || process || ' 77 ID47 - ' || text WHEN 2 THEN 'broken ' || seq
         ELSE strftime(ts, '%b %d %H:%M:%S') || ' ' || host || ' ' || process || '[' || seq || ']: ' || text END AS raw
  FROM told
)"""


def _hunt(parsed: str) -> str:
    """A whole run over the table `parsed`, without the forest: merged and correlated findings."""
    hits = " UNION ALL ".join(f"SELECT seq, '{s.name}' AS kind, {s.score} AS base, {k} AS k FROM parsed WHERE " + " OR ".join(f"coalesce(regexp_matches({f}, {_quoted(s.pattern)}), false)" for f in s.fields) for k, s in enumerate(SIGNATURES))
    key, first = "coalesce(source_ip, username, 'unknown')", "{'ip': source_ip, 'name': username, 'seq': seq}"
    in_time = "epoch_us(ts)::HUGEINT * 1000000000000 + seq"

    def by_key(detector: str, kind: str, where: str, least: str, score: str, r: int, rule: int, order: str, by: str = key) -> str:
        return f"SELECT '{detector}', '{kind}', w.ip, w.name, least(100, {score})::INTEGER, n, {r}, {rule}, w.seq, 0, 0 FROM (SELECT {by} AS key, count(*) AS n, min(ts) AS a, max(ts) AS b, arg_min({first}, {order}) AS w FROM parsed WHERE {where} GROUP BY 1) WHERE {least}"

    fail = lambda words, processes: f"coalesce(lower(process) IN ({', '.join(map(_quoted, processes))}) AND regexp_matches(lower(message), '{'|'.join(words)}'), false)"
    stat, temp = fail(config.FAILURE_WORDS_STATISTICAL, config.AUTH_PROCESSES_STATISTICAL), fail(config.FAILURE_WORDS_TEMPORAL, config.AUTH_PROCESSES_TEMPORAL)
    s, t = "Statistical Detector", "Temporal Detector"
    every = [
        "SELECT 'Pattern Detector', kind, w.ip, w.name, least(100, base + CASE WHEN n > 5 THEN 10 ELSE 0 END + CASE WHEN n > 20 THEN 15 ELSE 0 END)::INTEGER, n, 0, 0, begun, k, w.seq FROM pattern JOIN (SELECT k, min(w.seq) AS begun FROM pattern GROUP BY 1) USING (k)",
        f"SELECT '{s}', 'request_rate_spike', source_ip, NULL, least(100, 40 + trunc(z * 10))::INTEGER, n, 1, 1, (SELECT min(seq) FROM parsed p WHERE p.source_ip = x.source_ip), 0, 0 FROM (SELECT *, {_Z.format(x='max_rpm')} FROM busiest, rate_stats) x WHERE max_rpm >= 120 OR z >= 3",
        f"SELECT '{s}', 'error_rate_spike', NULL, NULL, trunc(errors / total * 100)::INTEGER, total, 1, 2, seq, 0, 0 FROM (SELECT count(*) AS total, count(*) FILTER (http_status >= 400) AS errors, min(seq) AS seq FROM parsed WHERE http_status IS NOT NULL AND ts IS NOT NULL GROUP BY time_bucket(INTERVAL 5 MINUTE, ts)) WHERE total >= 10 AND errors / total * 100 >= 40",
        f"SELECT '{s}', 'large_response_bytes', source_ip, NULL, least(100, 45 + trunc(z * 8))::INTEGER, 1, 1, 3, seq, 0, 0 FROM (SELECT *, {_Z.format(x='bytes_sent')} FROM (SELECT * FROM parsed WHERE bytes_sent > 0), byte_stats) WHERE n >= 20 AND z >= 3",
        by_key(s, "auth_failure_spike", stat, "n >= 5", "35 + least(n, 60)", 1, 4, "seq"),
        f"SELECT '{s}', 'path_enumeration', source_ip, NULL, least(100, 40 + trunc(z * 8))::INTEGER, n, 1, 5, seq, 0, 0 FROM (SELECT p.*, {_Z.format(x='p.n')} FROM paths p, (SELECT mean, std FROM path_stats)) WHERE z >= 3 AND n >= 20",
        by_key(t, "off_hours_auth_activity", f"{_OFF} AND ({_AUTH} OR {_SENSITIVE})", "n >= 2", "45 + 2 * n", 3, 1, in_time),
        f"SELECT '{t}', 'impossible_travel', source_ip, username, 70, 2, 3, 3, seq, 0, 0 FROM (SELECT *, lag(source_ip) OVER w AS ip_a, lag(ts) OVER w AS before FROM parsed WHERE username IS NOT NULL AND source_ip IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY username ORDER BY ts, seq)) WHERE ip_a <> source_ip AND epoch_us(ts) - epoch_us(before) <= 300000000",
        by_key(t, "weekend_sensitive_activity", _WEEKEND, "true", "35 + 3 * n", 3, 4, in_time, "coalesce(username, source_ip, 'unknown')"),
        by_key(t, "slow_brute_force", f"ts IS NOT NULL AND {temp}", "n >= 10 AND epoch_us(b) - epoch_us(a) >= 1800000000", "50 + n", 3, 5, in_time),
        f"SELECT '{t}', 'request_burst', source_ip, NULL, 70, 20, 3, 2, arg_min(began, {in_time}), 0, 0 FROM (SELECT *, lag(seq, 19) OVER w AS began, lag(ts, 19) OVER w AS before FROM parsed WHERE source_ip IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY source_ip ORDER BY ts, seq)) WHERE epoch_us(ts) - epoch_us(before) <= 10000000 GROUP BY source_ip",
    ]
    return _log(
        f"""{parsed}, hits AS ({hits}), pattern AS (SELECT k, any_value(kind) AS kind, any_value(base) AS base, {key} AS key, count(*) AS n, arg_min({first}, seq) AS w FROM hits JOIN parsed USING (seq) GROUP BY k, {key}),
        busiest AS (SELECT source_ip, max(n) AS max_rpm, sum(n) AS n FROM (SELECT source_ip, date_trunc('minute', ts) AS minute, count(*) AS n FROM parsed WHERE source_ip IS NOT NULL AND ts IS NOT NULL GROUP BY ALL) GROUP BY 1),
        rate_stats AS (SELECT mean, std FROM ({_stats('busiest', 'max_rpm')})), byte_stats AS ({_stats('(SELECT * FROM parsed WHERE bytes_sent > 0)', 'bytes_sent')}),
        paths AS (SELECT source_ip, count(DISTINCT http_path) AS n, min(seq) AS seq FROM parsed WHERE source_ip IS NOT NULL AND http_path IS NOT NULL GROUP BY 1), path_stats AS ({_stats('paths', 'n')}),
        found(detector, finding_type, source_ip, username, score, n, r, rule, a, b, c) AS ({' UNION ALL '.join(every)}),
        placed AS (SELECT *, row_number() OVER (PARTITION BY finding_type, source_ip, username ORDER BY r, rule, a, b, c) AS place FROM found),
        winners AS (SELECT *, first_value(place) OVER (PARTITION BY finding_type, source_ip, username ORDER BY score DESC, place) AS winner FROM placed),
        merged AS (SELECT any_value(detector) AS detector, finding_type, source_ip, username, max(score) AS score, max(n) FILTER (place >= winner) AS n FROM winners GROUP BY finding_type, source_ip, username),
        raised AS (SELECT m.*, coalesce(d.k, 1) AS k, least(100, score + CASE WHEN d.k >= 4 THEN 30 WHEN d.k = 3 THEN 20 WHEN d.k = 2 THEN 10 ELSE 0 END)::INTEGER AS raised FROM merged m LEFT JOIN (SELECT source_ip, count(DISTINCT detector) AS k FROM merged WHERE source_ip IS NOT NULL GROUP BY 1) d USING (source_ip))
        SELECT finding_type, source_ip, username, raised AS severity_score, {_severity('raised')} AS severity, n::BIGINT AS count, k > 1 AS corroborated FROM raised"""
    )


def _sentences() -> str:
    """Whole sentences and tags, written out here rather than taken from the code under test."""
    url = "https://attack.mitre.org/techniques/"
    whole = "((epoch_us(last) - epoch_us(ts)) // 60000000)"
    spent = f"(CASE WHEN {whole} >= 60 THEN {whole} // 60 || 'h ' ELSE '' END || {whole} % 60 || 'm')"
    first = "arg_min(source_ip, epoch_us(ts)::HUGEINT * 1000000000 + seq)"
    weekend = f"(SELECT username, {first} AS source_ip, count(*) AS n FROM log WHERE {_WEEKEND} GROUP BY 1)"
    s, t, user = "Statistical Detector", "Temporal Detector", "username"
    rows = (
        (s, "auth_failure_spike", "auth", user, "least(100, 35 + least(n, 60))", "n || ' authentication failures from ' || source_ip || '. Possible brute force or credential stuffing.'", f"T1110.001 / Password Guessing / Credential Access / {url}T1110/001/"),
        (t, "off_hours_auth_activity", _keyed(f"{_OFF} AND ({_AUTH} OR {_SENSITIVE})", 2), user, "least(100, 45 + 2 * n)", "n || ' authentication/sensitive events outside business hours (07:00' || chr(8211) || '20:00) from ' || source_ip || '.'", f"T1078 / Valid Accounts / Initial Access / {url}T1078/"),
        (t, "weekend_sensitive_activity", weekend, user, "least(100, 35 + 3 * n)", "n || ' sensitive operations on a weekend by ' || username || '. User account changes, service installs, or audit policy changes outside working days warrant investigation.'", f"T1098 / Account Manipulation / Persistence / {url}T1098/"),
        (t, "slow_brute_force", _keyed(_FAIL_TEMP, 10, " AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 1800000000"), user, "least(100, 50 + n)", f"n || ' auth failures from ' || source_ip || ' spread over ' || {spent} || '. Low-rate brute force designed to evade rate-limit detection.'", f"T1110.003 / Password Spraying / Credential Access / {url}T1110/003/"),
        (t, "impossible_travel", "travel", user, "70", "'User ' || chr(39) || username || chr(39) || ' active from ' || ip_a || ' then ' || source_ip || ' within ' || gap || ' seconds. Possible account sharing, credential theft, or VPN switch.'", f"T1078 / Valid Accounts / Initial Access / {url}T1078/"),
        (t, "request_burst", "burst", _NULL, "53", "'IP ' || source_ip || ' sent 3 requests in 3600 seconds. Possible DDoS, brute force, or automated scanner.'", f"T1498 / Network Denial of Service / Impact / {url}T1498/"),
    )
    every = (f"SELECT '{detector}' AS detector, '{kind}' AS finding_type, source_ip, {name} AS username, ({score})::INTEGER AS severity_score, {text} AS description, '{tags}' AS tags FROM {source}" for detector, kind, source, name, score, text, tags in rows)
    return _log(_AUTH_SPIKE + _TRAVEL + _BURST + " " + " UNION ALL ".join(every))


def oracle_sql() -> dict[str, str]:
    """SQL by query name; queries whose result SQL cannot give are left out."""
    hits_grouped = "(SELECT finding_type, k, source_ip, arg_min(username, seq) AS username, arg_min(ts, seq) AS ts, count(*) AS n, least(100, any_value(base_score) + CASE WHEN count(*) > 5 THEN 10 ELSE 0 END + CASE WHEN count(*) > 20 THEN 15 ELSE 0 END) AS score FROM hits JOIN log USING (seq) GROUP BY 1, 2, 3)"
    techniques = ", ".join(f"({_quoted(kind)}, {_quoted(t[0])}, {_quoted(t[1])}, {_quoted(t[2])})" for kind, t in [*((s.name, t) for s in SIGNATURES for t in s.tags), *TECHNIQUES.items()])
    all_kinds = {
        "request_rate_spike": ("spikes WHERE max_rpm >= 120 OR z >= 3", "least(100, 40 + trunc(z * 10))"),
        "auth_failure_spike": ("auth", "least(100, 35 + least(n, 60))"),
        "large_response_bytes": ("big", "score"),
        "off_hours_auth_activity": (_keyed(f"{_OFF} AND ({_AUTH} OR {_SENSITIVE})", 2), "least(100, 45 + 2 * n)"),
        "impossible_travel": ("travel", "70"),
        "weekend_sensitive_activity": (f"(SELECT username, count(*) AS n FROM log WHERE {_WEEKEND} GROUP BY 1)", "least(100, 35 + 3 * n)"),
        "slow_brute_force": (_keyed(_FAIL_TEMP, 10, " AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 1800000000"), "least(100, 50 + n)"),
        "error_rate_spike": ("(SELECT count(*) AS total, count(*) FILTER (http_status >= 400) AS errors FROM log GROUP BY time_bucket(INTERVAL 5 MINUTE, ts)) WHERE total >= 10 AND errors / total * 100 >= 40", "trunc(errors / total * 100)"),
        "path_enumeration": ("pz WHERE z >= 3 AND n >= 20", "least(100, 40 + trunc(z * 8))"),
    }
    return {
        "read_json_events": _log(_WINDOWS + " SELECT event_id, message, parse_ok, count(*) AS entries FROM windows GROUP BY ALL"),
        "read_json_array": _log(_WINDOWS + " SELECT event_id, message, parse_ok, count(*) AS entries FROM windows WHERE parse_ok GROUP BY ALL"),
        "write_findings": _log(_AUTH_SPIKE + " SELECT 'run' AS run_id, 'auth_failure_spike' AS finding_type, source_ip, least(100, 35 + least(n, 60))::INTEGER AS severity_score, n AS count FROM auth"),
        "run_stats": _log("SELECT 'apache' AS log_format, count(*) AS total_lines, count(*) FILTER (seq % 50 <> 3) AS parsed_lines, count(*) FILTER (seq % 50 = 2) AS parse_errors FROM log"),
        "parse_logs": _log(
            _WINDOWS
            + """ SELECT 'apache' AS log_format, count(*) FILTER (seq % 50 <> 3) AS entries, count(*) FILTER (seq % 50 > 3) AS users, count(*) FILTER (seq % 50 > 3) AS addresses FROM log
            UNION ALL SELECT 'syslog', count(*) FILTER (seq % 10 <> 3), count(*) FILTER (seq % 10 NOT IN (2, 3, 7, 8)), count(*) FILTER (seq % 10 NOT IN (2, 3, 6, 7)) FROM log
            UNION ALL SELECT 'windows_event', count(*), count(username), count(source_ip) FROM windows
            UNION ALL SELECT 'generic', count(*), count(*) FILTER (seq % 4 <> 3), count(*) FROM log"""
        ),
        "parse_access": _log(
            f"""SELECT seq, CASE WHEN k > 3 THEN source_ip END AS source_ip, CASE WHEN k > 3 THEN username END AS username, CASE WHEN k > 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, CASE WHEN k > 3 THEN http_method END AS http_method,
            CASE WHEN k > 3 THEN http_path END AS http_path, CASE WHEN k > 3 THEN http_status END AS http_status, CASE WHEN k > 3 THEN bytes_sent END AS bytes_sent, CASE WHEN k > 3 THEN user_agent END AS user_agent,
            CASE WHEN k > 3 THEN http_method || ' ' || http_path || ' HTTP/1.1' ELSE 'broken ' || seq END AS message, CASE WHEN k > 3 THEN 'HTTP/1.1' END AS protocol, k > 3 AS parse_ok FROM (SELECT *, seq % 50 AS k FROM log) WHERE k > 1 AND k <> 3"""
        ),
        "parse_access_error": _log("SELECT seq, CASE WHEN seq % 50 = 0 THEN '2024-10-10 13:55:36' END AS ts, CASE WHEN seq % 50 = 0 THEN 'ERROR' ELSE 'WARN' END AS log_level, message, true AS parse_ok FROM log WHERE seq % 50 < 2"),
        "access_status_level": _log("SELECT http_status, log_level AS level, count(*) AS entries FROM log GROUP BY ALL"),
        "parse_syslog_3164": _log(f"SELECT seq, {_time('ts')}, 'host' || seq % 3 AS hostname, process, seq::INTEGER AS pid, {_SYSLOG_MESSAGE} AS message FROM log WHERE seq % 10 NOT IN (1, 2, 3)"),
        "parse_syslog_5424": _log(f"SELECT seq, {_time('ts')}, 'host' || seq % 3 AS hostname, process, 77 AS pid, {_SYSLOG_MESSAGE} AS message FROM log WHERE seq % 10 = 1"),
        "parse_syslog_raw": _log(f"SELECT seq, {_NULL} AS ts, {_NULL} AS hostname, {_NULL} AS process, NULL::INTEGER AS pid, 'broken ' || seq AS message, false AS parse_ok FROM log WHERE seq % 10 = 2"),
        "syslog_enrich": _log("SELECT seq, CASE WHEN seq % 10 NOT IN (2, 7, 8) THEN username END AS username, CASE WHEN seq % 10 NOT IN (2, 6, 7) THEN source_ip END AS source_ip, CASE WHEN seq % 10 IN (0, 1, 9) THEN 'true' END AS failed_ssh, CASE WHEN seq % 10 = 6 THEN 'root' END AS target_user, CASE WHEN seq % 10 = 7 THEN username END AS affected_user FROM log WHERE seq % 10 <> 3"),
        "syslog_level": _log("SELECT seq % 10 AS form, CASE WHEN seq % 10 IN (0, 1, 4, 6, 9) THEN 'ERROR' WHEN seq % 10 = 8 THEN 'WARNING' WHEN seq % 10 IN (5, 7) THEN 'INFO' END AS log_level, count(*) AS entries FROM log WHERE seq % 10 <> 3 GROUP BY ALL"),
        "parse_windows": _log(_WINDOWS + f" SELECT seq, {_time('ts')}, {_time('ts_local', 'ts_local')}, source_ip, username, hostname, process, event_id, log_level, message, parse_ok FROM windows"),
        "windows_event_name": _log(
            f"SELECT code AS event_id, {_WINDOWS_NAME.format(c='code')} || ' [' || CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LOGON_TYPES.items()) + " ELSE t END || ']' AS name, count(*) AS entries FROM (SELECT (4620 + seq % 40)::VARCHAR AS code, (seq % 12)::VARCHAR AS t FROM log) GROUP BY ALL"
        ),
        "windows_clean_ip_user": _log("SELECT seq, CASE WHEN seq % 6 > 2 THEN source_ip END AS source_ip, CASE WHEN seq % 6 > 3 THEN username END AS username FROM log"),
        "parse_generic_json": _log(f"SELECT seq, {_time('ts')}, source_ip, username, http_path, http_status, NULL::BIGINT AS bytes_sent, 'WARN' AS log_level, 'dmz' AS zone FROM log WHERE seq % 4 = 0"),
        "parse_generic_kv": _log(f"SELECT seq, {_time('ts')}, source_ip, username, http_path, http_status, bytes_sent, 'INFO' AS log_level, 'two words' AS message, 7 AS pairs FROM log WHERE seq % 4 = 1"),
        "parse_generic_text": _log(f"SELECT seq, {_time('ts')}, source_ip, username || ':' AS username, http_method, http_path, http_status, 'ERROR' AS log_level FROM log WHERE seq % 4 = 2"),
        "parse_generic_text_plain": _log(f"SELECT seq, {_NULL} AS ts, source_ip, {_NULL} AS username, NULL::INTEGER AS http_status, 'NOTICE' AS log_level, 'seen ' || source_ip || ' k=' || seq || ' notice' AS message FROM log WHERE seq % 4 = 3"),
        "route_generic": _log("SELECT seq, CASE seq % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'kv' ELSE 'text' END AS route FROM log"),
        "pattern_hits": _log(_HITS + " SELECT seq, finding_type, base_score FROM hits"),
        "pattern_hits_pages": " UNION ALL ".join(f"SELECT page_id AS seq, '{s.name}' AS finding_type FROM pages WHERE " + " OR ".join(f"regexp_matches({c}, {_quoted(s.pattern)})" for f, c in (("http_path", "url"), ("message", "html")) if f in s.fields) for s in SIGNATURES if {"http_path", "message"} & set(s.fields)),
        "is_auth_failure": _log(f"SELECT seq, {_FAIL_STAT} AS statistical, {_FAIL_TEMP} AS temporal, {_FAIL_ML} AS ml FROM log"),
        "is_off_hours": _log(f"SELECT seq, {_OFF} AS off_hours FROM log"),
        "is_weekend_sensitive": _log(f"SELECT seq, {_WEEKEND} AS weekend_sensitive FROM log"),
        "pattern_findings": _log(_HITS + f" SELECT finding_type, source_ip, username, {_time('ts')}, score::INTEGER AS severity_score, {_severity('score')} AS severity, n AS count, least(5, n)::INTEGER AS lines FROM {hits_grouped}"),
        "requests_per_minute": _log(f"SELECT source_ip, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS requests FROM log GROUP BY ALL"),
        "request_rate_spike": _log(_SPIKES + " " + _brief("request_rate_spike", "spikes WHERE max_rpm >= 120 OR z >= 3", "least(100, 40 + trunc(z * 10))", "max_rpm::VARCHAR AS max_rpm", user=_NULL)),
        "error_rate_windows": _log(f"SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total, count(*) FILTER (http_status >= 400) AS errors FROM log GROUP BY ALL"),
        "error_rate_spike": _log(_brief("error_rate_spike", "(SELECT arg_min(ts, seq) AS ts, count(*) AS n, count(*) FILTER (http_status >= 400) AS errors FROM log GROUP BY date_trunc('hour', ts)) WHERE n >= 10 AND errors / n * 100 >= 20", "trunc(errors / n * 100)", ip=_NULL, user=_NULL)),
        "large_response_bytes": _log(_LARGE + " " + _brief("large_response_bytes", "big", "score", "bytes_sent AS bytes", user=_NULL, count="1")),
        "auth_failure_spike": _log(_AUTH_SPIKE + " " + _brief("auth_failure_spike", "auth", "least(100, 35 + least(n, 60))", "first_line")),
        "path_enumeration": _log(_PATHS + " " + _brief("path_enumeration", "pz WHERE z >= 2 AND n >= 20", "least(100, 40 + trunc(z * 8))", user=_NULL)),
        "path_enumeration_sketched": _log(_PATHS + " " + _brief("path_enumeration", "pz WHERE z >= 2 AND n >= 20", "least(100, 40 + trunc(z * 8))", user=_NULL)),
        "off_hours_auth_activity": _log(_brief("off_hours_auth_activity", *all_kinds["off_hours_auth_activity"])),
        "weekend_sensitive_activity": _log(_brief("weekend_sensitive_activity", f"(SELECT username, arg_min(source_ip, epoch_us(ts)::HUGEINT * 1000000000 + seq) AS source_ip, min(ts) AS ts, count(*) AS n FROM log WHERE {_WEEKEND} GROUP BY 1)", "least(100, 35 + 3 * n)")),
        "slow_brute_force": _log(_brief("slow_brute_force", all_kinds["slow_brute_force"][0], "least(100, 50 + n)", "((epoch_us(last) - epoch_us(ts)) // 60000000)::BIGINT AS minutes")),
        "source_features": _log(_FEATURES + " SELECT source, " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in _NAMES) + " FROM f"),
        "source_features_sketched": _log(_FEATURES + " SELECT source, " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in _NAMES) + " FROM f"),
        "response_quantiles": _log("SELECT [0.05, 0.5, 0.999][k] ::DOUBLE AS share, round(q[k], 6) AS bytes FROM (SELECT quantile_cont(bytes_sent::DOUBLE, [0.05, 0.5, 0.999]) AS q FROM log WHERE bytes_sent > 0), (VALUES (1), (2), (3)) p(k)"),
        "standardize_features": _log(_FEATURES + ", m AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _NAMES) + " FROM f) SELECT source, " + ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_s > 0 THEN {c}_s ELSE 1 END, 6) AS {c}" for c in _NAMES) + " FROM f, m"),
        "union_findings": _log(_FND + f" SELECT detector, finding_type, source_ip, username, {_time('ts')}, score::INTEGER AS severity_score, severity, n::BIGINT AS count, array_to_string(evidence, '|') AS evidence FROM fs"),
        "dedup_findings": _log(_MERGED + f" SELECT finding_type, source_ip, username, {_time('ts')}, score::INTEGER AS severity_score, severity, n::BIGINT AS count, lines::INTEGER AS lines, evidence FROM merged"),
        "correlate_findings": _log(_MERGED + f" SELECT detector, finding_type, source_ip, username, {_time('ts')}, new_score AS severity_score, {_severity('new_score')} AS severity, n::BIGINT AS count, CASE WHEN k > 1 THEN ' [Corroborated by ' || k || ' detectors ' || chr(8212) || ' score boosted]' ELSE '' END AS suffix, evidence FROM raised"),
        "rank_findings": _log(_MERGED + " SELECT finding_type, source_ip, username, new_score AS severity_score FROM raised ORDER BY new_score DESC, r, rule, first_seq"),
        "severity_summary": _log(_FND + " SELECT s.severity, count(fs.severity) AS findings FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN fs USING (severity) GROUP BY 1"),
        "severity_share": _log(_FND + " SELECT s.severity, count(fs.severity) AS findings, (count(fs.severity) * 100 // (SELECT count(*) FROM fs))::INTEGER AS pct FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN fs USING (severity) GROUP BY 1"),
        "overall_risk": _log(_FND + " SELECT risk, CASE WHEN risk >= 80 THEN 'CRITICAL RISK' WHEN risk >= 60 THEN 'HIGH RISK' WHEN risk >= 35 THEN 'MEDIUM RISK' WHEN risk >= 10 THEN 'LOW RISK' ELSE 'MINIMAL RISK' END AS label FROM (SELECT least(100, sum(score * CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 70 WHEN 'MEDIUM' THEN 40 WHEN 'LOW' THEN 15 ELSE 0 END) // (100 * count(*)))::INTEGER AS risk FROM fs)"),
        "top_source_ips": _log(_FND + " SELECT source_ip, count(*) AS finding_count, max(score)::INTEGER AS max_score, string_agg(DISTINCT finding_type, ',' ORDER BY finding_type) AS finding_types FROM fs GROUP BY 1 ORDER BY max_score DESC, source_ip LIMIT 10"),
        "mitre_tags": _log(_FND + f" SELECT finding_type, count(*) AS findings, technique_id, technique_name, tactic, 'https://attack.mitre.org/techniques/' || replace(technique_id, '.', '/') || '/' AS url FROM fs JOIN (VALUES {techniques}) t(finding_type, technique_id, technique_name, tactic) USING (finding_type) GROUP BY ALL"),
        "analyse_run_apache": _hunt(_ACCESS_LOG),
        "analyse_run_syslog": _hunt(_SYSLOG_LOG),
        "finding_sentences": _sentences(),
        "forest_properties": _log(
            " SELECT n + 1 AS sources, n + 1 AS in_bounds, '6.6.6.6' AS oddest, f AS flagged, f AS scored, f AS with_lines, '6.6.6.6' AS worst, 100 AS severity_score, 'CRITICAL' AS severity"
            " FROM (SELECT count(*) AS n, ceil(0.05 * count(*))::BIGINT AS f FROM (SELECT source_ip FROM log GROUP BY 1 HAVING count(*) >= 3))"
        ),
        "runs": _log("SELECT true AS timed, 'r1' AS run_id, '2024-01-31' AS run_date, 'apache' AS log_format, count(*) AS total_lines, count(*) FILTER (seq % 50 <> 3) AS parsed_lines, count(*) FILTER (seq % 50 = 2) AS parse_errors, 'Pattern,Statistical' AS detectors FROM log"),
        "run_stats_windows": _log("SELECT 'windows_event' AS log_format, count(*) AS total_lines, count(*) FILTER (seq % 10 <> 5) AS parsed_lines, count(*) FILTER (seq % 10 IN (4, 5)) AS parse_errors FROM log"),
        "read_lines": _log("SELECT CASE seq % 50 WHEN 0 THEN '[Thu Oct 10 13:55:36 2024] [error] [pid 12] ' || message WHEN 1 THEN '[Thu Oct 10 13:55:36.123456 2024] [warn] ' || message WHEN 2 THEN 'broken ' || seq WHEN 3 THEN '' ELSE raw END AS value, count(*) AS lines FROM log GROUP BY ALL"),
        "all_detectors": _log(
            _HITS + _LARGE + _AUTH_SPIKE + _TRAVEL + _SPIKES.replace("stats AS", "stats2 AS").replace("FROM stats)", "FROM stats2)") + _PATHS.replace("stats AS", "stats3 AS").replace("FROM stats)", "FROM stats3)")
            + f" SELECT finding_type, severity, count(*) AS findings FROM (SELECT finding_type, {_severity('score')} AS severity FROM {hits_grouped} "
            + " ".join(f"UNION ALL SELECT '{kind}', {_severity('(' + score + ')')} FROM {source}" for kind, (source, score) in all_kinds.items())
            + ") GROUP BY ALL"
        ),
        "request_burst": _log(_BURST + " " + _brief("request_burst", "burst", "53", user=_NULL, count="3")),
        "request_burst_hot": _log(_BURST + f" SELECT source_ip, {_time('ts')} FROM burst"),
        "impossible_travel": _log(_TRAVEL + " " + _brief("impossible_travel", "travel", "70", "ip_a, gap::INTEGER AS delta_seconds", count="2")),
        "evidence_top5": _log("SELECT source_ip, array_to_string(list(left(raw, 200) ORDER BY seq)[1:5], '|') AS evidence FROM log GROUP BY 1"),
        "format_duration": _log("SELECT seq * 7 AS seconds, CASE WHEN seq * 7 >= 3600 THEN (seq * 7 // 3600) || 'h ' || (seq * 7 // 60 % 60) || 'm' ELSE (seq * 7 // 60) || 'm' END AS text FROM log"),
        "severity_of": _log(f"SELECT (seq % 101)::INTEGER AS score, {_severity('seq % 101')} AS severity, count(*) AS entries FROM log GROUP BY ALL"),
    }
