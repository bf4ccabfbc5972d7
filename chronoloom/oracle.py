"""DuckDB SQL of the trace queries, from the ``events`` table alone."""

from __future__ import annotations

_KINDS = ("EVENT_EMBASSY_POLL_START", "EVENT_EMBASSY_EXECUTOR_IDLE", "EVENT_EMBASSY_TASK_READY_BEGIN", "EVENT_EMBASSY_TASK_EXEC_BEGIN", "EVENT_EMBASSY_TASK_EXEC_END", "EVENT_EMBASSY_TASK_NEW", "EVENT_EMBASSY_TASK_END", "EVENT_MONITOR_START", "EVENT_MONITOR_END", "EVENT_METRIC")
_KIND = "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_KINDS)) + " END"

# The scrambled trace: k is the number of the kind above.
_SCRAMBLED = f"""
b AS (SELECT user_id AS session_id, event_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS c100 FROM events),
f0 AS (SELECT session_id, event_id AS seq, event_id * 137 + 1000 AS ts_us, CAST(c100 % 2 AS INTEGER) AS core_id,
        1073610704 + 16 * (CAST(floor(c100 / 2e0) AS BIGINT) % 3) AS eid, 1073425160 + 64 * (CAST(floor(c100 / 6e0) AS BIGINT) % 2) AS tid,
        CAST(floor(c100 / 12e0) AS BIGINT) % 10 AS k, event_type, value FROM b),
fs AS (SELECT session_id, seq, ts_us, core_id, k, {_KIND} AS kind, CASE WHEN k <= 6 THEN eid END AS executor_id, CASE WHEN k BETWEEN 2 AND 6 THEN tid END AS task_id,
        CASE WHEN k IN (7, 8) THEN 'fn_' || event_type WHEN k = 9 THEN event_type END AS name, CASE WHEN k = 9 THEN value END AS value FROM f0)"""
_F = _SCRAMBLED + """,
f AS (SELECT * FROM fs),
msg AS (SELECT *, CASE WHEN k <= 1 THEN '@' || kind || '(executor_id=' || executor_id || ', core_id=' || core_id || ')'
        WHEN k <= 6 THEN '@' || kind || '(executor_id=' || executor_id || ', core_id=' || core_id || ', task_id=' || task_id || ')'
        WHEN k <= 8 THEN '@' || kind || '(function_name=' || name || ',core_id=' || core_id || ')'
        ELSE '@' || kind || '(name=' || name || ',value=' || CAST(value AS VARCHAR) || ',core_id=' || core_id || ')' END AS message FROM f)"""
_REG = """
xr AS (SELECT session_id, core_id, executor_id, min(seq) AS first_seq, arg_min(ts_us, seq) AS first_ts_us FROM f WHERE k IN (0, 1, 3, 4, 5, 6) GROUP BY ALL),
tr AS (SELECT r.session_id, r.core_id, r.executor_id, e.task_id, min(e.seq) AS first_seq, arg_min(e.ts_us, e.seq) AS first_ts_us
       FROM xr r JOIN f e ON e.session_id = r.session_id AND e.executor_id = r.executor_id AND e.seq >= r.first_seq WHERE e.k BETWEEN 2 AND 6 GROUP BY ALL)"""
# Executors and tasks, one event of an entity at a time.
_X = """
xe AS (SELECT r.session_id, r.core_id, r.executor_id, r.first_seq, e.seq, e.ts_us, e.k, e.executor_id AS eid,
              row_number() OVER (PARTITION BY r.session_id, r.core_id, r.executor_id ORDER BY e.seq) AS n
       FROM xr r JOIN f e ON e.session_id = r.session_id AND e.seq >= r.first_seq AND e.k <= 6
        AND (e.executor_id = r.executor_id OR (e.k = 0 AND e.core_id = r.core_id) OR e.k = 1)),
xs AS (SELECT session_id, core_id, executor_id, CAST(0 AS BIGINT) AS n, first_seq AS seq, first_ts_us AS ts_us, 'Idle' AS st, CAST(NULL AS BIGINT) AS by_id, CAST(NULL AS VARCHAR) AS back, CAST(NULL AS VARCHAR) AS was
       FROM xr
       UNION ALL
       SELECT s.session_id, s.core_id, s.executor_id, e.n, e.seq, e.ts_us,
              CASE WHEN s.st = 'Idle' AND e.eid = s.executor_id AND e.k = 0 THEN 'Scheduling'
                   WHEN s.st = 'Scheduling' AND e.eid = s.executor_id AND e.k = 3 THEN 'Polling'
                   WHEN s.st = 'Scheduling' AND e.eid = s.executor_id AND e.k = 1 THEN 'Idle'
                   WHEN s.st = 'Polling' AND e.eid = s.executor_id AND e.k = 4 THEN 'Scheduling'
                   WHEN s.st IN ('Scheduling', 'Polling') AND e.eid <> s.executor_id AND e.k = 0 THEN 'Preempted'
                   WHEN s.st = 'Preempted' AND e.k = 1 AND e.eid = s.by_id THEN s.back ELSE s.st END,
              CASE WHEN s.st IN ('Scheduling', 'Polling') AND e.eid <> s.executor_id AND e.k = 0 THEN e.eid
                   WHEN s.st = 'Preempted' AND NOT (e.k = 1 AND e.eid = s.by_id) THEN s.by_id END,
              CASE WHEN s.st IN ('Scheduling', 'Polling') AND e.eid <> s.executor_id AND e.k = 0 THEN s.st
                   WHEN s.st = 'Preempted' THEN s.back END,
              CASE WHEN s.st = 'Preempted' THEN 'Preempted (by ' || s.by_id || ')' ELSE s.st END
       FROM xs s JOIN xe e ON e.session_id = s.session_id AND e.core_id = s.core_id AND e.executor_id = s.executor_id AND e.n = s.n + 1),
xl AS (SELECT *, CASE WHEN n = 0 THEN 'Created' WHEN st = 'Preempted' THEN 'Preempted (by ' || by_id || ')' ELSE st END AS label FROM xs),
xt AS (SELECT session_id, seq, ts_us, core_id, executor_id, n, st, was AS prev_label, label, by_id FROM xl WHERE n = 0 OR label <> was)"""
_T = """
te AS (SELECT r.session_id, r.core_id, r.executor_id, r.task_id, e.seq, e.ts_us, e.k, e.executor_id AS eid,
              row_number() OVER (PARTITION BY r.session_id, r.core_id, r.executor_id, r.task_id ORDER BY e.seq) AS n
       FROM tr r JOIN f e ON e.session_id = r.session_id AND e.seq >= r.first_seq AND e.k <= 6
        AND ((e.executor_id = r.executor_id AND e.task_id = r.task_id) OR (e.executor_id <> r.executor_id AND ((e.k = 0 AND e.core_id = r.core_id) OR e.k = 1)))),
ts AS (SELECT session_id, core_id, executor_id, task_id, CAST(0 AS BIGINT) AS n, first_seq AS seq, first_ts_us AS ts_us, 'Spawned' AS st, CAST(NULL AS BIGINT) AS by_id, CAST(NULL AS VARCHAR) AS was FROM tr
       UNION ALL
       SELECT s.session_id, s.core_id, s.executor_id, s.task_id, e.n, e.seq, e.ts_us,
              CASE WHEN s.st = 'Running' AND e.eid <> s.executor_id AND e.k = 0 THEN 'Preempted'
                   WHEN s.st = 'Preempted' AND e.k = 1 AND e.eid = s.by_id THEN 'Running'
                   WHEN s.st = 'Preempted' OR e.eid <> s.executor_id THEN s.st
                   WHEN s.st IN ('Spawned', 'Idle', 'Running') AND e.k = 2 THEN 'Waiting'
                   WHEN s.st = 'Waiting' AND e.k = 3 THEN 'Running'
                   WHEN s.st = 'Running' AND e.k = 4 THEN 'Idle'
                   WHEN s.st = 'Running' AND e.k = 6 THEN 'Ended' ELSE s.st END,
              CASE WHEN s.st = 'Running' AND e.eid <> s.executor_id AND e.k = 0 THEN e.eid
                   WHEN s.st = 'Preempted' AND NOT (e.k = 1 AND e.eid = s.by_id) THEN s.by_id END,
              CASE WHEN s.st = 'Preempted' THEN 'Preempted (by ' || s.by_id || ')' ELSE s.st END
       FROM ts s JOIN te e ON e.session_id = s.session_id AND e.core_id = s.core_id AND e.executor_id = s.executor_id AND e.task_id = s.task_id AND e.n = s.n + 1),
tl AS (SELECT *, CASE WHEN st = 'Preempted' THEN 'Preempted (by ' || by_id || ')' ELSE st END AS label FROM ts),
tt AS (SELECT session_id, seq, ts_us, core_id, executor_id, task_id, n, was AS prev_label, label, by_id FROM tl WHERE n = 0 OR label <> was)"""
_OCC = """
iv AS (SELECT session_id, core_id, executor_id, seq, ts_us, st, n, lead(seq) OVER (PARTITION BY session_id, core_id, executor_id ORDER BY seq, n) AS until FROM xt),
chg AS (SELECT DISTINCT session_id, core_id, seq, ts_us FROM iv),
hold AS (SELECT a.session_id, a.core_id, a.seq, a.ts_us, min(i.executor_id) FILTER (WHERE i.st IN ('Scheduling', 'Polling')) AS holder
         FROM chg a JOIN iv i ON i.session_id = a.session_id AND i.core_id = a.core_id AND i.seq <= a.seq AND (i.until IS NULL OR i.until > a.seq) GROUP BY ALL),
occ AS (SELECT * FROM (SELECT session_id, seq, ts_us, core_id, lag(holder) OVER (PARTITION BY session_id, core_id ORDER BY seq) AS prev_executor_id, holder AS executor_id FROM hold)
        WHERE prev_executor_id IS DISTINCT FROM executor_id)"""
_SPANS = """
sp AS (SELECT session_id, 'executor' AS track, core_id, executor_id, CAST(NULL AS BIGINT) AS task_id, label, by_id, ts_us, seq, n FROM xt
       UNION ALL SELECT session_id, 'task', core_id, executor_id, task_id, label, by_id, ts_us, seq, n FROM tt),
spans AS (SELECT session_id, track, core_id, executor_id, task_id, label AS name, by_id AS by_executor_id, ts_us AS start_us, lead(ts_us) OVER w AS end_us, lead(ts_us) OVER w - ts_us AS dur_us,
                 seq AS start_seq, lead(seq) OVER w AS end_seq FROM sp WINDOW w AS (PARTITION BY session_id, track, core_id, executor_id, task_id ORDER BY seq, n))"""
_MON = """
mon AS (SELECT session_id, seq, ts_us, core_id, CASE WHEN k = 7 THEN 'B' ELSE 'E' END AS ph, name FROM f WHERE k IN (7, 8)),
dep AS (SELECT *, sum(CASE WHEN ph = 'B' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id, core_id, name ORDER BY seq) AS d FROM mon),
lev AS (SELECT *, CASE WHEN ph = 'B' THEN d ELSE d + 1 END AS level FROM dep),
nxt AS (SELECT *, lead(ph) OVER w AS nph, lead(ts_us) OVER w AS nus, lead(seq) OVER w AS nseq FROM lev WINDOW w AS (PARTITION BY session_id, core_id, name, level ORDER BY seq)),
ms AS (SELECT session_id, core_id, name, CAST(level AS BIGINT) AS depth, ts_us AS start_us, CASE WHEN nph = 'E' THEN nus END AS end_us, CASE WHEN nph = 'E' THEN nus - ts_us END AS dur_us,
              seq AS start_seq, CASE WHEN nph = 'E' THEN nseq END AS end_seq FROM nxt WHERE ph = 'B')"""
# The well-formed trace: which lines there are.
_W = """
w AS (SELECT user_id AS session_id, event_id, event_type, event_id * 16 + j AS seq, event_id * 1000 + j * 10 AS ts_us, j,
             CASE WHEN j = 14 THEN 'log' WHEN j = 15 THEN 'reject' ELSE 'event' END AS route
      FROM events, range(16) t(j)
      WHERE j IN (1, 2, 3, 4, 5, 11, 12, 13) OR (j = 0 AND event_type = 'signup') OR (j BETWEEN 6 AND 10 AND event_type = 'error')
         OR (j = 14 AND event_type = 'view') OR (j = 15 AND event_type = 'click'))"""
# Events of the well-formed trace, numbered from session 1,000,000 on, beside those of the scrambled one.
_W_KINDS = (5, 2, 0, 3, 7, 9, 0, 2, 3, 4, 1, 8, 4, 1)
_W_K = "CASE j " + " ".join(f"WHEN {j} THEN {k}" for j, k in enumerate(_W_KINDS)) + " END"
_BOTH = f"""
wb AS (SELECT e.user_id + 1000000 AS session_id, e.event_id * 16 + j AS seq, e.event_id * 1000 + j * 10 AS ts_us, CAST(e.event_id % 2 AS INTEGER) AS core_id, j, {_W_K} AS k,
        1073610704 + e.event_id % 2 * 256 AS lo, 1073425160 + 64 * (CAST(round(e.value * 100) AS BIGINT) % 3) + 4096 * (e.event_id % 2) AS t1, 1073433352 + 4096 * (e.event_id % 2) AS t2, e.event_type, e.value
      FROM events e JOIN w ON w.event_id = e.event_id WHERE w.route = 'event'),
wf AS (SELECT session_id, seq, ts_us, core_id, k, {_KIND} AS kind, CASE WHEN k <= 6 THEN lo + CASE WHEN j BETWEEN 6 AND 10 THEN 16 ELSE 0 END END AS executor_id,
        CASE WHEN k BETWEEN 2 AND 6 THEN CASE WHEN j BETWEEN 6 AND 10 THEN t2 ELSE t1 END END AS task_id, CASE WHEN k IN (7, 8) THEN 'fn_' || event_type WHEN k = 9 THEN event_type END AS name,
        CASE WHEN k = 9 THEN value END AS value FROM wb)"""
_FW = _SCRAMBLED + "," + _W + "," + _BOTH + ",\nf AS (SELECT * FROM fs UNION ALL SELECT * FROM wf)"
# Names of executors and tasks, from the symbols of their session's build.
_SYM = """
sr AS (SELECT 'b' || CAST(floor(session_id / 2e0) AS BIGINT) AS build_id, CASE WHEN c100 % 7 = 0 THEN 0 ELSE 1073610704 + 16 * x END AS address,
              CASE WHEN c100 % 5 = 0 OR x > 1 THEN '' ELSE 'app::executor_' || event_type || '::POOL::h' || event_id END AS symbol, event_id * 2 AS ord
       FROM (SELECT *, CAST(floor(c100 / 2e0) AS BIGINT) % 3 AS x FROM b)
       UNION ALL
       SELECT 'b' || CAST(floor(session_id / 2e0) AS BIGINT), CASE WHEN c100 % 7 = 0 THEN 0 ELSE 1073425160 + 64 * t END,
              CASE WHEN c100 % 5 = 0 OR t > 0 THEN '' ELSE 'app::task_' || event_type || '::POOL::h' || event_id END, event_id * 2 + 1
       FROM (SELECT *, CAST(floor(c100 / 6e0) AS BIGINT) % 2 AS t FROM b)),
sy AS (SELECT build_id, address, arg_max(symbol, ord) AS symbol FROM sr WHERE address <> 0 AND symbol <> '' GROUP BY ALL),
xn AS (SELECT r.*, coalesce(split_part(s.symbol, '::POOL', 1), 'Executor 0x' || printf('%X', r.executor_id)) AS shown
       FROM xr r LEFT JOIN sy s ON s.build_id = 'b' || CAST(floor(r.session_id % 1000000 / 2e0) AS BIGINT) AND s.address = r.executor_id),
tn AS (SELECT r.*, coalesce(split_part(s.symbol, '::POOL', 1), 'Task 0x' || printf('%X', r.task_id)) AS shown
       FROM tr r LEFT JOIN sy s ON s.build_id = 'b' || CAST(floor(r.session_id % 1000000 / 2e0) AS BIGINT) AND s.address = r.task_id)"""
# Every record, with the columns that order those of one event: stage, core, part of the core's step, executor, place in it, task, end before begin.
_REC = """
rec AS (
  SELECT session_id, min(seq) AS seq, -6 AS stage, 0 AS core, 0 AS part, 0 AS x, 0 AS place, 0 AS t, 0 AS side, 'M' AS ph, 'process_name' AS name, CAST(NULL AS VARCHAR) AS cat, CAST(NULL AS BIGINT) AS ts,
         CAST(0 AS BIGINT) AS pid, CAST(NULL AS BIGINT) AS tid, CAST(NULL AS VARCHAR) AS s, '{"name":"CORE OVERVIEW"}' AS args, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS cname FROM f GROUP BY session_id
  UNION ALL SELECT session_id, min(seq), -5, core_id, 0, 0, 0, 0, 0, 'M', 'thread_name', NULL, NULL, 0, core_id, NULL, '{"name":"CORE ' || core_id || '","core":"' || core_id || '"}', NULL, NULL FROM f GROUP BY session_id, core_id
  UNION ALL SELECT session_id, first_seq, -4, core_id, 0, 0, 0, 0, 0, 'M', 'process_name', NULL, NULL, executor_id, NULL, NULL, '{"name":"[CORE ' || core_id || '] ' || shown || '","core":"' || core_id || '"}', NULL, NULL FROM xn
  UNION ALL SELECT session_id, first_seq, -3, core_id, 0, 0, 0, 0, 0, 'M', 'thread_name', NULL, NULL, executor_id, NULL, NULL, '{"name":"Executor","core":"' || core_id || '"}', NULL, NULL FROM xn
  UNION ALL SELECT session_id, first_seq, -2, core_id, 0, 0, 0, 0, 0, 'M', 'thread_name', NULL, NULL, executor_id, task_id, NULL, '{"name":"' || shown || '"}', NULL, NULL FROM tn
  UNION ALL SELECT session_id, seq, 0, core_id, CASE WHEN n = 0 THEN 0 ELSE 1 END, executor_id, 2, 0, 0, 'E', NULL, NULL, ts_us, executor_id, NULL, NULL, NULL, NULL, NULL FROM xt WHERE n > 0
  UNION ALL SELECT session_id, seq, 0, core_id, CASE WHEN n = 0 THEN 0 ELSE 1 END, executor_id, 2, 0, 1, 'B', label, NULL, ts_us, executor_id, NULL, NULL, NULL, NULL, NULL FROM xt
  UNION ALL SELECT session_id, seq, 0, core_id, 1, executor_id, 1, task_id, 0, 'E', NULL, NULL, ts_us, executor_id, task_id, NULL, NULL, NULL, NULL FROM tt WHERE n > 0
  UNION ALL SELECT session_id, seq, 0, core_id, 1, executor_id, CASE WHEN n = 0 THEN 0 ELSE 1 END, task_id, 1, 'B', label, NULL, ts_us, executor_id, task_id, NULL, NULL, NULL, NULL FROM tt
  UNION ALL SELECT o.session_id, o.seq, 0, o.core_id, 2, 0, 0, 0, 0, 'E', x.shown, 'executor', o.ts_us, 0, o.core_id, NULL, NULL, NULL, NULL
            FROM occ o JOIN xn x ON x.session_id = o.session_id AND x.core_id = o.core_id AND x.executor_id = o.prev_executor_id
  UNION ALL SELECT o.session_id, o.seq, 0, o.core_id, 2, 0, 0, 0, 1, 'B', x.shown, 'executor', o.ts_us, 0, o.core_id, NULL, NULL, NULL, NULL
            FROM occ o JOIN xn x ON x.session_id = o.session_id AND x.core_id = o.core_id AND x.executor_id = o.executor_id
  UNION ALL SELECT session_id, seq, 1, 0, 0, 0, 0, 0, 0, CASE WHEN k = 7 THEN 'B' ELSE 'E' END, name, 'function_monitor', ts_us, 0, core_id, NULL, NULL, NULL, NULL FROM f WHERE k IN (7, 8)
  UNION ALL SELECT m.session_id, m.seq, 1, 0, 0, 0, 0, 0, 0, 'C', any_value(m.name), NULL, any_value(m.ts_us), min(i.executor_id), NULL, NULL, NULL, any_value(m.value), NULL
            FROM f m LEFT JOIN iv i ON i.session_id = m.session_id AND i.core_id = m.core_id AND i.st = 'Polling' AND i.seq <= m.seq AND (i.until IS NULL OR i.until > m.seq) WHERE m.k = 9 GROUP BY m.session_id, m.seq
  UNION ALL SELECT session_id + 1000000, seq, 0, 0, 0, 0, 0, 0, 0, 'i', 'Hello, world! ' || event_id, 'WARN', ts_us, NULL, NULL, 'g', '{"level":"WARN"}', NULL, 'terrible' FROM w WHERE route = 'log'),
num AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq, stage, core, part, x, place, t, side) - 1 AS BIGINT) AS n, ph, name, cat, ts, pid, tid, s, args, value, cname FROM rec)"""
_DOC = """
js AS (SELECT session_id, n, '{"ph":"' || ph || '"' || coalesce(',"name":"' || name || '"', '') || coalesce(',"cat":"' || cat || '"', '') || coalesce(',"ts":' || ts, '') || coalesce(',"pid":' || pid, '')
              || coalesce(',"tid":' || tid, '') || coalesce(',"s":"' || s || '"', '') || coalesce(',"cname":"' || cname || '"', '') || coalesce(',"args":' || args, '')
              || CASE WHEN ph = 'C' THEN ',"args":{"value":' || CAST(value AS VARCHAR) || '}' ELSE '' END || '}' AS json, max(n) OVER (PARTITION BY session_id) AS last FROM num)"""


def _sql(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


_TRACE = (_F, _REG, _X)
SQL: dict[str, str] = {
    "render_event_lines": _sql("SELECT session_id, seq, printf('%.6f [INFO ] %s', ts_us / 1e6, message) AS line FROM msg", _F),
    "parse_log_lines": _sql("SELECT session_id, seq, ts_us, 'INFO' AS level, message FROM msg", _F),
    "parse_params": _sql(
        "SELECT session_id, seq, CASE WHEN k <= 1 THEN 2 WHEN k <= 6 THEN 3 WHEN k <= 8 THEN 2 ELSE 3 END AS n_params, CAST(executor_id AS VARCHAR) AS executor_id, CAST(core_id AS VARCHAR) AS core_id, CASE WHEN k IN (7, 8) THEN name END AS function_name FROM f",
        _F,
    ),
    "decode_event": _sql("SELECT session_id, seq, ts_us, core_id, kind, executor_id, task_id, name, value FROM f", _F),
    "route_lines": _sql("SELECT session_id, route, count(*) AS n FROM w GROUP BY ALL", _W),
    "reject_reason": _sql("SELECT session_id, seq, 'no brackets here ' || event_id AS line, 'no opening bracket' AS reason FROM w WHERE route = 'reject'", _W),
    "format_lines": _sql("SELECT session_id, seq, printf('%.6f [WARN] Hello, world! %d', ts_us / 1e6, event_id) AS line FROM w WHERE route = 'log'", _W),
    "core_registry": _sql("SELECT session_id, core_id, min(seq) AS first_seq, arg_min(ts_us, seq) AS first_ts_us FROM f GROUP BY ALL", _F),
    "executor_registry": _sql("SELECT * FROM xr", _F, _REG),
    "task_registry": _sql("SELECT * FROM tr", _F, _REG),
    "load_symbols": _sql("SELECT build_id, address, symbol FROM sy", _F, _REG, _SYM),
    "resolve_symbols": _sql("SELECT session_id, core_id, executor_id, shown AS display_name FROM xn", _F, _REG, _SYM),
    "route_events_to_cores": _sql(
        "SELECT e.session_id, e.seq, e.kind, r.core_id AS target_core FROM f e JOIN xr r ON e.session_id = r.session_id AND e.executor_id = r.executor_id AND e.seq >= r.first_seq UNION ALL SELECT session_id, seq, kind, core_id FROM f WHERE k >= 7",
        _F, _REG,
    ),
    "executor_transitions": _sql("SELECT session_id, seq, ts_us, core_id, executor_id, prev_label, label, by_id AS by_executor_id FROM xt WHERE n > 0", *_TRACE),
    "task_transitions": _sql("SELECT session_id, seq, ts_us, core_id, executor_id, task_id, prev_label, label, by_id AS by_executor_id FROM tt WHERE n > 0", _F, _REG, _T),
    "core_occupancy": _sql("SELECT session_id, seq, ts_us, core_id, prev_executor_id, executor_id FROM occ", *_TRACE, _OCC),
    "attribute_metrics": _sql(
        "SELECT m.session_id, m.seq, m.ts_us, m.core_id, m.name, m.value, min(i.executor_id) AS pid FROM f m LEFT JOIN iv i ON i.session_id = m.session_id AND i.core_id = m.core_id AND i.st = 'Polling' AND i.seq <= m.seq AND (i.until IS NULL OR i.until > m.seq) WHERE m.k = 9 GROUP BY ALL",
        *_TRACE, _OCC,
    ),
    "state_spans": _sql("SELECT * FROM spans", *_TRACE, _T, _SPANS),
    "monitor_events": _sql("SELECT * FROM mon", _F, _MON),
    "monitor_spans": _sql("SELECT * FROM ms", _F, _MON),
    "metric_counters": _sql("SELECT session_id, seq, ts_us, core_id, name, value FROM f WHERE k = 9", _F),
    "log_instants": _sql(
        """SELECT session_id, seq, '{"ph":"i","name":"Hello, world! ' || event_id || '","cat":"WARN","ts":' || ts_us || ',"s":"g","cname":"terrible","args":{"level":"WARN"}}' AS json FROM w WHERE route = 'log'""", _W
    ),
    "trace_metadata": _sql(
        """SELECT session_id, min(seq) AS seq, 'process_name' AS name, 0 AS pid, CAST(NULL AS BIGINT) AS tid, 'CORE OVERVIEW' AS label FROM f GROUP BY session_id
        UNION ALL SELECT session_id, min(seq), 'thread_name', 0, core_id, 'CORE ' || core_id FROM f GROUP BY session_id, core_id
        UNION ALL SELECT session_id, first_seq, 'process_name', executor_id, NULL, '[CORE ' || core_id || '] ' || shown FROM xn
        UNION ALL SELECT session_id, first_seq, 'thread_name', executor_id, NULL, 'Executor' FROM xn
        UNION ALL SELECT session_id, first_seq, 'thread_name', executor_id, task_id, shown FROM tn""",
        _F, _REG, _SYM,
    ),
    "trace_events": _sql("SELECT * FROM num", _FW, _REG, _X, _T, _OCC, _SYM, _REC),
    "write_trace_json": _sql(
        """SELECT session_id, CAST(0 AS BIGINT) AS seq, '{"traceEvents": [' AS line FROM num WHERE n = 0
        UNION ALL SELECT session_id, n + 1, chr(9) || json || CASE WHEN n = last THEN '' ELSE ',' END FROM js
        UNION ALL SELECT session_id, last + 2, ']}' FROM js WHERE n = last""",
        _FW, _REG, _X, _T, _OCC, _SYM, _REC, _DOC,
    ),
    "complete_spans": _sql(
        """SELECT session_id, start_seq AS seq, '{"ph":"X","name":"' || name || '","cat":"' || track || '","ts":' || start_us || ',"dur":' || dur_us || ',"pid":' || executor_id || coalesce(',"tid":' || task_id, '') || '}' AS json
        FROM spans WHERE end_us IS NOT NULL""",
        *_TRACE, _T, _SPANS,
    ),
    "passthrough": _sql("SELECT session_id, seq, CASE WHEN route = 'log' THEN printf('%.6f [WARN] Hello, world! %d', ts_us / 1e6, event_id) ELSE 'no brackets here ' || event_id END AS text FROM w WHERE route <> 'event'", _W),
    "write_tables": _sql("SELECT CASE WHEN route = 'log' THEN 'lines' ELSE 'events' END AS name, session_id, seq, ts_us FROM w WHERE route <> 'reject'", _W),
    "stream_route": _sql("SELECT session_id, seq, route FROM w", _W),
    "read_logs": _sql("SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq, printf('%.6f [INFO ] %s', ts_us / 1e6, message) AS line FROM msg", _F),
    "stream_trace": _sql("SELECT session_id, seq, ts_us, core_id, executor_id, prev_label, label, by_id AS by_executor_id FROM xt WHERE n > 0", *_TRACE),
    "state_durations": _sql("SELECT session_id, core_id, track, executor_id, task_id, name, sum(dur_us) AS total_us, count(*) AS n, max(dur_us) AS max_us FROM spans WHERE dur_us IS NOT NULL GROUP BY ALL", *_TRACE, _T, _SPANS),
    "core_utilization": _sql(
        """SELECT o.session_id, o.core_id, CAST(coalesce(sum(o.dur_us), 0) AS BIGINT) AS busy_us, any_value(s.span_us) AS span_us, CASE WHEN any_value(s.span_us) > 0 THEN coalesce(sum(o.dur_us), 0) / any_value(s.span_us) END AS busy_share
        FROM (SELECT *, lead(ts_us) OVER (PARTITION BY session_id, core_id ORDER BY seq) - ts_us AS dur_us FROM occ) o
        JOIN (SELECT session_id, max(ts_us) - min(ts_us) AS span_us FROM f GROUP BY session_id) s ON s.session_id = o.session_id WHERE o.executor_id IS NOT NULL GROUP BY o.session_id, o.core_id""",
        *_TRACE, _OCC,
    ),
    "function_stats": _sql("SELECT name, count(*) AS n, avg(dur_us) AS mean_us, quantile_disc(dur_us, 0.5) AS p50_us, quantile_disc(dur_us, 0.95) AS p95_us, max(dur_us) AS max_us FROM ms WHERE dur_us IS NOT NULL GROUP BY name", _F, _MON),
    "preemption_matrix": _sql("SELECT executor_id, by_executor_id, count(*) AS n, CAST(coalesce(sum(dur_us), 0) AS BIGINT) AS total_us FROM spans WHERE track = 'executor' AND name LIKE 'Preempted%' GROUP BY ALL", *_TRACE, _T, _SPANS),
    "metric_windows": _sql("SELECT ts_us // 100000 * 100000 AS start_us, name, count(*) AS n, min(value) AS min_value, avg(value) AS mean_value, max(value) AS max_value FROM f WHERE k = 9 GROUP BY ALL", _F),
    "trace_quality": _sql("SELECT 'reject: no opening bracket' AS issue, count(*) AS n FROM w WHERE route = 'reject' GROUP BY issue HAVING count(*) > 0", _W),
}
SQL["stream_counters"] = SQL["attribute_metrics"]
SQL["write_trace_parts"] = SQL["write_trace_json"]
# The trace with the sessions of every second user run together.
for _name, _of in (("replay_in_blocks", "executor_transitions"), ("tasks_in_blocks", "task_transitions"), ("route_in_blocks", "route_events_to_cores"), ("monitor_spans_in_blocks", "monitor_spans")):
    SQL[_name] = SQL[_of].replace("user_id AS session_id", "CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS session_id", 1)
SQL |= {"stream_trace_unordered": SQL["stream_trace"], "stream_trace_events": SQL["trace_events"], "stream_text_logs": SQL["read_logs"], "stream_passthrough": SQL["passthrough"], "stream_stop": SQL["stream_route"]}
