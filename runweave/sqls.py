"""SQL that DuckDB can run for the registered queries, and the queries that are passed through."""

from __future__ import annotations

from runweave.sources.fixtures import FENCED, LIFECYCLES, LLM_CALLS, LLM_CALLS_BIG, RUN_EVENTS, TOOL_LOG

#: Statements of the read-only pass-through; they run unchanged in both engines.
READONLY = {
    "readonly_sql_join": """
        SELECT n_name AS nation, count(DISTINCT o_orderkey) AS orders, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_shipdate > o_orderdate GROUP BY n_name""",
    "readonly_sql_semi_anti": """
        SELECT c_custkey AS custkey FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
    "readonly_sql_left_join": """
        SELECT p_partkey AS partkey, count(l_orderkey) AS lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY p_partkey""",
    "readonly_sql_range_join": """
        SELECT a.event_id AS event_id, count(*) AS followers FROM events a JOIN events b
        ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 500 GROUP BY a.event_id""",
    "readonly_sql_window": """
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
               count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent,
               lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events""",
    "readonly_sql_rollup": """
        SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "readonly_sql_cube": """
        SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "readonly_sql_set_ops": """
        (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
        EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    "readonly_sql_union": """
        SELECT 'order' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'line', count(*) FROM lineitem UNION ALL SELECT 'event', count(*) FROM events""",
    "readonly_sql_top": """
        SELECT l_suppkey AS suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, suppkey LIMIT 10""",
}

_TERMINAL = "('run.succeeded', 'run.failed', 'run.cancelled')"
_STATES = """,
life AS (SELECT run_id, seq, event_type, row_number() OVER (PARTITION BY run_id ORDER BY seq, event_type) AS k FROM {log} WHERE event_type LIKE 'run.%'),
any_event AS (SELECT run_id, seq, event_type, row_number() OVER (PARTITION BY run_id ORDER BY seq, event_type) AS k, max(seq) OVER (PARTITION BY run_id) AS last_seq FROM {log}),
first_event AS (SELECT run_id, seq AS s0, event_type AS t0, last_seq FROM any_event WHERE k = 1),
steps AS (SELECT f.run_id, s0, t0, last_seq,
  max(CASE WHEN k = 1 THEN seq END) AS s1, max(CASE WHEN k = 2 THEN seq END) AS s2, max(CASE WHEN k = 3 THEN seq END) AS s3, max(CASE WHEN k = 4 THEN seq END) AS s4,
  max(CASE WHEN k = 2 THEN event_type END) AS t2, max(CASE WHEN k = 3 THEN event_type END) AS t3
  FROM first_event f LEFT JOIN life l ON l.run_id = f.run_id GROUP BY ALL),
good AS (SELECT *, coalesce(t2 IN ('run.started', 'run.cancelled') AND s2 > s1, false) AS ok2,
  coalesce(t2 = 'run.started' AND s2 > s1 AND t3 IN ('run.succeeded', 'run.failed', 'run.cancelled') AND s3 > s2, false) AS ok3 FROM steps),
states AS (SELECT run_id, last_seq,
  CASE WHEN t0 <> 'run.created' THEN NULL WHEN ok3 THEN substr(t3, 5) WHEN ok2 THEN CASE WHEN t2 = 'run.started' THEN 'running' ELSE 'cancelled' END ELSE 'pending' END AS status,
  CASE WHEN t0 <> 'run.created' THEN NULL WHEN ok3 THEN s3 WHEN ok2 THEN s2 ELSE s1 END AS last_lifecycle_seq,
  CASE WHEN t0 <> 'run.created' THEN s0 WHEN ok3 THEN s4 WHEN ok2 THEN s3 ELSE s2 END AS illegal_seq FROM good)
"""
_RUNS = RUN_EVENTS + _STATES.format(log="run_events")
_RAW = LIFECYCLES + _STATES.format(log="lifecycles")

_EDGES = """
declared AS (SELECT run_id, CAST(unnest(split(deps, ',')) AS BIGINT) AS from_node, node_id AS to_node, 'dependency' AS edge_type, seq FROM {log} WHERE event_type = 'node.added' AND deps IS NOT NULL),
edges AS (SELECT * FROM declared UNION ALL SELECT run_id, from_node, to_node, edge_type, seq FROM {log} WHERE event_type = 'edge.added'),
waits AS (SELECT DISTINCT run_id, from_node, to_node FROM edges WHERE edge_type = 'dependency')
"""
_NODES = """,
nodes AS (SELECT run_id, node_id, min(seq) FILTER (WHERE event_type = 'node.added') AS added_seq,
  CASE max_by(event_type, seq) WHEN 'node.added' THEN 'pending' WHEN 'node.started' THEN 'running' ELSE substr(max_by(event_type, seq), 6) END AS status,
  coalesce(max_by(attempt, seq) FILTER (WHERE event_type IN ('node.started', 'node.failed')), 0) AS attempt,
  max_by(attempt, seq) FILTER (WHERE event_type = 'node.failed') AS failed_attempt,
  max_by(role, seq) FILTER (WHERE event_type = 'node.added') AS role, max_by(reflection_depth, seq) FILTER (WHERE event_type = 'node.added') AS reflection_depth,
  max_by(output, seq) FILTER (WHERE event_type = 'node.succeeded') AS output, max_by(error_class, seq) FILTER (WHERE event_type = 'node.failed') AS error_class,
  max_by(message, seq) FILTER (WHERE event_type = 'node.failed') AS error_message
  FROM {log} WHERE node_id IS NOT NULL GROUP BY run_id, node_id),
""" + _EDGES.strip() + """,
ready AS (SELECT n.run_id, n.node_id, n.attempt FROM nodes n WHERE n.status = 'pending' AND NOT EXISTS (
  SELECT 1 FROM waits e JOIN nodes m ON m.run_id = e.run_id AND m.node_id = e.from_node WHERE e.run_id = n.run_id AND e.to_node = n.node_id AND m.status <> 'succeeded'))
"""
_DAG = RUN_EVENTS + _NODES.format(log="run_events")

_PRICED = LLM_CALLS + """,
ledger AS (SELECT c.*, CAST((CAST(input_tokens AS DECIMAL(12,0)) * p_in + CAST(output_tokens AS DECIMAL(12,0)) * p_out) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(20,10)) AS cost_usd
  FROM llm_calls c JOIN (VALUES ('alpha', 'large', CAST(3 AS DECIMAL(8,2)), CAST(15 AS DECIMAL(8,2))), ('beta', 'medium', 2.5, 10), ('local', 'echo', 0, 0)) p(provider, model, p_in, p_out)
  ON c.provider = p.provider AND c.model = p.model WHERE role = 'assistant')
"""
_SUMS = "CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(20,10)) AS cost_usd, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens, count(*) AS calls"

_PAYLOADS = """
WITH v AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 51 = 0 THEN 3 ELSE 1 + event_id % 2 END AS version, event_id % 50 = 0 AS extra,
  CASE WHEN event_id % 53 = 0 THEN 'empty' WHEN event_id % 59 = 0 THEN 'nested' WHEN event_id % 61 = 0 OR event_id % 67 = 0 THEN 'broken' ELSE 'whole' END AS shape FROM events),
p AS (SELECT *, CASE WHEN event_type = 'click' THEN 'unknown_type' WHEN version > 2 THEN 'future_version' WHEN shape = 'broken' THEN 'invalid_json' WHEN extra AND shape = 'whole' THEN 'unknown_field'
  WHEN shape = 'empty' THEN 'missing_field' WHEN shape = 'nested' THEN 'wrong_type' ELSE 'ok' END AS decode_error FROM v)
"""

_SNAPSHOTS = """,
due_at AS (SELECT run_id, seq AS at_seq FROM run_events WHERE seq % {every} = 0),
snaps AS (SELECT a.run_id, a.at_seq, max_by(r.event_type, r.seq) AS t, max(r.seq) AS last_lifecycle_seq FROM due_at a JOIN run_events r ON r.run_id = a.run_id AND r.seq <= a.at_seq AND r.event_type LIKE 'run.%' GROUP BY a.run_id, a.at_seq),
snapshots AS (SELECT run_id, at_seq, CASE t WHEN 'run.created' THEN 'pending' WHEN 'run.started' THEN 'running' ELSE substr(t, 5) END AS status, last_lifecycle_seq FROM snaps)
"""
_SIXTHS, _SNAPSHOTS = RUN_EVENTS + _SNAPSHOTS.format(every=6), RUN_EVENTS + _SNAPSHOTS.format(every=4)

_TOOLS = TOOL_LOG + """,
keys AS (SELECT idempotency_key, max_by(tool, seq) FILTER (WHERE event_type = 'tool.requested') AS tool, bool_or(event_type = 'tool.requested') AS requested, bool_or(event_type = 'tool.completed') AS completed,
  bool_or(event_type = 'tool.failed') AS failed, bool_or(event_type = 'tool.indeterminate') AS indeterminate,
  max_by(result, seq) FILTER (WHERE event_type = 'tool.completed') AS result FROM tool_log GROUP BY idempotency_key),
outcomes AS (SELECT idempotency_key, tool, CASE WHEN completed THEN 'reused' WHEN indeterminate THEN 'indeterminate' WHEN failed THEN 'failed'
  WHEN requested THEN CASE WHEN tool = 't0' THEN 'redispatch' ELSE 'mark_indeterminate' END ELSE 'fresh' END AS outcome FROM keys)
"""

_FAILURES = RUN_EVENTS + """,
failures AS (SELECT run_id, node_id, attempt, error_class FROM run_events WHERE event_type = 'node.failed')
"""

_WALK = RUN_EVENTS.replace("WITH n AS", "WITH RECURSIVE n AS", 1) + "," + _EDGES.format(log="run_events") + """,
ways AS (SELECT run_id, from_node, to_node FROM waits UNION SELECT w.run_id, w.from_node, e.to_node FROM ways w JOIN waits e ON e.run_id = w.run_id AND e.from_node = w.to_node),
longest AS (SELECT DISTINCT run_id, node_id, CAST(0 AS BIGINT) AS level FROM run_events r WHERE event_type = 'node.added' AND NOT EXISTS (SELECT 1 FROM waits w WHERE w.run_id = r.run_id AND w.to_node = r.node_id)
  UNION SELECT l.run_id, e.to_node, l.level + 1 FROM longest l JOIN waits e ON e.run_id = l.run_id AND e.from_node = l.node_id)
"""

_ODD = """WITH odd AS (SELECT user_id AS run_id, event_id % 11 AS node_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'node.added' WHEN event_type = 'error' THEN 'edge.added' ELSE 'node.started' END AS event_type FROM events),
named AS (SELECT run_id, node_id, seq FROM odd WHERE event_type <> 'node.added' UNION ALL SELECT run_id, (seq + 5) % 11, seq FROM odd WHERE event_type = 'edge.added'
  UNION ALL SELECT run_id, (seq + 3) % 11, seq FROM odd WHERE event_type = 'node.added')"""

_SPAWNS = "WITH s AS (SELECT conv_id AS run_id, turn AS node_id, turn % 5 AS depth, length(text) % 3 AS children FROM conversations WHERE role = 'assistant')"

_PROPOSALS = """WITH p AS (SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS round, length(text) % 20 AS value FROM conversations WHERE role = 'assistant'),
c AS (SELECT key, round, value >= 5 AND value % 2 = 0 AS ok, concat_ws(',', CASE WHEN value < 5 THEN 'too_small' END, CASE WHEN value % 2 <> 0 THEN 'odd' END) AS violations FROM p)"""

_PAGES = r"""WITH pg AS (SELECT page_id, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host FROM pages),
ok AS (SELECT page_id, html, host, host IN (SELECT host FROM pg WHERE page_id < 20) AS allowed FROM pg)"""

_MONTHS = "WITH m AS (SELECT o_orderkey AS run_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS partition_key FROM orders)"

ORACLE_SQL = READONLY | {
    "event_replay": RUN_EVENTS + "SELECT run_id, seq, event_type FROM run_events WHERE seq > 1 AND seq <= 6",
    "event_append_and_read": RUN_EVENTS + "SELECT run_id, count(*) AS events, max(seq) AS last_seq FROM run_events WHERE date_trunc('month', t0) = DATE '1995-03-01' GROUP BY run_id",
    "batch_seq_assignment": RUN_EVENTS + """SELECT l.run_id, l.l_returnflag, coalesce(m.last, 0) + row_number() OVER (PARTITION BY l.run_id ORDER BY l.l_returnflag) AS seq
        FROM (SELECT DISTINCT l_orderkey AS run_id, l_returnflag FROM lineitem) l LEFT JOIN (SELECT run_id, max(seq) AS last FROM run_events GROUP BY run_id) m ON m.run_id = l.run_id""",
    "event_conflicts": RUN_EVENTS + """SELECT a.run_id, max(a.seq + a.run_id % 9) AS seq FROM run_events a JOIN run_events b ON a.run_id = b.run_id AND b.seq = a.seq + a.run_id % 9
        WHERE a.event_type = 'run.started' GROUP BY a.run_id""",
    "decode_events": _PAYLOADS + "SELECT event_id, event_type, k, CASE WHEN version = 1 THEN 0 ELSE 5 END AS n FROM p WHERE decode_error = 'ok'",
    "decode_quarantine": _PAYLOADS + "SELECT decode_error, count(*) AS n FROM p GROUP BY decode_error",
    "upcast_payload": _PAYLOADS + "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, CAST(0 AS BIGINT) AS sum_count FROM p WHERE decode_error = 'ok' AND version = 1 GROUP BY event_type",
    "payload_unknown_fields": _PAYLOADS + "SELECT event_id, 'extra' AS unknown_field FROM p WHERE decode_error = 'unknown_field'",
    "event_current_version": "SELECT event_type, CASE WHEN event_type <> 'click' THEN CAST(2 AS BIGINT) END AS version, count(*) AS n FROM events GROUP BY event_type",
    "event_schema_catalog": """SELECT t AS event_type, CAST(2 AS BIGINT) AS version, f AS field, 'bigint' AS type, (SELECT count(*) FROM events WHERE event_type = t) AS n
        FROM (VALUES ('signup'), ('view'), ('purchase'), ('error')) a(t), (VALUES ('k'), ('count')) b(f)""",
    "stream_bounded_window": RUN_EVENTS + "SELECT run_id, seq, event_type FROM run_events QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 5",
    "stream_tail": RUN_EVENTS + "SELECT event_type, count(*) AS n, CAST(sum(seq) AS BIGINT) AS sum_seq FROM run_events WHERE seq > 3 GROUP BY event_type",
    "stream_run_state": RUN_EVENTS + "SELECT run_id, max(seq) AS last_seq, max_by(event_type, seq) FILTER (WHERE event_type LIKE 'run.%') AS last_lifecycle FROM run_events GROUP BY run_id",
    "subscribe_events": RUN_EVENTS + """, t AS (SELECT run_id, min(seq) AS e FROM run_events WHERE event_type IN ('run.succeeded', 'run.failed', 'run.cancelled') GROUP BY run_id)
        SELECT r.run_id, count(*) AS n, max(seq) AS last_seq FROM run_events r LEFT JOIN t ON t.run_id = r.run_id WHERE seq > 2 AND (e IS NULL OR seq <= e) GROUP BY r.run_id""",
    "partition_month": _MONTHS + "SELECT partition_key, count(*) AS runs, min(run_id) AS first_run FROM m GROUP BY partition_key",
    "retention_partitions": _MONTHS + "SELECT partition_key, count(*) AS runs FROM m WHERE partition_key < (SELECT max(partition_key) FROM m) - INTERVAL 12 MONTH GROUP BY partition_key",
    "unprovisioned_partitions": _MONTHS + "SELECT partition_key, count(*) AS runs FROM m WHERE partition_key > (SELECT min(partition_key) FROM m) + INTERVAL 12 MONTH GROUP BY partition_key",
    "uuid7_encode": """SELECT event_id, CAST(36 AS BIGINT) AS length, substr(h, 1, 8) || '-' || substr(h, 9, 4) AS time_part, '7' AS version, true AS variant_ok
        FROM (SELECT event_id, lpad(lower(to_hex(1704067200000 + event_id * 1009)), 12, '0') AS h FROM events)""",
    "uuid7_decode": "SELECT event_id, 1704067200000 + event_id * 1009 AS millis FROM events",
    "tenant_isolation": RUN_EVENTS + "SELECT tenant_id, event_type, count(*) AS n FROM run_events WHERE tenant_id = 3 GROUP BY tenant_id, event_type",
    "tenant_unset": RUN_EVENTS + "SELECT tenant_id, count(*) AS n FROM run_events WHERE tenant_id = NULL GROUP BY tenant_id",
    "tenant_write_violations": "SELECT o_orderkey % 16 AS writer, count(*) AS n FROM orders WHERE o_custkey % 16 <> o_orderkey % 16 GROUP BY writer",
    "tenant_ownership": "SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 16 = 5)",
    "run_state_fold": _RUNS + """SELECT o_custkey % 16 AS tenant_id, status, count(*) AS runs, CAST(sum(last_seq) AS BIGINT) AS events FROM states JOIN orders ON o_orderkey = run_id GROUP BY o_custkey % 16, status""",
    "run_states_of_raw_logs": _RAW + "SELECT run_id, status, last_seq, last_lifecycle_seq, illegal_seq FROM states",
    "run_transitions": _RUNS + """SELECT CASE WHEN b IS NULL THEN 'none' WHEN b = 'run.created' THEN 'pending' WHEN b = 'run.started' THEN 'running' ELSE substr(b, 5) END AS from_status, event_type, count(*) AS n
        FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM life) GROUP BY ALL""",
    "run_terminal_counts": _RUNS + "SELECT status IN ('succeeded', 'failed', 'cancelled') AS terminal, count(*) AS n FROM states GROUP BY terminal",
    "run_invalid_transitions": _RAW + """SELECT s.run_id, s.illegal_seq AS seq, s.status, string_agg(DISTINCT l.event_type, ',' ORDER BY l.event_type) AS event_types
        FROM states s JOIN lifecycles l ON l.run_id = s.run_id AND l.seq = s.illegal_seq GROUP BY ALL""",
    "duplicate_runs": LIFECYCLES + "SELECT run_id, count(*) AS created FROM lifecycles WHERE event_type = 'run.created' GROUP BY run_id HAVING count(*) > 1",
    "runs_projection": _RUNS + "SELECT run_id, status, last_seq FROM states",
    "run_status_view": _RUNS + "SELECT run_id, status, last_lifecycle_seq FROM states",
    "run_states": _RUNS + """SELECT s.run_id, s.status, s.last_seq, s.last_lifecycle_seq, c.input, c.occurred_at AS created_at, b.worker, b.occurred_at AS started_at, e.occurred_at AS finished_at,
        e.result, e.error_class, e.message AS error_message, e.reason AS cancel_reason FROM states s JOIN run_events c ON c.run_id = s.run_id AND c.event_type = 'run.created'
        LEFT JOIN run_events b ON b.run_id = s.run_id AND b.event_type = 'run.started' LEFT JOIN run_events e ON e.run_id = s.run_id AND e.event_type IN """ + _TERMINAL,
    "find_pending": """SELECT tenant_id, run_id FROM (SELECT o_orderkey AS run_id, o_custkey % 16 AS tenant_id, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderdate, o_orderkey) AS k
        FROM orders WHERE o_orderstatus = 'O' AND (o_orderkey % 3 = 0 OR o_orderkey % 7 < 3)) WHERE k = 1""",
    "cancel_requested": "SELECT user_id, bool_or(event_type = 'error' AND value > 90) AS cancel_requested FROM events GROUP BY user_id",
    "lease_acquisition": """
        WITH RECURSIVE a AS (SELECT user_id AS run_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS t, event_type AS worker,
            CASE WHEN event_id % 2 = 0 THEN 300000000 ELSE 86400000000 END AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        s AS (SELECT run_id, k, CAST(1 AS BIGINT) AS token, worker AS owner, t + ttl AS until_micros FROM a WHERE k = 1
          UNION ALL SELECT a.run_id, a.k, CASE WHEN s.until_micros < a.t THEN s.token + 1 ELSE s.token END, CASE WHEN s.until_micros < a.t THEN a.worker ELSE s.owner END,
            CASE WHEN s.until_micros < a.t THEN a.t + a.ttl ELSE s.until_micros END FROM s JOIN a ON a.run_id = s.run_id AND a.k = s.k + 1)
        SELECT run_id, token, owner, until_micros FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC) = 1""",
    "stale_lease_appends": FENCED + """, t AS (SELECT run_id, seq, takes, token, coalesce(max(CASE WHEN takes THEN token END) OVER (PARTITION BY run_id ORDER BY seq), 0) AS now FROM fenced)
        SELECT run_id, count(*) AS stale, min(seq) AS first_stale, CAST(max(now) AS BIGINT) AS last_token FROM t WHERE NOT takes AND token <> now GROUP BY run_id""",
    "snapshot_due": _SIXTHS + """, h AS (SELECT run_id, max(seq) AS last_seq FROM run_events GROUP BY run_id), m AS (SELECT run_id, max(at_seq) AS at_seq FROM snapshots GROUP BY run_id)
        SELECT h.run_id, last_seq, at_seq, last_seq - coalesce(at_seq, 0) >= 4 AS due FROM h LEFT JOIN m ON m.run_id = h.run_id""",
    "snapshot_save": _SNAPSHOTS + """SELECT status, written, count(*) AS n FROM (SELECT status, CAST(1 AS BIGINT) AS written FROM snapshots WHERE at_seq % 8 = 0
        UNION ALL SELECT 'late', CAST(2 AS BIGINT) FROM snapshots WHERE at_seq <= 8 AND at_seq % 8 <> 0) GROUP BY status, written""",
    "snapshot_latest": _SNAPSHOTS + "SELECT run_id, max(at_seq) AS at_seq, max_by(status, at_seq) AS status, max_by(last_lifecycle_seq, at_seq) AS last_lifecycle_seq FROM snapshots GROUP BY run_id",
    "snapshot_prune": _SNAPSHOTS + "SELECT run_id, at_seq FROM snapshots QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY at_seq DESC) <= 2",
    "run_state_from_snapshot": _RUNS + "SELECT run_id, status, last_seq FROM states",
    "snapshot_equivalence": _RUNS + "SELECT status, count(*) AS same, CAST(0 AS BIGINT) AS different FROM states GROUP BY status",
    "dag_nodes": _DAG + "SELECT * FROM nodes",
    "dag_edges": _DAG + "SELECT * FROM edges",
    "dag_duplicate_nodes": _ODD + "SELECT run_id, node_id, count(*) AS added FROM odd WHERE event_type = 'node.added' GROUP BY run_id, node_id HAVING count(*) > 1",
    "dag_unknown_nodes": _ODD + """SELECT DISTINCT run_id, node_id, seq FROM named o WHERE NOT EXISTS (
        SELECT 1 FROM odd a WHERE a.run_id = o.run_id AND a.node_id = o.node_id AND a.event_type = 'node.added' AND a.seq < o.seq)""",
    "dag_reachability": _WALK + "SELECT run_id, count(*) AS pairs, CAST(sum(from_node * 31 + to_node) AS BIGINT) AS mark FROM ways GROUP BY run_id",
    "dag_cycles": _WALK + """, ends AS (SELECT run_id, max(seq) AS last, max(node_id) AS node FROM run_events GROUP BY run_id HAVING max(node_id) IS NOT NULL),
        bad AS (SELECT run_id, last, node, run_id % 2 = 0 AS waits, EXISTS (SELECT 1 FROM ways w WHERE w.run_id = e.run_id AND w.from_node = 0 AND w.to_node = e.node) AS way FROM ends e)
        SELECT run_id, CASE WHEN node = 0 AND waits THEN last + 1 ELSE last + 2 END AS seq, CASE WHEN node = 0 AND waits THEN 0 ELSE node END AS from_node, CAST(0 AS BIGINT) AS to_node
        FROM bad WHERE node = 0 OR waits OR way""",
    "dag_levels": _WALK + "SELECT run_id, node_id, max(level) AS level FROM longest GROUP BY run_id, node_id",
    "dag_ready_set": _DAG + "SELECT run_id, node_id FROM ready",
    "dag_outcome": _DAG + """SELECT outcome, count(*) AS n FROM (SELECT o_orderkey, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status IN ('succeeded', 'skipped')) THEN 'succeeded' ELSE 'running' END AS outcome
        FROM orders LEFT JOIN nodes ON run_id = o_orderkey GROUP BY o_orderkey) GROUP BY outcome""",
    "dag_dispatchable": _DAG + "SELECT run_id, node_id, attempt + 1 AS next_attempt FROM ready UNION ALL SELECT run_id, node_id, attempt FROM nodes WHERE status = 'running'",
    "next_attempt": _DAG + "SELECT next_attempt, count(*) AS n FROM (SELECT attempt + 1 AS next_attempt FROM ready UNION ALL SELECT attempt FROM nodes WHERE status = 'running') GROUP BY next_attempt",
    "dag_deadlocks": RUN_EVENTS + ", cut AS (SELECT * REPLACE (CASE WHEN run_id % 4 = 0 AND event_type = 'node.succeeded' THEN 'node.skipped' ELSE event_type END AS event_type) FROM run_events WHERE NOT (event_type = 'node.started' AND run_id % 4 = 0))" + _NODES.format(log="cut") + """
        SELECT run_id FROM nodes GROUP BY run_id HAVING NOT bool_or(status = 'failed') AND NOT bool_and(status IN ('succeeded', 'skipped')) AND NOT bool_or(status = 'running')
        AND run_id NOT IN (SELECT run_id FROM ready)""",
    "node_inputs": _DAG + "SELECT e.run_id, e.to_node AS node_id, e.from_node AS dependency, coalesce(n.output, '{}') AS output FROM waits e JOIN nodes n ON n.run_id = e.run_id AND n.node_id = e.from_node",
    "run_failure_cause": _DAG + """SELECT run_id, min_by(node_id, added_seq) AS node_id, min_by(failed_attempt, added_seq) AS attempt, min_by(error_class, added_seq) AS error_class, min_by(error_message, added_seq) AS error_message
        FROM nodes WHERE status = 'failed' GROUP BY run_id""",
    "cancelled_skips": RUN_EVENTS + """SELECT run_id, count(*) AS skipped FROM run_events WHERE event_type = 'node.skipped'
        AND run_id IN (SELECT run_id FROM run_events WHERE event_type = 'run.cancelled') GROUP BY run_id""",
    "error_categories": _FAILURES + """SELECT error_class, CASE error_class WHEN 'ToolTimeoutError' THEN 'retryable' WHEN 'ProviderUnavailableError' THEN 'retryable' WHEN 'ToolIndeterminateError' THEN 'indeterminate'
        ELSE 'terminal' END AS category, count(*) AS n FROM failures GROUP BY error_class""",
    "retry_decision": _FAILURES + """SELECT error_class, attempt, attempt < 2 AND error_class IN ('ToolTimeoutError', 'ProviderUnavailableError', 'BudgetExceededError') AS retry, count(*) AS n FROM failures GROUP BY ALL""",
    "node_failures_by_class": _FAILURES + "SELECT error_class, count(*) AS n, count(DISTINCT run_id) AS runs FROM failures GROUP BY error_class",
    "reflection_violations": _SPAWNS + "SELECT run_id, node_id, depth + 1 AS depth FROM s WHERE children > 0 AND depth + 1 > 3",
    "node_expansion": _SPAWNS + "SELECT run_id, node_id, unnest(range(1, children + 1)) AS child, depth + 1 AS depth FROM s WHERE children > 0 AND depth + 1 <= 3",
    "node_concurrency": RUN_EVENTS + """, f AS (SELECT run_id, seq, CASE WHEN event_type = 'node.started' AND attempt = 1 THEN 1 WHEN event_type IN ('node.succeeded', 'node.failed') THEN -1 ELSE 0 END AS c
        FROM run_events WHERE node_id IS NOT NULL) SELECT run_id, CAST(max(s) AS BIGINT) AS most FROM (SELECT run_id, sum(c) OVER (PARTITION BY run_id ORDER BY seq) AS s FROM f) GROUP BY run_id""",
    "spans": RUN_EVENTS + """, t AS (SELECT run_id, node_id, attempt, seq, event_type, lead(seq) OVER (PARTITION BY run_id, node_id ORDER BY seq) AS e FROM run_events
        WHERE event_type IN ('node.started', 'node.succeeded', 'node.failed')) SELECT run_id, node_id, attempt, seq AS start_seq, e AS end_seq FROM t WHERE event_type = 'node.started'""",
    "llm_call_cost": _PRICED + "SELECT run_id, call_no, cost_usd FROM ledger",
    "unpriced_calls": LLM_CALLS + "SELECT provider, model, count(*) AS n FROM llm_calls WHERE role = 'assistant' AND provider = 'gamma' GROUP BY provider, model",
    "run_cost": _PRICED + f"SELECT run_id, {_SUMS} FROM ledger GROUP BY run_id",
    "node_cost": _PRICED + f"SELECT run_id, node_id, {_SUMS} FROM ledger WHERE node_id IS NOT NULL GROUP BY run_id, node_id",
    "tenant_cost": _PRICED + f"SELECT tenant_id, {_SUMS} FROM ledger GROUP BY tenant_id",
    "cost_summary_empty": _PRICED + """, r AS (SELECT tenant_id, count(DISTINCT run_id) AS runs FROM llm_calls WHERE role = 'assistant' GROUP BY tenant_id), s AS (SELECT tenant_id, sum(cost_usd) AS c, sum(input_tokens + output_tokens) AS t, count(*) AS n FROM ledger WHERE cost_usd > 1000 GROUP BY tenant_id)
        SELECT r.tenant_id, runs, CAST(coalesce(c, 0) AS DECIMAL(20,10)) AS cost_usd, CAST(coalesce(t, 0) AS BIGINT) AS total_tokens, coalesce(n, 0) AS calls FROM r LEFT JOIN s ON s.tenant_id = r.tenant_id""",
    "cost_rollup": _PRICED + f"SELECT tenant_id, run_id, node_id, CAST(grouping(run_id) + grouping(node_id) AS BIGINT) AS level, {_SUMS} FROM ledger GROUP BY GROUPING SETS ((tenant_id), (tenant_id, run_id), (tenant_id, run_id, node_id))",
    "cost_by_model": _PRICED + f"SELECT provider, model, {_SUMS} FROM ledger GROUP BY provider, model",
    "budget_violations": LLM_CALLS_BIG + """, t AS (SELECT run_id, node_id, call_no, sum(input_tokens + output_tokens) OVER w AS spent_tokens, sum(CAST(output_tokens AS DECIMAL(12,0)) * CAST(0.002 AS DECIMAL(4,3))) OVER w AS spent_usd
          FROM calls WINDOW w AS (PARTITION BY run_id, node_id ORDER BY call_no ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, CASE WHEN spent_usd > 12 THEN 'cost' ELSE 'tokens' END AS broke, row_number() OVER (PARTITION BY run_id, node_id ORDER BY call_no) AS k, count(*) OVER (PARTITION BY run_id, node_id) AS calls FROM t WHERE spent_usd > 12 OR spent_tokens > 4000)
        SELECT run_id, node_id, calls, call_no, broke AS "limit", CAST(spent_tokens AS BIGINT) AS spent_tokens, CAST(spent_usd AS DECIMAL(20,10)) AS spent_usd FROM b WHERE k = 1""",
    "ledger_append": _PRICED + f"SELECT CAST(tenant_id AS VARCHAR) AS tenant_id, provider, {_SUMS} FROM ledger GROUP BY tenant_id, provider",
    "idempotency_keys": TOOL_LOG + "SELECT event_id % 7 AS node, event_id % 3 AS call_index, count(*) AS n, count(DISTINCT idempotency_key) AS keys FROM tool_log GROUP BY ALL",
    "tool_call_resolution": _TOOLS + "SELECT * FROM keys",
    "tool_call_outcome": _TOOLS + "SELECT * FROM outcomes",
    "tool_recovery_plan": _TOOLS + "SELECT tool, outcome, count(*) AS n FROM outcomes WHERE outcome IN ('redispatch', 'mark_indeterminate') GROUP BY tool, outcome",
    "tool_in_flight": _TOOLS + "SELECT idempotency_key FROM keys WHERE requested AND NOT completed AND NOT failed AND NOT indeterminate",
    "tool_intent_violations": TOOL_LOG + """, k AS (SELECT idempotency_key, min(seq) FILTER (WHERE event_type = 'tool.requested') AS asked, min(seq) FILTER (WHERE event_type <> 'tool.requested') AS answered,
        count(*) FILTER (WHERE event_type <> 'tool.requested') AS answers FROM tool_log GROUP BY idempotency_key)
        SELECT idempotency_key, answers FROM k WHERE answers > 0 AND (asked IS NULL OR answered < asked OR answers > 1)""",
    "egress_policy": _PAGES + "SELECT page_id, host, allowed FROM ok",
    "web_fetch_pages": _PAGES + "SELECT page_id, CAST(200 AS BIGINT) AS status, length(html) AS body_length, md5(html) AS body_md5 FROM ok WHERE allowed",
    "metrics_runs": _RUNS + "SELECT status, count(*) AS runs_total FROM states GROUP BY status",
    "metrics_nodes": _DAG + "SELECT status, count(*) AS nodes_total FROM nodes WHERE status IN ('succeeded', 'failed') GROUP BY status",
    "node_duration_histogram": RUN_EVENTS + """, d AS (SELECT run_id, node_id, max(seq) - min(seq) AS s FROM run_events WHERE event_type IN ('node.started', 'node.succeeded', 'node.failed') GROUP BY run_id, node_id HAVING count(*) > 1)
        SELECT le, CAST(sum(CASE WHEN s <= le THEN 1 ELSE 0 END) AS BIGINT) AS n FROM d, (VALUES (CAST(1 AS BIGINT)), (2), (3), (5), (10), (1000000)) b(le) GROUP BY le""",
    "metrics_llm": _PRICED + """, m AS (SELECT provider, model, count(*) AS calls, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o FROM ledger GROUP BY provider, model)
        SELECT provider, model, calls, cost_usd, 'input' AS kind, i AS tokens FROM m UNION ALL SELECT provider, model, calls, cost_usd, 'output', o FROM m""",
    "metrics_tools": _TOOLS + "SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome",
    "cev_seed": _PROPOSALS + "SELECT key, role, dependencies FROM (SELECT DISTINCT key FROM p), (VALUES ('executor', CAST(0 AS BIGINT)), ('critic', 1)) r(role, dependencies)",
    "cev_critique": _PROPOSALS + "SELECT key, round, violations, CASE WHEN ok THEN 'verify' ELSE 'reflect' END AS next FROM c",
    "cev_rounds": _PROPOSALS + "SELECT key, coalesce(min(round) FILTER (WHERE ok), max(round)) + 1 AS rounds, bool_or(ok) AS converged FROM c WHERE round <= 3 GROUP BY key",
    "workload_linear": "SELECT run_id, node, CASE WHEN node > 0 THEN node - 1 END AS dependency FROM (SELECT o_orderkey AS run_id, unnest(range(0, o_custkey % 10 + 1)) AS node FROM orders)",
    "workload_fan": "SELECT run_id, node, CASE WHEN node = 0 THEN 0 WHEN node <= width THEN 1 ELSE width END AS dependencies FROM (SELECT o_orderkey AS run_id, o_custkey % 5 + 1 AS width, unnest(range(0, o_custkey % 5 + 3)) AS node FROM orders)",
}
