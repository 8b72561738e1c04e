"""The same results in SQL over the given tables, without any JSON."""

from millrace.plans.fixtures import LADDER

_RUNGS = ", ".join(f"({i}, '{outcome}', '{reason}')" for i, (_, outcome, reason) in enumerate(LADDER))
_CUSTOMERS = """(SELECT c_custkey AS user_id, c_name AS name, n_name AS city FROM customer
  JOIN nation ON c_nationkey = n_nationkey)"""
_USERS = """(SELECT c_custkey AS user_id, c_name AS name, n_name AS city FROM customer
  JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0)"""
_ID = "lpad(lower(to_hex(e.event_id)), 24, '0')"
_TIME = "date_trunc('milliseconds', e.ts)"
_IS_CREATE = "e.event_type IN ('purchase', 'click', 'view')"

_TRANSACTIONS = f"""
SELECT {_ID} AS transaction_id, e.user_id, e.value AS amount, {_TIME} AS "timestamp"
FROM events e WHERE {_IS_CREATE}"""

_ENRICHED = f"""
SELECT {_ID} AS transaction_id, e.user_id, e.value AS amount, {_TIME} AS "timestamp",
  CASE WHEN u.user_id IS NULL THEN 'Unknown' ELSE u.name END AS user_name,
  CASE WHEN u.user_id IS NULL THEN 'Unknown' ELSE u.city END AS user_city
FROM events e LEFT JOIN {_USERS} u ON e.user_id = u.user_id WHERE {_IS_CREATE}"""

_OUTCOMES = f"""
SELECT e.event_id, e.user_id,
  CASE WHEN {_IS_CREATE} THEN 'ENRICHED' WHEN e.event_type = 'signup' THEN 'SKIPPED'
    WHEN e.event_id % 4 = 1 THEN 'SKIPPED' WHEN e.event_id % 4 = 3 THEN 'EMPTY' ELSE 'ERROR' END AS outcome,
  CASE WHEN {_IS_CREATE} THEN '' WHEN e.event_type = 'signup' THEN 'OP'
    WHEN e.event_id % 4 = 0 THEN 'BAD_JSON' WHEN e.event_id % 4 = 1 THEN 'EMPTY_ENVELOPE'
    WHEN e.event_id % 4 = 2 THEN 'AFTER_NOT_STRING' ELSE '' END AS reason
FROM events e"""

_METRICS = f"""
SELECT 'received' AS metric, count(*) AS n FROM ({_OUTCOMES})
UNION ALL SELECT lower(o.outcome), count(e.outcome)
  FROM (VALUES ('ENRICHED'), ('SKIPPED'), ('EMPTY'), ('ERROR')) o(outcome)
  LEFT JOIN ({_OUTCOMES}) e ON e.outcome = o.outcome GROUP BY 1"""

ORACLES = {
    "q01_enrich": _ENRICHED,
    "q02_decode": _TRANSACTIONS,
    "q03_lookup_default": f"""
SELECT e.event_id, CASE WHEN u.user_id IS NULL THEN 'Unknown' ELSE u.name END AS user_name
FROM events e LEFT JOIN {_USERS} u ON e.user_id = u.user_id""",
    "q04_outcome_counts": f"SELECT outcome, reason, count(*) AS n FROM ({_OUTCOMES}) GROUP BY 1, 2",
    "q05_quarantine": """
SELECT e.event_id AS "offset",
  CASE e.event_id % 4 WHEN 0 THEN 'BAD_JSON' ELSE 'AFTER_NOT_STRING' END AS reason
FROM events e WHERE e.event_type = 'error' AND e.event_id % 4 IN (0, 2)""",
    "q06_null_key_lookup": f"""
SELECT e.event_id, COALESCE(u.name, 'Unknown') AS user_name
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS k FROM events) e
LEFT JOIN (SELECT * FROM {_USERS} UNION ALL SELECT NULL, 'Anon', 'Nowhere') u
  ON e.k IS NOT DISTINCT FROM u.user_id""",
    "q07_lookup_first_match": """
SELECT e.event_id, COALESCE(o.p, 'Unknown') AS priority
FROM events e LEFT JOIN (
  SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1
) o ON e.user_id = o.k""",
    "q08_dimension_refresh": f"SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS key_sum FROM {_USERS}",
    "q09_inspect_limit": f"{_ENRICHED} ORDER BY transaction_id LIMIT 5",
    "q10_replay_earliest": 'SELECT e.event_id AS "offset", e.event_type FROM events e',
    "q11_encode_envelope": f"""
SELECT CASE WHEN {_IS_CREATE} THEN 'c' WHEN e.event_type = 'signup' THEN 'r' ELSE 'u' END AS op,
  {_ID} AS oid FROM events e""",
    "q12_local_time": f"SELECT e.event_id, {_TIME} + INTERVAL 7 HOUR AS local_time FROM events e",
    "q13_topic_route": "SELECT e.event_id AS \"offset\" FROM events e WHERE e.event_type <> 'signup'",
    "q14_raw_materialise": _TRANSACTIONS,
    "q15_round_amount": "SELECT e.event_id, round(e.value / 3, 2) AS amount FROM events e",
    "q16_lookup_skewed": f"""
SELECT e.event_id, COALESCE(u.name, 'Unknown') AS user_name
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN user_id END AS k FROM events) e
LEFT JOIN {_USERS} u ON e.k = u.user_id""",
    "q17_dimension_documents": f"""
SELECT e.event_id AS "offset",
  CASE WHEN c.k = 1 THEN 'ERROR' ELSE 'ENRICHED' END AS outcome,
  CASE WHEN c.k = 1 THEN 'USER_INCOMPLETE' ELSE '' END AS reason,
  CASE WHEN c.k = 0 THEN c.name WHEN c.k IN (1, 3) THEN NULL ELSE 'Unknown' END AS user_name,
  CASE WHEN c.k IN (0, 3) THEN c.city WHEN c.k = 1 THEN NULL ELSE 'Unknown' END AS user_city
FROM events e LEFT JOIN (
  SELECT c_custkey AS user_id, c_custkey % 5 AS k, c_name AS name, n_name AS city
  FROM customer JOIN nation ON c_nationkey = n_nationkey
) c ON e.user_id = c.user_id WHERE {_IS_CREATE}""",
    "q18_backfill_large": _ENRICHED,
    "q19_backfill_metrics": f"""{_METRICS}
UNION ALL SELECT 'unknown', count(*) FROM ({_ENRICHED}) WHERE user_name = 'Unknown'""",
    "q20_dimension_scan": f"SELECT * FROM {_CUSTOMERS}",
    "q21_load_count": f"SELECT count(*) AS n FROM {_CUSTOMERS}",
    "q22_outcome_ladder": f"""
SELECT e.event_id AS "offset", r.outcome, r.reason FROM events e JOIN (VALUES {_RUNGS}) r(rung, outcome, reason)
  ON e.event_id % {len(LADDER)} = r.rung""",
    "q23_extended_json": """
SELECT e.event_id AS "offset", CAST(e.event_id AS VARCHAR) AS transaction_id,
  CASE WHEN e.event_id % 8 < 6 THEN e.user_id END AS user_id,
  CASE WHEN e.event_id % 8 < 5 THEN CAST(CAST(e.value AS DECIMAL(18, 2)) AS DOUBLE) WHEN e.event_id % 8 = 5 THEN 3.0 END AS amount,
  CASE e.event_id % 8 WHEN 2 THEN date_trunc('second', e.ts) WHEN 3 THEN date_trunc('second', e.ts)
    WHEN 4 THEN date_trunc('second', e.ts) + INTERVAL 250 MILLISECOND WHEN 5 THEN TIMESTAMP '2023-11-14 22:13:20'
    WHEN 6 THEN NULL ELSE date_trunc('milliseconds', e.ts) END AS "timestamp"
FROM events e""",
    "q24_seed_lookup": """
SELECT e.event_id AS "offset", coalesce(u.name, 'Unknown') AS user_name, coalesce(u.city, 'Unknown') AS user_city
FROM events e LEFT JOIN (VALUES (1, 'Alice', 'New York'), (2, 'Bob', 'London'), (3, 'Charlie', 'Paris')) u(user_id, name, city)
  ON e.user_id = u.user_id""",
    "q25_incomplete_metrics": f"""
WITH o AS (
  SELECT NOT ({_IS_CREATE}) AS skipped, c_custkey % 5 AS k FROM events e LEFT JOIN customer ON e.user_id = c_custkey)
SELECT 'received' AS metric, count(*) AS n FROM o
UNION ALL SELECT 'enriched', count(*) FROM o WHERE NOT skipped AND k IS DISTINCT FROM 1
UNION ALL SELECT 'skipped', count(*) FROM o WHERE skipped
UNION ALL SELECT 'empty', 0
UNION ALL SELECT 'error', count(*) FROM o WHERE NOT skipped AND k = 1
UNION ALL SELECT 'user_incomplete', count(*) FROM o WHERE NOT skipped AND k = 1
UNION ALL SELECT 'unknown', count(*) FROM o WHERE NOT skipped AND (k IS NULL OR k IN (2, 4))""",
    "q26_backfill_retry": _ENRICHED,
    "q27_feed_back": f"""
SELECT e.event_id AS "offset", c_name AS user_name, n_name AS user_city
FROM events e JOIN customer ON e.user_id = c_custkey AND c_custkey % 5 = 1 JOIN nation ON c_nationkey = n_nationkey WHERE {_IS_CREATE}""",
    "q28_compacted_sink": _ENRICHED,
    "s01_enrich_stream": _ENRICHED,
    "s02_stream_resume": _ENRICHED,
    "s03_dimension_freshness": """
SELECT e.event_id, CASE WHEN c.c_custkey IS NULL OR (e.event_id % 2 = 0 AND c.c_custkey % 7 = 0)
  THEN 'Unknown' ELSE c.c_name END AS user_name
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "s04_replay_idempotent": _ENRICHED,
    "s05_reset": _ENRICHED,
    "s06_raw_stream": _TRANSACTIONS,
    "s07_stream_metrics": _METRICS,
    "s08_backfill_then_stream": f"WITH one AS ({_ENRICHED}) SELECT * FROM one UNION ALL SELECT * FROM one",
    "s09_redelivered": _ENRICHED,
}
