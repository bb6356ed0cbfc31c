from __future__ import annotations

from fleetgauge.oracles.common import EVENTS_NOW, case, pct, rdiv, sql


def histogram(source: str, column: str, steps: int = 200) -> str:
    return f"""SELECT step, range_hi_key, all_rows - eq_rows AS range_rows, eq_rows, vals - 1 AS distinct_range_rows,
 CASE WHEN vals > 1 THEN (all_rows - eq_rows) / (vals - 1) ELSE 1.0 END AS avg_range_rows FROM (
 SELECT step, max(v) AS range_hi_key, arg_max(g, v) AS eq_rows, CAST(sum(g) AS BIGINT) AS all_rows, count(*) AS vals FROM (
  SELECT v, g, CAST((sum(g) OVER (ORDER BY v) - g) * {steps} // sum(g) OVER () AS BIGINT) AS step FROM (
   SELECT {column} AS v, count(*) AS g FROM {source} AND {column} IS NOT NULL GROUP BY 1) f) p GROUP BY step) s"""


def _header(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS column_name, {EVENTS_NOW} AS updated, count(*) AS rows, count(*) AS rows_sampled,
 count(*) - count({column}) AS null_rows, count(DISTINCT {column}) AS distinct_values, 1.0::DOUBLE / count(DISTINCT {column}) AS density,
 (SELECT count(*) FROM ({histogram(source, column)}) h) AS steps FROM {source}"""


def _prefix(columns: list[str]) -> str:
    names = ", ".join(columns)
    return f"""SELECT '{names}' AS columns, CAST({len(columns)} AS INT) AS prefix_length, count(*) AS distinct_values,
 1.0::DOUBLE / count(*) AS density FROM (SELECT DISTINCT {names} FROM lineitem) d"""


VECTOR = ["l_returnflag", "l_suppkey", "l_linenumber"]
SKEWED = ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_linenumber"]
SAMPLE = "(l_orderkey * 7919 + l_linenumber * 104729) % 100 < 30"
# Reachability in the graph of waits: a pair of sessions and the fewest hops between them. Paths are followed
# as far as a snapshot has edges, which is the longest that a shortest path can be.
REACH = """edge AS (SELECT DISTINCT server_id, snapshot_ts, session_id AS a, blocking_session_id AS b FROM request_snapshot
  WHERE blocking_session_id > 0 AND blocking_session_id <> session_id),
most AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM edge GROUP BY server_id, snapshot_ts) c),
path AS (SELECT server_id, snapshot_ts, a, b, CAST(1 AS BIGINT) AS hops FROM edge
 UNION SELECT p.server_id, p.snapshot_ts, p.a, e.b, p.hops + 1 FROM path p JOIN edge e
  ON e.server_id = p.server_id AND e.snapshot_ts = p.snapshot_ts AND e.a = p.b WHERE p.hops < (SELECT n FROM most)),
reach AS (SELECT server_id, snapshot_ts, a, b, min(hops) AS hops FROM path GROUP BY ALL),
mutual AS (SELECT x.server_id, x.snapshot_ts, x.a, x.b FROM reach x JOIN reach y
  ON y.server_id = x.server_id AND y.snapshot_ts = x.snapshot_ts AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b),
node AS (SELECT server_id, snapshot_ts, a AS s FROM edge UNION SELECT server_id, snapshot_ts, b FROM edge),
name AS (SELECT n.server_id, n.snapshot_ts, n.s, least(n.s, coalesce(min(m.b), n.s)) AS name, count(m.b) + 1 AS members FROM node n
  LEFT JOIN mutual m ON m.server_id = n.server_id AND m.snapshot_ts = n.snapshot_ts AND m.a = n.s GROUP BY n.server_id, n.snapshot_ts, n.s)"""
ORACLES = {
    "x09_histogram": sql(histogram("lineitem WHERE true", "l_partkey")),
    "x09b_histogram_dates": sql(histogram("lineitem WHERE true", "l_shipdate", 50)),
    "x10_stat_header": sql(" UNION ALL ".join(_header("lineitem WHERE true", c) for c in ("l_partkey", "l_suppkey", "l_returnflag"))),
    "x11_density_vector": sql(" UNION ALL ".join(_prefix(VECTOR[:n]) for n in (3, 2, 1))),
    "x12_filtered_stats": sql(histogram("lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00'", "l_suppkey")),
    "x13_sampled_stats": sql(f"""
SELECT step, range_hi_key, CAST({rdiv('range_rows * 100', '30', 0)} AS BIGINT) AS range_rows, CAST({rdiv('eq_rows * 100', '30', 0)} AS BIGINT) AS eq_rows,
 distinct_range_rows, CAST(30 AS INT) AS sample_percent, range_rows + eq_rows AS rows_sampled
FROM ({histogram(f"lineitem WHERE {SAMPLE}", "l_partkey")}) h"""),
    "x14_estimate_vs_actual": sql(f"""
WITH h AS ({histogram("lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00'", "l_shipdate")}),
a AS (SELECT l_shipdate AS value, count(*) AS actual_rows FROM lineitem GROUP BY 1),
m AS (SELECT value, actual_rows, (SELECT min(range_hi_key) FROM h WHERE h.range_hi_key >= a.value) AS hi FROM a)
SELECT *, {case(("q_error > 10", "CRITICAL", "misestimated"))} FROM (
 SELECT *, greatest(estimated_rows / actual_rows, actual_rows / estimated_rows) AS q_error FROM (
  SELECT m.value, m.actual_rows, CASE WHEN m.hi IS NULL THEN 1.0::DOUBLE WHEN m.value = m.hi THEN CAST(h.eq_rows AS DOUBLE)
   ELSE h.avg_range_rows END AS estimated_rows FROM m LEFT JOIN h ON h.range_hi_key = m.hi) e) y"""),
    "x15_skew": sql(" UNION ALL ".join(f"""
SELECT *, {pct('top_rows', 'rows')} AS top_share_pct, {case((f"{pct('top_rows', 'rows')} >= 90", "CRITICAL", "dominant_value"),
  (f"{pct('top_rows', 'rows')} >= 50", "ATTENTION", "skewed"))} FROM (
 SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_values, arg_max(v, (n, v)) AS top_value, max(n) AS top_rows
 FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1) f) y""" for c in SKEWED)),
    "x16_parameter_spread": sql(f"""
SELECT *, {rdiv('max_us', 'median_us', 2)} AS max_over_median, {rdiv('max_us', 'min_us', 2)} AS max_over_min,
 {case((f"{rdiv('max_us', 'median_us', 2)} > 100", "CRITICAL", "very_unstable"), (f"{rdiv('max_us', 'median_us', 2)} > 10", "ATTENTION", "unstable"))}
FROM (SELECT p.server_id, p.query_id, CAST(sum(r.count_executions) AS BIGINT) AS executions, min(r.avg_duration) AS min_us,
 quantile_disc(r.avg_duration, 0.5) AS median_us, max(r.avg_duration) AS max_us
 FROM qs_runtime r JOIN qs_plan p ON p.server_id = r.server_id AND p.plan_id = r.plan_id GROUP BY ALL) y""", "qs_runtime", "qs_plan"),
    "x03_block_leaders": sql(f"""
WITH RECURSIVE {REACH},
away AS (SELECT DISTINCT x.server_id, x.snapshot_ts, x.name FROM edge e
  JOIN name x ON x.server_id = e.server_id AND x.snapshot_ts = e.snapshot_ts AND x.s = e.a
  JOIN name y ON y.server_id = e.server_id AND y.snapshot_ts = e.snapshot_ts AND y.s = e.b WHERE x.name <> y.name),
behind AS (SELECT r.server_id, r.snapshot_ts, t.name, r.a, min(r.hops) AS hops FROM reach r
  JOIN name t ON t.server_id = r.server_id AND t.snapshot_ts = r.snapshot_ts AND t.s = r.b
  JOIN name f ON f.server_id = r.server_id AND f.snapshot_ts = r.snapshot_ts AND f.s = r.a
  ANTI JOIN away w ON w.server_id = t.server_id AND w.snapshot_ts = t.snapshot_ts AND w.name = t.name
  WHERE f.name <> t.name GROUP BY ALL)
SELECT server_id, snapshot_ts, name AS leader_session_id, count(*) AS blocked_sessions, max(hops) AS chain_depth
FROM behind GROUP BY ALL""", "request_snapshot"),
    "x06_deadlock_window": sql(f"""
WITH RECURSIVE {REACH}
SELECT server_id, snapshot_ts, name AS first_session_id, s AS session_id, members AS sessions FROM name
WHERE members > 1 AND snapshot_ts BETWEEN TIMESTAMP '2024-01-30 19:00:00' AND TIMESTAMP '2024-01-30 23:00:00'""", "request_snapshot"),
    "x15b_heavy_values": " UNION ALL ".join(
        f"SELECT column_name, value, rows, share_pct, {case(('share_pct >= 90', 'CRITICAL', 'dominant_value'), ('share_pct >= 50', 'ATTENTION', 'skewed'))} FROM ("
        f"SELECT '{c}' AS column_name, {text} AS value, count(*) AS rows, {pct('count(*)', 'any_value(total)')} AS share_pct "
        f"FROM lineitem, (SELECT count(*) AS total FROM lineitem) t GROUP BY {c} HAVING count(*) > 0.01 * any_value(total)) y"
        for c, text in [
            *((c, f"CAST({c} AS VARCHAR)") for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")), ("l_quantity", "CAST(l_quantity AS VARCHAR)")
        ]
    ),
    "x22_merged_statistics": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS null_rows, {low} AS low, {high} AS high, true AS distinct_within_bound, "
        "CAST(1 AS INT) AS partitions_read_again FROM lineitem"
        for c, low, high in [
            *((c, f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") for c in ("l_partkey", "l_suppkey", "l_quantity")),
            ("l_returnflag", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
        ]
    ),
}
