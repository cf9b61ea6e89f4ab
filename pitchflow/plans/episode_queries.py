"""Registered queries over episodes of findings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import state as S
from .views import oracle, view

KEYS, ORDER = ("player_id",), ("t_us", "event_id")


def episode_segments(spark, d):
    return E.segment_episodes(view(spark, d, "symptoms"), KEYS, ORDER)


def episode_gates(spark, d):
    return E.gate_counts(view(spark, d, "symptoms"), KEYS, ORDER)


def risk_patterns(spark, d):
    """Alerts by severity; every fifth comes without a finding."""
    s = view(spark, d, "symptoms")
    finding = F.when(F.col("event_id") % 5 > 0, F.col("finding"))
    return S.risk_trajectory(s.select("player_id", *ORDER, finding.alias("finding"), F.col("severity").isin("medium", "high", "critical").cast("int").alias("alert")), KEYS, ORDER)


def trajectory_narratives(spark, d):
    """Episodes of players and the level of risk at their last finding, of four players in five."""
    level = risk_patterns(spark, d).filter("player_id % 5 > 0").groupBy("player_id").agg(F.max_by("level", F.struct(*ORDER)).alias("level"))
    return E.trajectory_narrative(episode_segments(spark, d).filter("player_id % 7 > 0"), level, KEYS)


def queries() -> dict:
    return {f.__name__: f for f in (episode_segments, episode_gates, risk_patterns, trajectory_narratives)}


def oracle_sql() -> dict[str, str]:
    level = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
    w = "PARTITION BY player_id ORDER BY t_us, event_id"
    # every run that isn't the last closes with a minute, so a run is an episode if it passes its own gates and either
    # differs in type from the run that passed before it or is critical
    steps = f"""WITH r AS (SELECT *, {level} AS level, row_number() OVER w AS pos, count(*) OVER (PARTITION BY player_id) AS n_all,
       CASE WHEN lag(finding) OVER w = finding AND coalesce(abs(minute - lag(minute) OVER w) <= 2, true) THEN 0 ELSE 1 END AS cut FROM ({oracle("symptoms")}) WINDOW w AS ({w})),
g AS (SELECT *, sum(cut) OVER (PARTITION BY player_id ORDER BY pos) AS grp FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY player_id, grp ORDER BY pos) <= count(*) OVER (PARTITION BY player_id, grp) // 2 AS early, max(pos) OVER (PARTITION BY player_id, finding) AS later,
       last_value(state) OVER (PARTITION BY player_id, finding ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS later_state FROM g),
x AS (SELECT player_id, grp, any_value(finding) AS finding, max(pos) AS upto, any_value(n_all) AS n_all, count(*) AS n, max(level) AS level, max(confidence) AS conf,
       arg_min(minute, pos) FILTER (minute IS NOT NULL) AS start_minute, arg_max(minute, pos) FILTER (minute IS NOT NULL) AS end_minute, arg_max(state, pos) AS state, any_value(later) AS later, any_value(later_state) AS later_state,
       bool_or(state = 'escalating') AS up, bool_or(state = 'resolving') AS down, avg(level) FILTER (early) AS s1, avg(level) FILTER (NOT early) AS s2, avg(confidence) FILTER (early) AS c1, avg(confidence) FILTER (NOT early) AS c2 FROM h GROUP BY 1, 2),
y AS (SELECT *, upto = n_all AS is_last, (SELECT max(score) FROM r WHERE r.player_id = x.player_id AND r.pos > x.n_all - x.n) AS top, level >= 2 OR (n >= 5 AND conf >= 0.55) AS passes,
       CASE WHEN n < 2 THEN 'stable' WHEN up THEN 'worsening' WHEN down THEN 'recovering' WHEN s2 > s1 THEN 'worsening' WHEN s2 < s1 THEN 'recovering' WHEN c2 > c1 + 0.05 THEN 'worsening' ELSE 'stable' END AS trend,
       CASE WHEN later > upto THEN CASE later_state WHEN 'resolving' THEN 'resolved' WHEN 'escalating' THEN 'escalated' ELSE 'persisted' END WHEN upto < n_all THEN CASE WHEN state = 'escalating' THEN 'escalated' ELSE 'resolved' END
            WHEN state = 'resolving' THEN 'resolved' WHEN state = 'escalating' THEN 'escalated' ELSE 'persisted' END AS response FROM x),
z AS (SELECT *, last_value(CASE WHEN passes AND NOT is_last THEN finding END IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM y),
s AS (SELECT *, CASE WHEN is_last THEN NULL WHEN level < 3 AND before = finding THEN 'cooldown' WHEN passes THEN NULL WHEN n < 5 THEN 'min_windows' ELSE 'confidence' END AS gate FROM z)"""
    risk = "CASE WHEN total >= 8 THEN 'critical' WHEN total >= 5 THEN 'high' WHEN total >= 3 THEN 'elevated' ELSE 'normal' END"
    found = {
        # each window in turn: x the alerts, c the clean windows on end, p the pattern, n its alerts
        "risk_patterns": f"""WITH RECURSIVE s AS (SELECT player_id, t_us, event_id, CASE WHEN event_id % 5 > 0 THEN finding END AS f, severity <> 'low' AS a, row_number() OVER ({w}) AS rn FROM ({oracle("symptoms")})),
m AS (SELECT DISTINCT player_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS t_us, CAST(0 AS BIGINT) AS event_id, 0 AS total, 0 AS c, CAST(NULL AS VARCHAR) AS p, 0 AS n FROM s
 UNION ALL SELECT s.player_id, s.rn, s.t_us, s.event_id, CASE WHEN a THEN total + 1 WHEN c = 1 THEN 0 ELSE total END, CASE WHEN a OR c = 1 THEN 0 ELSE c + 1 END, CASE WHEN a THEN coalesce(f, p) WHEN c = 1 THEN NULL ELSE p END,
  CASE WHEN a AND f IS NOT NULL THEN CASE WHEN f = p THEN n + 1 ELSE 1 END WHEN NOT a AND c = 1 THEN 0 ELSE n END FROM m JOIN s ON s.player_id = m.player_id AND s.rn = m.rn + 1)
SELECT player_id, t_us, event_id, CAST(total AS BIGINT) AS total, {risk} AS level, p AS pattern, CAST(n AS BIGINT) AS pattern_windows FROM m WHERE rn > 0""",
        "episode_gates": f"{steps} SELECT player_id, gate, count(*) AS n FROM s WHERE gate IS NOT NULL GROUP BY 1, 2",
        "episode_segments": f"""{steps}, e AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY grp) AS episode FROM s WHERE gate IS NULL),
j AS (SELECT *, coalesce(lag(finding) OVER v = finding AND NOT is_last AND (start_minute IS NULL OR start_minute - lag(end_minute) OVER v <= 3), false) AS joins FROM e WINDOW v AS (PARTITION BY player_id ORDER BY episode)),
k AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY player_id ORDER BY episode) AS m FROM j)
SELECT player_id, min(episode) AS episode, any_value(finding) AS finding, arg_min(start_minute, episode) AS start_minute, CASE WHEN bool_or(is_last) THEN NULL ELSE max(end_minute) END AS end_minute,
       CASE WHEN bool_or(joins AND trend = 'worsening') THEN 'worsening' ELSE arg_min(trend, episode) END AS trend, ['low', 'medium', 'high', 'critical'][max(level) + 1] AS severity,
       coalesce(arg_max(response, episode) FILTER (joins AND response IN ('escalated', 'persisted')), arg_min(response, episode)) AS response, CAST(sum(n) AS BIGINT) AS n_windows, max(top) AS peak_score, max(conf) AS peak_confidence FROM k GROUP BY player_id, m""",
    }
    found["trajectory_narratives"] = f"""WITH e AS (SELECT * FROM ({found["episode_segments"]}) WHERE player_id % 7 > 0), l AS (SELECT player_id, arg_max(level, (t_us, event_id)) AS level FROM ({found["risk_patterns"]}) WHERE player_id % 5 > 0 GROUP BY 1),
g AS (SELECT player_id, count(*) AS n, replace(arg_min(finding, episode), '_', ' ') AS a, replace(arg_max(finding, episode), '_', ' ') AS b, coalesce('from min~' || min(start_minute) FILTER (episode = first), 'from early match') AS s, coalesce('to min~' || max(end_minute) FILTER (episode = last), 'ongoing') AS t,
  CASE WHEN count(*) FILTER (trend = 'worsening') > count(*) FILTER (trend = 'recovering') THEN 'progressive deterioration' WHEN count(*) FILTER (trend = 'worsening') < count(*) FILTER (trend = 'recovering') THEN 'improving trajectory' ELSE 'fluctuating state' END AS arc
  FROM (SELECT *, min(episode) OVER (PARTITION BY player_id) AS first, max(episode) OVER (PARTITION BY player_id) AS last FROM e) GROUP BY 1)
SELECT coalesce(g.player_id, l.player_id) AS player_id, CASE WHEN n IS NULL THEN 'No significant episodes detected yet.' ELSE substr(CASE WHEN a = b THEN n || ' episode(s) of ' || a || ' — ' || arc || ' ' || s || ', ' || t || '.' ELSE n || ' episode(s): ' || a || ' (' || s || ') → ' || b || ' (' || t || ') — ' || arc || '.' END || ' Escalation: ' || coalesce(level, 'normal') || '.', 1, 200) END AS narrative
FROM g FULL JOIN l ON g.player_id = l.player_id"""
    return found
