"""Registered queries of rosters, metrics, loads, timelines and trends over matches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matchday as M
from ..operators import workload as L
from . import insight_queries as IQ
from .views import oracle, view

ALIASES = {"A": "Alpha", "HOME": "Alpha"}


def _windows(spark, d):
    return L.workload_windows(view(spark, d, "buckets"))


def _roster(spark, d):
    """A player table of the tracking data: even ids are the own team's."""
    ids = view(spark, d, "telemetry").select("player_id").distinct()
    return ids.select("player_id", F.concat(F.lit("player "), F.col("player_id").cast("string")).alias("name"), F.when(F.col("player_id") % 5 > 0, F.concat(F.lit("pos"), (F.col("player_id") % 5).cast("string"))).alias("position"), F.when(F.col("player_id") % 2 == 0, "OWN").otherwise("OPPONENT").alias("ownership"))


def workload_windows(spark, d):
    return _windows(spark, d).select("match_id", "player_id", "bucket", "current_load", *M.LOADS)


def workload_events(spark, d):
    return M.workload_events(_windows(spark, d), _roster(spark, d))


def player_match_loads(spark, d):
    return M.player_match_loads(_windows(spark, d))


def match_timeline(spark, d):
    return M.match_timeline(_windows(spark, d), _roster(spark, d).filter("ownership = 'OWN'"))


def match_roster(spark, d):
    return M.match_roster(view(spark, d, "stats"))


def player_match_metrics(spark, d):
    loads = view(spark, d, "stats").filter("player_id IS NOT NULL").groupBy("match_id", "player_id").agg(*[F.sum(F.col("sprints") * (i + 1)).alias(c) for i, c in enumerate(M.LOADS)])
    return M.player_match_metrics(view(spark, d, "stats"), loads.filter("player_id % 3 > 0"))


def player_trends(spark, d):
    return M.player_trends(view(spark, d, "stats"))


def load_trends(spark, d):
    return M.load_trends(M.player_match_loads(_windows(spark, d)), view(spark, d, "matches"))


def first_per_match(spark, d):
    s = view(spark, d, "stats").select("match_id", "begin_us", "team", "ownership")
    return M.first_per_match(s, "begin_us")


def newest_match(spark, d):
    return M.newest_match(view(spark, d, "matches"))


def canonical_team(spark, d):
    t = view(spark, d, "tactical")
    return t.select("event_id", M.canonical_team(F.col("team_id"), ALIASES).alias("team_id"))


def label_windows(spark, d):
    labels = view(spark, d, "scored").filter("event_id % 2 = 0").select("player_id", (F.col("label") == 1).alias("label"))
    return M.label_windows(view(spark, d, "buckets").select("match_id", "player_id", "bucket"), labels, "player_id")


def window_stats(spark, d):
    t = view(spark, d, "telemetry").withColumn("distance_delta", F.when(F.col("event_id") % 4 > 0, F.col("speed_ms") * 2))
    b = t.filter("player_id % 6 > 0").groupBy("player_id").agg(*[x for c, e in (("distance", F.col("speed_ms") * 3), ("mean_speed", F.col("speed_ms")), ("sprints", (F.col("speed_ms") >= 5.5).cast("int"))) for x in (F.round(F.avg(e), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(e), 6).alias(f"{c}_std"))])
    return M.window_stats(t, b, ("player_id", "match_id"))


def event_rows(spark, d):
    t = view(spark, d, "telemetry")
    return M.to_event_rows(t).withColumn("x_pitch", F.round("x_pitch", 6))


def template_summary(spark, d):
    return M.template_summary(IQ.semantic_findings(spark, d))


def alert_summaries(spark, d):
    """Texts of tracked events as if they were alerts."""
    e = view(spark, d, "telemetry")
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    n = F.col("event_id")
    finding = lambda k: F.struct(pick(("cardio_strain", "locomotor_overload", "tactical_drift"), (n + k) % 3).alias("finding_type"), F.concat(F.lit("Finding "), k.cast("string"), F.lit(".")).alias("summary"))
    findings = F.when(n % 4 > 0, F.transform(F.sequence(F.lit(1), (n % 4).cast("int")), finding))
    effects = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(F.concat(F.lit("c"), k.cast("string")).alias("label"), ((n + k) % 9).cast("string").alias("value"), ((n * (k + 3)) % 5 - F.lit(2)).cast("double").alias("effect")))
    a = e.select(n.alias("event_id"), pick(("substitution", "fatigue_alert", "positional_drift", "workload_warning", "other"), n % 5).alias("recommendation"), (n % 10 / 10).alias("confidence"), F.concat(F.lit("player "), F.col("player_id").cast("string")).alias("player_name"), pick(("high_risk", "low_readiness", "optimal"), n % 3).alias("workload_status"), findings.alias("findings"), effects.alias("contributions"))
    return M.alert_summary(a).select("event_id", "summary")


def queries() -> dict:
    return {f.__name__: f for f in (workload_windows, workload_events, player_match_loads, match_timeline, match_roster, player_match_metrics, player_trends, load_trends, first_per_match, newest_match, canonical_team, label_windows, window_stats, event_rows, template_summary, alert_summaries)}


def oracle_sql() -> dict[str, str]:
    ld = M.LOADS
    ww = f"""WITH bk AS ({oracle('buckets')}), ww AS (SELECT *, round(n_accel * coalesce(mean_accel, 0), 6) acceleration_load, round(n_decel * abs(coalesce(mean_decel, 0)), 6) deceleration_load,
  round(n_accel * coalesce(mean_accel, 0) + n_decel * abs(coalesce(mean_decel, 0)), 6) current_load, sprint_distance sprint_load, CASE WHEN max_speed >= 4.17 THEN distance ELSE 0 END high_intensity_load, distance distance_covered FROM bk)"""
    own = "ow AS (SELECT w.* FROM ww w WHERE player_id % 2 = 0)"
    trend = lambda c, a: f"""{a}0 AS (SELECT match_id, player_id, bucket, row_number() OVER w rn, sum({c}) OVER (w ROWS UNBOUNDED PRECEDING) t FROM ow WINDOW w AS (PARTITION BY match_id, player_id ORDER BY bucket)),
 {a}1 AS (SELECT a.*, b.t / (a.rn // 2) f, (a.t - b.t) / (a.rn - a.rn // 2) s FROM {a}0 a LEFT JOIN {a}0 b ON a.match_id = b.match_id AND a.player_id = b.player_id AND b.rn = a.rn // 2),
 {a} AS (SELECT match_id, player_id, bucket, CASE WHEN rn < 2 THEN 'stable' WHEN f = 0 THEN CASE WHEN s > 0 THEN 'increasing' ELSE 'stable' END WHEN round((s - f) / abs(f), 9) > 0.05 THEN 'increasing' WHEN round((s - f) / abs(f), 9) < -0.05 THEN 'decreasing' ELSE 'stable' END trend FROM {a}1)"""  # noqa: E731
    st = f"WITH s0 AS ({oracle('stats')}), st AS (SELECT * FROM s0 WHERE player_id IS NOT NULL)"
    ded = lambda sums, firsts: f"""fl AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY {", ".join(f"{c} NULLS FIRST" for c in ("description", "begin_us", *sums, *firsts))}) k FROM st WHERE contains(description, ' vs. ')), fw AS (SELECT * FROM fl WHERE k = 1),
 hf AS (SELECT match_id, player_id, {", ".join(f"sum({c}) {c}" for c in sums)}, {", ".join(f"(min({{'d': description, 'b': begin_us, 'v': {c}}}) FILTER ({c} IS NOT NULL AND description IS NOT NULL)).v {c}" for c in firsts)} FROM st ANTI JOIN fw USING (match_id, player_id) GROUP BY 1, 2),
 dd AS (SELECT match_id, player_id, {", ".join((*sums, *firsts))} FROM fw UNION ALL SELECT * FROM hf)"""  # noqa: E731
    roll = lambda src, metrics, order: f"""lg AS ({" UNION ALL ".join(f"SELECT player_id, '{m}' metric, coalesce({m}, 0) v, {order} FROM {src}" for m in metrics)}), rr AS (SELECT *, row_number() OVER (PARTITION BY player_id, metric ORDER BY o DESC, o2 DESC, o3 DESC) k FROM lg),
 ra AS (SELECT player_id, metric, max(v) FILTER (k = 1) la, avg(v) FILTER (k <= 5) m5, avg(v) FILTER (k <= 7) m7, avg(v) FILTER (k <= 10) m10, avg(v) s, count(*) n FROM rr GROUP BY 1, 2),
 rl AS (SELECT player_id, metric, round(CAST(la AS DECIMAL(38, 9)), 6)::DOUBLE AS last, round(CAST(m5 AS DECIMAL(38, 9)), 6)::DOUBLE mean5, round(CAST(m7 AS DECIMAL(38, 9)), 6)::DOUBLE mean7, round(CAST(m10 AS DECIMAL(38, 9)), 6)::DOUBLE mean10, round(CAST(s AS DECIMAL(38, 9)), 6)::DOUBLE season, n n_matches, CASE WHEN s = 0 THEN CASE WHEN m5 = 0 THEN 'stable' ELSE 'improving' END WHEN round((m5 - s) / abs(s), 9) > 0.05 THEN 'improving' WHEN round((m5 - s) / abs(s), 9) < -0.05 THEN 'declining' ELSE 'stable' END trend FROM ra)"""  # noqa: E731
    segs = ", ".join(f"('{a}-{b}', {a}, {b})" for a, b in M.SEGMENTS)
    lead = "concat_ws(';', " + ", ".join(f"'{c}:' || coalesce((SELECT string_agg(player_id::VARCHAR, ',' ORDER BY k) FROM (SELECT player_id, row_number() OVER (ORDER BY round({c}, 6) DESC, player_id) k FROM pp WHERE pp.match_id = g.match_id AND pp.seg = g.seg AND {c} > 0) WHERE k <= 3), '')" for c in ld) + ")"
    zz = lambda c: f"round(CASE WHEN {c}_std <> 0 AND {c} IS NOT NULL THEN ({c} - {c}_mean) / {c}_std ELSE 0 END, 6) z_{c}"
    kept = lambda sign, n: f"list_filter(list_transform(range(0, 5), lambda k: CASE WHEN (event_id * (k + 3)) % 5 - 2 {sign} 0 THEN 'c' || k || ' (' || (event_id + k) % 9 || ')' END), lambda x: x IS NOT NULL)[:{n}]"
    texts = f"""SELECT event_id, trim(['Consider substituting ', 'Fatigue alert for ', 'Positional drift detected for ', 'Workload warning for ', 'Performance anomaly — '][event_id % 5 + 1] || 'player ' || player_id || ' (confidence: ' || CAST(floor(event_id % 10 / 10::DOUBLE * 100) AS BIGINT) || '%). '
 || CASE WHEN event_id % 4 > 0 THEN 'Finding 1. ' || CASE WHEN event_id % 4 > 1 THEN 'Additional signals: ' || array_to_string(list_transform(range(2, least(event_id % 4, 3) + 1), lambda k: ['cardio strain', 'locomotor overload', 'tactical drift'][(event_id + k) % 3 + 1]), ', ') || '. ' ELSE '' END
    ELSE CASE WHEN len({kept('>', 3)}) > 0 THEN 'Primary anomaly contributors: ' || array_to_string({kept('>', 3)}, '; ') || '. ' ELSE '' END || CASE WHEN len({kept('<', 2)}) > 0 THEN 'Anomaly-dampening signals: ' || array_to_string({kept('<', 2)}, '; ') || '. ' ELSE '' END END
 || ['Acute workload significantly exceeds chronic baseline — elevated injury risk. ', 'Recent load is below chronic baseline — reduced physical readiness. ', ''][event_id % 3 + 1] || 'Analysis is based on this player''s own historical data, not squad averages.') AS summary FROM ({oracle('telemetry')})"""
    return {
        "alert_summaries": texts,
        "workload_windows": f"{ww} SELECT match_id, player_id, bucket, current_load, {', '.join(ld)} FROM ww",
        "workload_events": f"""{ww}, {own}, {trend('current_load', 'ta')}, {trend('mean_speed', 'tb')}, pc AS (SELECT match_id, quantile_cont(current_load, 0.33) a, quantile_cont(current_load, 0.66) b FROM ow GROUP BY 1)
 SELECT '1' schema_version, match_id, player_id, 'player ' || player_id player_name, CASE WHEN player_id % 5 > 0 THEN 'pos' || player_id % 5 ELSE 'unknown' END AS position, bucket, elapsed_s, current_load, ta.trend load_trend, {', '.join(ld)}, tb.trend performance_trend,
 CASE WHEN current_load <= a THEN 'low' WHEN current_load >= b THEN 'high' ELSE 'normal' END workload_status FROM ow JOIN ta USING (match_id, player_id, bucket) JOIN tb USING (match_id, player_id, bucket) JOIN pc USING (match_id)""",
        "player_match_loads": f"{ww} SELECT match_id, player_id, {', '.join(f'round(sum({c}), 6) {c}' for c in ld)} FROM ww GROUP BY 1, 2",
        "match_timeline": f"""{ww}, sg(seg, lo, hi) AS (VALUES {segs}), pp AS (SELECT match_id, seg, player_id, {', '.join(f'sum({c}) {c}' for c in ld)} FROM ww JOIN sg ON elapsed_s / 60 >= lo AND elapsed_s / 60 < hi WHERE player_id % 2 = 0 GROUP BY 1, 2, 3),
 g AS (SELECT * FROM (SELECT DISTINCT match_id FROM ww) x, sg) SELECT match_id, seg AS segment, {', '.join(f'coalesce((SELECT round(sum({c}), 4) FROM pp WHERE pp.match_id = g.match_id AND pp.seg = g.seg), 0) {c}' for c in ld)}, (SELECT count(*) FROM pp WHERE pp.match_id = g.match_id AND pp.seg = g.seg) n_players, {lead} leaders FROM g""",
        "match_roster": f"{st}, {ded(('time_on_field_s',), ('position', 'team', 'ownership'))} SELECT match_id, player_id, position, team, time_on_field_s, ownership FROM dd",
        "player_match_metrics": f"""{st}, {ded(M.TOTALS, ('ownership',))}, lo AS (SELECT match_id, player_id, {', '.join(f'sum(sprints * {i + 1}) {c}' for i, c in enumerate(ld))} FROM st WHERE player_id % 3 > 0 GROUP BY 1, 2)
 SELECT match_id, player_id, ownership, distance_m, sprints, accelerations, decelerations, round(coalesce(distance_high_m, 0) + coalesce(distance_very_high_m, 0), 6) high_intensity_actions, {', '.join(ld)} FROM dd LEFT JOIN lo USING (match_id, player_id)""",
        "player_trends": f"""{st}, ow AS (SELECT *, coalesce(distance_high_m, 0) + coalesce(distance_very_high_m, 0) high_intensity_actions FROM st WHERE ownership = 'OWN'), {roll('ow', ('distance_m', 'sprints', 'accelerations', 'decelerations', 'high_intensity_actions'), 'begin_us o, match_id o2, 0 o3')} SELECT * FROM rl""",
        "load_trends": f"""{ww}, pl AS (SELECT match_id, player_id, {', '.join(f'round(sum({c}), 6) {c}' for c in ld)} FROM ww GROUP BY 1, 2), mm AS ({oracle('matches')}), pd AS (SELECT pl.*, mm.date FROM pl JOIN mm USING (match_id)), {roll('pd', ld, 'date o, match_id::VARCHAR o2, 0 o3')},
 ac AS (SELECT player_id, max(l) FILTER (k = 1) a, avg(l) FILTER (k <= 4) c FROM (SELECT player_id, acceleration_load + deceleration_load l, row_number() OVER (PARTITION BY player_id ORDER BY date DESC, match_id::VARCHAR DESC) k FROM pd) GROUP BY 1)
 SELECT rl.*, round(a, 6) acute_load, round(c, 6) chronic_load, CASE WHEN c <> 0 THEN round(a / c, 6) END acwr FROM rl JOIN ac USING (player_id)""",
        "first_per_match": f"WITH s0 AS ({oracle('stats')}) SELECT match_id, min(begin_us) begin_us, arg_min(team, begin_us) team, arg_min(ownership, begin_us) ownership FROM s0 GROUP BY 1",
        "newest_match": f"WITH mm AS ({oracle('matches')}) SELECT * FROM mm ORDER BY CAST(date AS DATE) DESC, match_id DESC LIMIT 1",
        "canonical_team": f"WITH t AS ({oracle('tactical')}) SELECT event_id, CASE team_id WHEN 'A' THEN 'Alpha' WHEN 'HOME' THEN 'Alpha' ELSE team_id END team_id FROM t",
        "label_windows": f"WITH bk AS ({oracle('buckets')}), sc AS ({oracle('scored')}), lb AS (SELECT player_id, bool_or(label = 1) l FROM sc WHERE event_id % 2 = 0 GROUP BY 1) SELECT match_id, player_id, bucket, coalesce(l, false) AS label FROM bk LEFT JOIN lb USING (player_id)",
        "window_stats": f"""WITH t AS ({oracle('telemetry')}), b AS (SELECT player_id, round(avg(speed_ms * 3), 6) distance_mean, round(stddev_pop(speed_ms * 3), 6) distance_std, round(avg(speed_ms), 6) mean_speed_mean, round(stddev_pop(speed_ms), 6) mean_speed_std, round(avg((speed_ms >= 5.5)::INT), 6) sprints_mean, round(stddev_pop((speed_ms >= 5.5)::INT), 6) sprints_std FROM t WHERE player_id % 6 > 0 GROUP BY 1),
 w AS (SELECT player_id, match_id, coalesce(sum(CASE WHEN event_id % 4 > 0 THEN speed_ms * 2 END), 0) distance, avg(speed_ms) mean_speed, count(*) FILTER (speed_ms >= 5.5) sprints FROM t GROUP BY 1, 2) SELECT player_id, match_id, round(distance, 6) distance, round(mean_speed, 9) mean_speed, sprints, {zz('distance')}, {zz('mean_speed')}, {zz('sprints')} FROM w LEFT JOIN b USING (player_id)""",
        "event_rows": f"WITH t AS ({oracle('telemetry')}) SELECT printf('p%03d', player_id) player_external_id, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%f') ts, match_id::VARCHAR match_id, 'tracking' AS source, speed_ms, acceleration_ms2 acceleration, heart_rate_bpm::INT heart_rate_bpm, round(x_pitch, 6) x_pitch, y_pitch, coalesce(speed_ms >= 5.5, false) is_sprint FROM t",
        "template_summary": f"""WITH sfq AS ({IQ.oracle_sql()['semantic_findings']}) SELECT match_id, player_id, bucket, CASE WHEN confidence >= 0.85 THEN 'Clear' WHEN confidence >= 0.7 THEN 'Likely' ELSE 'Possible' END || ' ' || replace(finding, '_', ' ') || ' (' || severity || ' severity, confidence ' || CAST(floor(confidence * 100 + 0.5) AS INT) || ' %).' || CASE WHEN trend = 'persistent' THEN ' It has lasted for several windows.' ELSE '' END summary FROM sfq WHERE rank = 1""",
    }
