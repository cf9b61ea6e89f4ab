"""Registered queries of findings, motifs, coupled states, escalation and recommendations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as N
from .views import oracle, view

KEYS = ("player_id", "match_id")
RENAMED = {"distance_z": "z_distance", "sprint_z": "z_sprint_count", "speed_z": "z_top_speed", "high_speed_z": "z_high_speed_dist"}
ATTRIBUTIONS = {
    "window_distance_m": "a_distance", "window_avg_speed_ms": "a_speed", "heart_rate_bpm": "a_hr", "hr_recovery_time_s": "a_recovery",
    "speed_drop_pct": "a_drop", "acwr": "a_acwr", "positional_drift_score": "a_drift", "z_distance": "a_distance",
}


def _features(spark, d):
    f = view(spark, d, "features")
    pairs = [x for name, c in ATTRIBUTIONS.items() for x in (F.lit(name), F.coalesce(c, F.lit(0.0)))]
    return f.withColumn("attribution", F.create_map(*pairs)).withColumnsRenamed(RENAMED)


def semantic_findings(spark, d):
    return N.semantic_findings(_features(spark, d), ("player_id", "match_id", "bucket"))


def _dated(spark, d):
    return semantic_findings(spark, d).withColumn("minute", F.col("bucket"))


def recommendation(spark, d):
    f = semantic_findings(spark, d).groupBy("player_id", "match_id", "bucket").agg(F.collect_set("finding").alias("fs"), F.collect_set("severity").alias("ss"))
    r = _features(spark, d).join(f, ["player_id", "match_id", "bucket"])
    level = F.when(F.col("seq") % 4 == 0, "high").otherwise("normal")
    trend = N.priority_trend(F.when(F.col("speed_drop_pct") > 0, F.array(F.lit("stable"), F.lit("worsening"))).otherwise(F.array(F.lit("declining"))))
    rec = N.recommendation(F.col("fs"), F.col("ss"), F.col("persistence_windows"), F.col("seq") % 3, level, trend, F.col("acwr"))
    return r.select("player_id", "match_id", "bucket", rec.alias("recommendation"))


def motifs(spark, d):
    return N.motifs(N.recent_findings(_dated(spark, d), KEYS, ("bucket", "rank")), KEYS)


def _transitions(spark, d):
    """Pairs of neighbouring windows' first findings within a match."""
    from pyspark.sql import Window as W

    f = semantic_findings(spark, d).filter("rank = 1")
    nxt = F.lead("finding").over(W.partitionBy(*KEYS).orderBy("bucket"))
    return f.withColumn("target", nxt).filter("target IS NOT NULL").groupBy(*KEYS, F.col("finding").alias("source"), "target").agg(F.count("*").alias("n"))


def _trends(spark, d):
    a = _features(spark, d).groupBy(*KEYS).agg(*[F.round(F.avg(c), 4).alias(n) for c, n in (("speed_drop_pct", "_w"), ("hr_recovery_time_s", "_r"), ("positional_drift_score", "_a"), ("acwr", "_q"))])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.select(
        *KEYS, F.when(zero("_w") > 5, "declining").otherwise("stable").alias("workload_direction"), F.when(zero("_r") > 0, "worsening").otherwise("recovering").alias("recovery_direction"), F.when(zero("_a") > 0.8, "worsening").otherwise("stable").alias("anomaly_direction"),
        F.when(zero("_q") > 1, "high").otherwise("low").alias("recovery_volatility"), F.lit("low").alias("workload_volatility"), F.when(zero("_a") > 1.5, "medium").otherwise("low").alias("anomaly_volatility"),
        (zero("_w") / 1000).alias("workload_slope"), zero("_r").alias("recovery_slope"), (zero("_a") / 10).alias("anomaly_slope"), F.lit(0.0).alias("workload_curvature"), (zero("_q") / 100).alias("recovery_curvature"), (zero("_a") / 100).alias("anomaly_curvature"),
        F.when(zero("_q") > 1.2, "accelerating_deterioration").otherwise("steady").alias("anomaly_acceleration"),
    )


def coupled_states(spark, d):
    return N.coupled_states(_trends(spark, d), _transitions(spark, d), KEYS)


def escalation(spark, d):
    persistent = semantic_findings(spark, d).filter("trend = 'persistent'").select(*KEYS, "severity")
    groups = view(spark, d, "features").select(*KEYS).distinct()
    return N.escalation(groups, motifs(spark, d), coupled_states(spark, d), persistent, _trends(spark, d), _transitions(spark, d), KEYS)


def policy_inputs(spark, d):
    f = semantic_findings(spark, d).filter("rank = 1")
    closed = f.filter("severity <> 'low'").select("player_id", "match_id", "finding")
    recurring = _transitions(spark, d).filter("n >= 1").select("player_id", "match_id", F.concat_ws(">", "source", "target").alias("pattern"))
    return N.policy_inputs(f.select("player_id", "match_id", "bucket", F.col("finding").alias("active")), closed, recurring, ("player_id", "match_id", "bucket"))


def relevant_episodes(spark, d):
    f = semantic_findings(spark, d).filter("rank = 1").withColumn("trend", F.when(F.col("bucket") % 3 == 0, "worsening").otherwise("stable"))
    current = semantic_findings(spark, d).groupBy("player_id", "match_id").agg(F.collect_set(F.when(F.col("severity") == "high", F.col("finding"))).alias("findings"))
    return N.relevant_episodes(f.select(*KEYS, F.col("bucket").alias("episode"), "finding", "trend", "severity"), current, KEYS)


def queries() -> dict:
    return {f.__name__: f for f in (semantic_findings, recommendation, motifs, coupled_states, escalation, policy_inputs, relevant_episodes)}


def oracle_sql() -> dict[str, str]:
    a = {n: f"coalesce({c}, 0)" for n, c in ATTRIBUTIONS.items()}
    has = lambda *cs: "(" + " OR ".join(f"abs({a[c]}) >= 0.05" for c in cs if c in a) + ")"
    bonus = lambda cs: " + ".join([f"CASE WHEN {on} THEN least(abs({a.get(c, '0')}) / 0.15::DOUBLE, 1) * 0.1::DOUBLE ELSE 0 END" for c, on in cs] or ["0"])
    used = lambda cs: "array_to_string([" + ", ".join(f"CASE WHEN {on} THEN '{c}' END" for c, on in cs) + "], ',')"
    g = "(SELECT * REPLACE (coalesce(heart_rate_bpm, 0) AS heart_rate_bpm, coalesce(hr_recovery_time_s, 0) AS hr_recovery_time_s, coalesce(speed_drop_pct, 0) AS speed_drop_pct, coalesce(acwr, 1) AS acwr, coalesce(positional_drift_score, 0) AS positional_drift_score), coalesce(distance_z, 0) z_distance, coalesce(sprint_z, 0) z_sprint_count, coalesce(speed_z, 0) z_top_speed, coalesce(high_speed_z, 0) z_high_speed_dist FROM ft0)"
    ok = "NOT (window_avg_speed_ms <= 0.1 AND window_distance_m > 90) AND window_distance_m >= 0 AND NOT (window_avg_speed_ms > 0.5 AND heart_rate_bpm > 0 AND (heart_rate_bpm < 30 OR heart_rate_bpm > 220))"
    last = "persistence_windows >= 3"
    high = f"CASE WHEN {last} THEN 'high' ELSE 'medium' END"
    imp = "hr_recovery_time_s >= 0.02"
    pa = f"heart_rate_bpm >= 175 AND {imp} AND {has('heart_rate_bpm', 'hr_recovery_time_s')}"
    pb = f"{imp} AND window_avg_speed_ms <= 2.5 AND {a['hr_recovery_time_s']} >= 0.15"
    z = [(c, f"{c} >= 1.5") for c in ("z_distance", "z_sprint_count", "z_top_speed", "z_high_speed_dist")]
    mk = [("hr_recovery_time_s", imp), ("speed_drop_pct", "speed_drop_pct >= 15"), ("fatigue_decay_residual", "fatigue_decay_residual >= 80"), ("acwr", "acwr >= 1.3")]
    n = lambda cs: "(" + " + ".join(f"({on})::INT" for _, on in cs) + ")"
    tired = [(c, f"(abs({a.get(c, '0')}) >= 0.05 OR {c} > 0)") for c in ("speed_drop_pct", "acwr", "fatigue_decay_residual", "window_avg_speed_ms", "window_sprint_count")]
    pull = f"greatest({a['window_avg_speed_ms']}, 0) + greatest({a['window_distance_m']}, 0)"
    t = lambda *cs: [(c, "true") for c in cs]
    rules = [
        ("'cardiovascular_overload'", pa, f"CASE WHEN heart_rate_bpm >= 185 AND {last} THEN 'critical' WHEN heart_rate_bpm >= 185 THEN 'high' ELSE 'medium' END", 0.75, t("heart_rate_bpm", "hr_recovery_time_s")),
        ("'elevated_cardiovascular_response'", f"NOT ({pa}) AND {pb}", high, 0.75, t("heart_rate_bpm", "hr_recovery_time_s")),
        ("'locomotor_overload'", f"{n(z)} >= 2 AND {has('window_distance_m', 'window_avg_speed_ms', 'z_distance')}", "CASE WHEN greatest(z_distance, z_sprint_count, z_top_speed, z_high_speed_dist) >= 2.5 THEN 'high' ELSE 'medium' END", 0.72, z),
        ("'recovery_degradation'", f"{n(mk)} >= 2 AND (" + " OR ".join(f"({on} AND abs({a.get(c, '0')}) >= 0.05)" for c, on in mk) + ")", f"CASE WHEN {n(mk)} >= 3 THEN 'high' ELSE 'medium' END", 0.68, mk),
        ("'tactical_instability'", f"positional_drift_score >= 1.2 AND {has('positional_drift_score')}", "CASE WHEN positional_drift_score >= 1.8 THEN 'high' ELSE 'low' END", 0.65, t("positional_drift_score")),
        ("'fatigue_accumulation'", f"speed_drop_pct >= 15 AND (acwr >= 1.3 OR fatigue_decay_residual >= 80) AND {has('speed_drop_pct', 'acwr', 'window_avg_speed_ms')}", high, 0.70, tired),
        ("'locomotor_suppression'", f"window_avg_speed_ms <= 2.5 AND {pull} > 0 AND {pull} >= 0.15", high, 0.72, t("window_avg_speed_ms", "window_distance_m")),
    ]
    union = " UNION ALL ".join(f"SELECT player_id, match_id, bucket, {name} finding, {sev} severity, round(least({base}::DOUBLE + ({bonus(fs)}), 0.98::DOUBLE), 9) confidence, {used(fs)} features, CASE WHEN {last} THEN 'persistent' ELSE 'stable' END trend FROM ft WHERE {ok} AND {when}" for name, when, sev, base, fs in rules)
    rank = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
    sf = f"WITH ft0 AS ({oracle('features')}), ft AS {g}, fu AS ({union}), sf AS (SELECT *, CAST(row_number() OVER (PARTITION BY player_id, match_id, bucket ORDER BY {rank} DESC, confidence DESC, finding) AS INT) AS rank FROM fu)"
    tr = f"{sf}, tr0 AS (SELECT player_id, match_id, finding AS source, lead(finding) OVER (PARTITION BY player_id, match_id ORDER BY bucket) AS target FROM sf WHERE rank = 1), tr AS (SELECT player_id, match_id, source, target, count(*) n FROM tr0 WHERE target IS NOT NULL GROUP BY ALL), tp AS (SELECT *, round(n / sum(n) OVER (PARTITION BY player_id, match_id, source), 3) p FROM tr)"
    td = """td0 AS (SELECT player_id, match_id, coalesce(round(avg(speed_drop_pct), 4), 0) w, coalesce(round(avg(hr_recovery_time_s), 4), 0) r, coalesce(round(avg(positional_drift_score), 4), 0) a, coalesce(round(avg(acwr), 4), 0) q FROM ft0 GROUP BY 1, 2),
 td AS (SELECT *, w > 5 wd, r > 0 rw, a > 0.8 aw, CASE WHEN q > 1 THEN 0.15 ELSE 0 END::DOUBLE rp, CASE WHEN a > 1.5 THEN 0.05 ELSE 0 END::DOUBLE ap FROM td0)"""
    best = lambda *ps: "greatest(" + ", ".join(f"coalesce((SELECT p FROM tp WHERE tp.player_id = td.player_id AND tp.match_id = td.match_id AND tp.source = '{x}' AND tp.target = '{y}'), 0)" for x, y in ps) + ", 0)"
    lo, cv, rc = "locomotor_overload", "cardiovascular_overload", "recovery_degradation"
    conf = lambda dirs, slope, curve, pen, *ps: f"round(least(1, round(least(1, greatest(0, 0.45::DOUBLE + 0.3::DOUBLE * ({dirs}) + 0.15::DOUBLE * least(1, 5 * ({slope})) + 0.1::DOUBLE * least(1, 20 * ({curve})) - {pen})), 3) + 0.15::DOUBLE * {best(*ps)}), 3)"
    cs = " UNION ALL ".join([
        f"SELECT player_id, match_id, 'fatigue_accumulation_under_load' state, 'high' severity, {conf('1', '(abs(w / 1000) + abs(r)) / 2', '(q / 100) / 2', 'rp', (lo, rc), (cv, rc))} confidence FROM td WHERE wd AND rw",
        f"SELECT player_id, match_id, 'systemic_instability', 'critical', {conf('1', '(abs(a / 10) + abs(r)) / 2', '(a / 100 + q / 100) / 2', 'greatest(rp, ap)', (cv, rc), (lo, cv))} FROM td WHERE aw AND rw",
        f"SELECT player_id, match_id, 'unstable_recovery_response', 'medium', {conf('1', 'abs(r)', 'q / 100', 'rp', (rc, cv))} FROM td WHERE q > 1 AND rw",
        f"SELECT player_id, match_id, 'accelerating_instability', 'high', {conf('1', 'abs(a / 10)', 'a / 100', 'ap', (lo, cv))} FROM td WHERE aw AND q > 1.2",
    ])
    # recent findings in order, the motifs from joins over positions
    mo = f"""ro AS (SELECT *, row_number() OVER (PARTITION BY player_id, match_id ORDER BY bucket DESC, rank DESC) back FROM sf), rf AS (SELECT player_id, match_id, finding, severity, confidence, bucket AS minute, row_number() OVER (PARTITION BY player_id, match_id ORDER BY bucket, rank) i FROM ro WHERE back <= 50),
 rn AS (SELECT player_id, match_id, count(*) n FROM rf GROUP BY 1, 2),
 pg0 AS (SELECT s.player_id, s.match_id, s.i s, (SELECT min(x.i) FROM rf x WHERE x.player_id = s.player_id AND x.match_id = s.match_id AND x.finding = '{lo}' AND x.i BETWEEN s.i AND s.i + 9) e1 FROM rf s JOIN rn USING (player_id, match_id) WHERE s.i <= n - 2),
 pg1 AS (SELECT *, (SELECT min(x.i) FROM rf x WHERE x.player_id = g.player_id AND x.match_id = g.match_id AND x.finding = '{cv}' AND x.i > g.e1 AND x.i <= g.s + 9) e2 FROM pg0 g),
 pg2 AS (SELECT *, (SELECT min(x.i) FROM rf x WHERE x.player_id = g.player_id AND x.match_id = g.match_id AND x.finding = '{rc}' AND x.i > g.e2 AND x.i <= g.s + 9) e3 FROM pg1 g),
 pg AS (SELECT player_id, match_id, min(s) s, arg_min(e3, s) e FROM pg2 WHERE e3 IS NOT NULL GROUP BY 1, 2),
 ct AS (SELECT player_id, match_id, finding, count(*) c FROM rf GROUP BY 1, 2, 3),
 cc AS (SELECT player_id, match_id, coalesce(max(c) FILTER (finding = '{lo}'), 0) lo, coalesce(max(c) FILTER (finding = '{cv}'), 0) cv, coalesce(max(c) FILTER (finding = '{rc}'), 0) rc, coalesce(max(c) FILTER (finding = 'fatigue_accumulation'), 0) fa, coalesce(max(c) FILTER (finding = 'tactical_instability'), 0) ti FROM ct GROUP BY 1, 2),
 ev AS (SELECT rf.*, 'sprint_collapse_progression' motif, 'high' sev FROM rf JOIN pg USING (player_id, match_id) WHERE i BETWEEN s AND e
  UNION ALL SELECT rf.*, 'persistent_cardiovascular_overload', 'high' FROM rf JOIN cc USING (player_id, match_id) ANTI JOIN pg USING (player_id, match_id) WHERE cv >= 3 AND finding = '{cv}'
  UNION ALL SELECT rf.*, 'sprint_collapse_motif', 'high' FROM rf JOIN cc USING (player_id, match_id) ANTI JOIN pg USING (player_id, match_id) WHERE lo >= 2 AND cv >= 1 AND rc >= 1 AND finding IN ('{lo}', '{cv}', '{rc}')
  UNION ALL SELECT rf.*, 'fatigue_tactical_drift', 'medium' FROM rf JOIN cc USING (player_id, match_id) WHERE fa >= 1 AND ti >= 1 AND finding IN ('fatigue_accumulation', 'tactical_instability')
  UNION ALL SELECT rf.*, 'persistent_' || finding, 'medium' FROM rf JOIN ct USING (player_id, match_id, finding) LEFT JOIN pg USING (player_id, match_id) WHERE c >= 3 AND NOT (pg.s IS NOT NULL AND finding IN ('{lo}', '{cv}', '{rc}')) AND NOT (pg.s IS NULL AND finding = '{cv}')
  UNION ALL SELECT rf.*, 'acute_severity_escalation', 'critical' FROM rf JOIN rn USING (player_id, match_id) JOIN (SELECT player_id, match_id FROM rf JOIN rn USING (player_id, match_id) WHERE i > n - 3 AND severity IN ('high', 'critical') GROUP BY 1, 2 HAVING count(*) = 3) h USING (player_id, match_id) WHERE i > n - 3),
 em AS (SELECT *, max(minute) OVER (PARTITION BY player_id, match_id, motif) mx, min(minute) OVER (PARTITION BY player_id, match_id, motif) mn FROM ev),
 mo AS (SELECT player_id, match_id, motif, any_value(sev) severity, round(least(1, greatest(0, 0.5::DOUBLE * sum(exp(-0.15::DOUBLE * (mx - minute)) * confidence) / sum(exp(-0.15::DOUBLE * (mx - minute))) + 0.3::DOUBLE * least(1, log10(count(*) + 1)) + 0.2::DOUBLE * greatest(0.2::DOUBLE, 1 - (any_value(mx) - any_value(mn)) / 12))), 3) confidence FROM em GROUP BY 1, 2, 3)"""
    pr = lambda x, y: f"coalesce(max(p) FILTER (source = '{x}' AND target = '{y}'), 0)"
    return {
        "semantic_findings": f"{sf} SELECT * FROM sf",
        "recommendation": f"""{sf}, fs AS (SELECT player_id, match_id, bucket, list(finding) f, list(severity) s FROM sf GROUP BY 1, 2, 3), j AS (SELECT f.*, w.persistence_windows p, w.seq % 3 rec, w.seq % 4 = 0 hot, coalesce(w.speed_drop_pct > 0, false) worse, coalesce(w.acwr, 0) q FROM fs f JOIN ft0 w USING (player_id, match_id, bucket))
 SELECT player_id, match_id, bucket, CASE WHEN rec >= 2 AND p >= 4 AND hot THEN 'substitute' WHEN list_has_any(f, ['{rc}', '{cv}', 'elevated_cardiovascular_response']) AND list_has_any(s, ['high', 'critical']) AND p >= 3 THEN 'recovery_intervention'
 WHEN (list_contains(f, 'fatigue_accumulation') OR q >= 1.3) AND p >= 2 THEN 'workload_restriction' WHEN list_contains(f, 'tactical_instability') THEN 'tactical_adjustment' WHEN list_has_any(f, ['locomotor_suppression', '{lo}']) AND worse THEN 'performance_monitor' ELSE 'anomaly_flag' END recommendation FROM j""",
        "motifs": f"{sf}, {mo} SELECT * FROM mo",
        "coupled_states": f"{tr}, {td} {cs}",
        "escalation": f"""{tr}, {td}, cs AS ({cs}), {mo}, m AS (SELECT player_id, match_id, least(1, sum(CASE motif WHEN 'sprint_collapse_progression' THEN 4 WHEN 'persistent_cardiovascular_overload' THEN 3 WHEN 'fatigue_tactical_drift' THEN 3 WHEN 'acute_severity_escalation' THEN 4 ELSE 1 END) / 8) v, bool_or(severity = 'critical') c FROM mo GROUP BY 1, 2),
 c AS (SELECT player_id, match_id, least(1, sum(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 0.6 WHEN 'medium' THEN 0.3 ELSE 0.1 END::DOUBLE) / 2) v, bool_or(severity = 'critical') c FROM cs GROUP BY 1, 2),
 p AS (SELECT player_id, match_id, least(1, count(*) / 5) v, bool_or(severity = 'critical') c, count(*) FILTER (severity IN ('high', 'critical')) h FROM sf WHERE trend = 'persistent' GROUP BY 1, 2),
 x AS (SELECT player_id, match_id, least(1, ({pr(lo, cv)} + {pr(cv, rc)}) / 2) v FROM tp GROUP BY 1, 2),
 j AS (SELECT td.player_id, td.match_id, coalesce(m.v, 0) mr, coalesce(c.v, 0) cr, coalesce(p.v, 0) sr, (wd::INT + rw::INT + aw::INT) / 3 ir, coalesce(x.v, 0) tr, coalesce(m.c, false) OR coalesce(c.c, false) OR coalesce(p.c, false) crit, coalesce(p.h, 0) h FROM td LEFT JOIN m USING (player_id, match_id) LEFT JOIN c USING (player_id, match_id) LEFT JOIN p USING (player_id, match_id) LEFT JOIN x USING (player_id, match_id)),
 k AS (SELECT *, 0.25::DOUBLE * mr + 0.25::DOUBLE * cr + 0.2::DOUBLE * sr + 0.15::DOUBLE * ir + 0.15::DOUBLE * tr s FROM j)
 SELECT player_id, match_id, round(mr, 3) motif_risk, round(cr, 3) coupled_risk, round(sr, 3) persistence_risk, round(ir, 3) instability_risk, round(tr, 3) transition_risk, round(s, 6) total_risk, CASE WHEN crit THEN 'critical' WHEN h >= 2 OR round(s, 9) >= 0.45 THEN 'high' WHEN round(s, 9) >= 0.2 THEN 'elevated' ELSE 'normal' END AS level FROM k""",
        "policy_inputs": f"""{tr}, f AS (SELECT * FROM sf WHERE rank = 1) SELECT player_id, match_id, bucket, finding AS active, (SELECT count(*) FROM tr WHERE tr.player_id = f.player_id AND tr.match_id = f.match_id AND f.finding IN (tr.source, tr.target)) in_match_recurrence,
 (SELECT count(*) FROM f e WHERE e.player_id = f.player_id AND e.match_id <> f.match_id AND e.finding = f.finding AND e.severity <> 'low') cross_match_recurrence FROM f""",
        "relevant_episodes": f"""{sf}, f AS (SELECT *, row_number() OVER (PARTITION BY player_id, match_id ORDER BY bucket) / count(*) OVER (PARTITION BY player_id, match_id) rec FROM sf WHERE rank = 1), s AS (SELECT f.*, round(CASE WHEN EXISTS (FROM sf c WHERE c.player_id = f.player_id AND c.match_id = f.match_id AND c.severity = 'high' AND c.finding = f.finding) THEN 2 ELSE 0 END + CASE WHEN bucket % 3 = 0 THEN 1 ELSE 0 END + CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 0.6::DOUBLE WHEN 'medium' THEN 0.3::DOUBLE ELSE 0 END + rec, 6) relevance FROM f),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY player_id, match_id ORDER BY relevance DESC, bucket DESC) AS INT) rk FROM s) SELECT player_id, match_id, rk AS rank, bucket AS episode, finding, relevance FROM r WHERE rk <= 3""",
    }
