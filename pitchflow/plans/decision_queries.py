"""Registered queries of calibration, decisions, adaptation and published records, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import evaluation as E
from ..operators import scoring
from . import insight_queries as IQ
from .views import oracle, view

ORDER = ("t_us", "event_id")


def _losses(spark, d):
    """Scored windows with a regime by their speed."""
    s = view(spark, d, "scored")
    return s.select("player_id", *ORDER, F.col("score").alias("loss"), "label", F.when(F.col("event_id") % 7 < 4, "middle__low").otherwise("attacking__high").alias("regime"), ((F.col("event_id") % 10) / 10).alias("confidence"), F.floor(F.col("t_us") / F.lit(604800000000)).cast("long").alias("match_id"))


def calibration_losses(spark, d):
    return D.calibration_losses(_losses(spark, d), "player_id", ORDER, "loss").select("event_id", F.round("smoothed", 9).alias("smoothed"))


def score_decisions(spark, d):
    f = view(spark, d, "features")
    s = f.select(F.concat_ws("|", "player_id", "bucket").alias("window"), "player_id", F.col("window_distance_m").alias("smoothed"), F.when(F.col("seq") % 9 > 0, F.lit(45.0)).otherwise(F.lit(float("inf"))).alias("threshold"), F.round(F.least(F.lit(1.0), F.col("window_distance_m") / 100), 6).alias("confidence"), F.col("window_avg_speed_ms").alias("speed_ms"), (F.col("window_sprint_count") % 2).alias("sprint_flag"), (F.col("seq") * 300).alias("elapsed_s"))
    c = f.groupBy("player_id").agg(F.round(F.avg("window_distance_m") * 1000, 6).alias("distance_mean"), F.max("positional_drift_score").alias("drift_score"), (F.max("positional_drift_score") > 2).alias("drift_flagged"), F.max("acwr").alias("acwr"))
    r = D.score_decisions(s, c.filter("player_id % 11 > 0"), "window")
    text = F.array_join(F.transform("signals", lambda x: F.concat_ws(":", x.category, F.coalesce(x.subtype, F.lit("-")), x.severity, F.format_number(x.confidence, 4))), ";")
    return r.withColumn("signals", text)


def fp_budget_threshold(spark, d):
    return D.fp_budget_threshold(_losses(spark, d).withColumnRenamed("loss", "score"), None, 4.0).select(F.col("threshold").cast("double").alias("threshold"))


def fp_budget_by_player(spark, d):
    return D.fp_budget_threshold(_losses(spark, d).withColumnRenamed("loss", "score"), "player_id", 4.0)


def evaluate_decisions(spark, d):
    s = _losses(spark, d)
    return D.evaluate_decisions(s.filter("event_id % 3 = 0"), s.filter("event_id % 3 > 0"), ORDER).drop("t_us")


def adapt_thresholds(spark, d):
    return D.adapt_thresholds(_losses(spark, d), quarantine=8, cooldown_us=86_400_000_000, drift=0.6, cap=40)


def _channels(spark, d):
    s = view(spark, d, "features")
    return s.select("player_id", "bucket", "positional_drift_score", F.create_map(*[x for c, v in (("speed_ms", "a_speed"), ("acceleration_ms2", "a_drop"), ("heart_rate_bpm", "a_hr"), ("x_pitch", "a_drift"), ("y_pitch", "a_acwr"), ("distance_delta_m", "a_distance"), ("hr_recovery_rate", "a_recovery")) for x in (F.lit(c), F.coalesce(v, F.lit(0.0)))]).alias("attribution"))


def coach_attribution(spark, d):
    drift = F.when(F.col("player_id") % 2 == 0, F.col("positional_drift_score")).otherwise(0.0)
    x = _channels(spark, d).select("player_id", "bucket", D.coach_attribution(F.col("attribution"), F.coalesce(drift, F.lit(0.0))).alias("a"))
    return x.select("player_id", "bucket", F.explode("a").alias("feature", "value")).filter("value <> 0").withColumn("value", F.round("value", 12))


def magnitude_proxy(spark, d):
    x = _channels(spark, d).select("player_id", "bucket", D.magnitude_proxy(F.col("attribution"), F.lit(2.5)).alias("a"))
    return x.select("player_id", "bucket", F.explode("a").alias("feature", "value")).withColumn("value", F.round("value", 9))


def xai_features(spark, d):
    t = view(spark, d, "telemetry").select("player_id", "event_id", "speed_ms", F.col("heart_rate_bpm").cast("double").alias("heart_rate_bpm"), F.when(F.col("speed_ms") >= 5.5, 1.0).otherwise(0.0).alias("sprint_flag"), (F.col("speed_ms") * 1.5).alias("distance_delta_m"), ((F.col("event_id") % 9 - 4) / 10).alias("hr_recovery_rate"))
    b = t.filter("player_id % 4 > 0").groupBy("player_id").agg(*[x for c, e in (("distance", F.col("distance_delta_m") * 8), ("sprint_count", F.col("sprint_flag") * 10), ("top_speed", F.col("speed_ms")), ("high_speed_dist", F.col("distance_delta_m") * 2)) for x in (F.round(F.avg(e), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(e), 6).alias(f"{c}_std"))])
    return D.xai_features(t, b).drop("speed_ms", "heart_rate_bpm", "sprint_flag", "distance_delta_m", "hr_recovery_rate")


def score_events(spark, d):
    s = _losses(spark, d).withColumns({"threshold": F.when(F.col("player_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.lit(75.0)), "tracker_source": F.when(F.col("event_id") % 2 == 0, "regime").otherwise("player")})
    return D.score_events(s)


def resolved_thresholds(spark, d):
    """Every fourth player has few losses, and one regime is rare."""
    few = _losses(spark, d).filter("player_id % 4 > 0 OR event_id % 5 = 0").withColumn("regime", F.when(F.col("event_id") % 997 == 0, "defensive__low").otherwise(F.col("regime")))
    return scoring.resolve_thresholds(few, "regime", "player_id", "loss", pilot=True)


def score_measures(spark, d):
    """Records with measures: windows of the features, against their players' own means."""
    f = view(spark, d, "features")
    names = {"distance": "window_distance_m", "speed": "window_avg_speed_ms", "sprint": "window_sprint_count"}
    base = f.filter("player_id % 7 > 0").groupBy("player_id").agg(*[x for n, c in names.items() for x in (F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"))])
    z = D.baseline_z(f, base, names)
    decided = z.select("player_id", "match_id", F.col("bucket").alias("event_id"), F.col("window_distance_m").alias("loss"), F.lit(0.5).alias("confidence"), F.when(F.col("seq") % 4 > 0, F.lit(45.0)).otherwise(F.lit(float("inf"))).alias("threshold"), F.lit("middle__low").alias("regime"), F.lit("per_player").alias("tracker_source"), "window_distance_m", "window_avg_speed_ms", F.col("window_sprint_count").alias("window_sprint_ticks"), *[f"baseline_{n}_z" for n in names])
    return D.score_events(decided, measures=True)


def feature_importance(spark, d):
    c = _channels(spark, d)
    return D.compare_importance(D.feature_importance(c), D.feature_importance(c.filter("player_id % 2 = 0")))


def inference_log(spark, d):
    context = view(spark, d, "features").groupBy("player_id", "match_id").agg(F.when(F.max("acwr") > 2, "critical").when(F.max("acwr") > 1.5, "high").alias("escalation"), F.sum("window_sprint_count").alias("cross_match_recurrence"), F.lit("locomotor_overload").alias("active"))
    s = _losses(spark, d).withColumn("is_anomaly", F.col("loss") > 80)
    return D.inference_log(s, context.filter("player_id % 5 > 0"), ("player_id", "match_id"))


def alert_payload(spark, d):
    s = _losses(spark, d).withColumns({"passed": (F.col("label") == 1) & (F.col("loss") > 20), "recommendation_type": F.lit("anomaly_flag"), "anomaly_score": F.col("loss"), "attribution": F.create_map(F.lit("speed"), F.col("loss"), F.lit("load"), -F.col("loss") / 2)})
    p = D.alert_payload(s, ORDER)
    return p.select("event_id", "player_id", "gate_windows", F.get_json_object("payload", "$.top_features[1].feature").alias("second"), F.get_json_object("payload", "$.recommendation_type").alias("kind"), F.get_json_object("payload", "$.external_id").alias("external_id"))


def audit_report(spark, d):
    a = E.fairness_audit(view(spark, d, "inferences"), ("position", "nationality"), 0.02)
    return D.audit_report(a)


def queries() -> dict:
    return {f.__name__: f for f in (calibration_losses, score_decisions, fp_budget_threshold, fp_budget_by_player, evaluate_decisions, adapt_thresholds, coach_attribution, magnitude_proxy, xai_features, score_events, resolved_thresholds, score_measures, feature_importance, inference_log, alert_payload, audit_report)}


def oracle_sql() -> dict[str, str]:
    ls = f"ls AS (SELECT player_id, t_us, event_id, score AS loss, label, CASE WHEN event_id % 7 < 4 THEN 'middle__low' ELSE 'attacking__high' END regime, (event_id % 10) / 10 AS confidence, CAST(floor(t_us / 604800000000) AS BIGINT) match_id FROM ({oracle('scored')}))"
    fold = lambda src, out: f"""q AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY t_us, event_id) rn FROM {src}), fo AS (SELECT player_id, event_id, rn, loss s FROM q WHERE rn = 1
 UNION ALL SELECT q.player_id, q.event_id, q.rn, 0.25::DOUBLE * q.loss + 0.75::DOUBLE * fo.s FROM fo JOIN q ON q.player_id = fo.player_id AND q.rn = fo.rn + 1) {out}"""  # noqa: E731
    thr = lambda src, by: f"""SELECT {by}, CASE WHEN n < 30 THEN NULL WHEN n_clean >= 150 THEN hi ELSE mid + 5 * 1.4826::DOUBLE * mad END threshold FROM (SELECT {by}, quantile_cont(loss, 0.5) mid, quantile_cont(loss, 0.995) hi, count(*) n_clean, any_value(n) n, any_value(mad) mad FROM (SELECT *, quantile_cont(abs(loss - mid0), 0.5) OVER (PARTITION BY {by}) mad FROM (
 SELECT *, quantile_cont(loss, 0.5) OVER (PARTITION BY {by}) mid0 FROM (SELECT *, count(*) FILTER (loss <= p) OVER (PARTITION BY {by}) kept FROM (SELECT *, quantile_cont(loss, 0.95) OVER (PARTITION BY {by}) p, count(*) OVER (PARTITION BY {by}) n FROM {src})) WHERE kept < 15 OR loss <= p)) GROUP BY {by})"""  # noqa: E731
    ft = f"ft AS ({oracle('features')})"
    ch = (("speed_ms", "a_speed"), ("acceleration_ms2", "a_drop"), ("heart_rate_bpm", "a_hr"), ("x_pitch", "a_drift"), ("y_pitch", "a_acwr"), ("distance_delta_m", "a_distance"), ("hr_recovery_rate", "a_recovery"))
    z = {c: f"coalesce({v}, 0)" for c, v in ch}
    long = " UNION ALL ".join(f"SELECT player_id, bucket, '{c}' feature, {e} AS v FROM ft" for c, e in z.items())
    x, y = z["x_pitch"], z["y_pitch"]
    drift = "CASE WHEN player_id % 2 = 0 THEN coalesce(positional_drift_score, 0) ELSE 0 END"
    coach = {"window_avg_speed_ms": f"{z['speed_ms']} + {z['acceleration_ms2']}", "heart_rate_bpm": z["heart_rate_bpm"], "window_distance_m": z["distance_delta_m"], "hr_recovery_time_s": z["hr_recovery_rate"], "positional_drift_score": f"CASE WHEN {drift} > 0 THEN {drift} ELSE sign({x} + {y}) * sqrt({x} * {x} + {y} * {y}) END"}
    zs = (("distance", "distance_delta_m * 8"), ("sprint_count", "sprint_flag * 10"), ("top_speed", "speed_ms"), ("high_speed_dist", "distance_delta_m * 2"))
    seen = {"distance": "distance_delta_m * 8", "sprint_count": "sprint_flag * 10", "top_speed": "speed_ms", "high_speed_dist": "distance_delta_m * 8 * 0.28::DOUBLE"}
    imp = lambda where: f"SELECT feature, round(avg(abs(v)), 9) importance, row_number() OVER (ORDER BY round(avg(abs(v)), 9) DESC, feature) rk FROM lg WHERE {where} GROUP BY feature"
    slow, nos, late = "coalesce(speed_ms / greatest(CASE WHEN distance_mean > 0 THEN distance_mean / 3600 ELSE 3.5 END, 0.1) < 0.55, false)", "sprint_flag = 0", "elapsed_s > 1800"
    conf = lambda e: f"printf('%.4f', {e})"
    budget = lambda by: f"""c AS (SELECT {by} loss s, (SELECT count(*) FROM ls b WHERE b.label = 0 AND b.loss >= a.loss {'AND b.player_id = a.player_id' if by else ''}) fp FROM (SELECT DISTINCT {by} loss FROM ls) a), t AS (SELECT {by} count(*) FILTER (label = 0) nn, count(*) n, max(loss) hi FROM ls {'GROUP BY player_id' if by else ''})
 SELECT {by} coalesce(min(CASE WHEN fp / greatest(nn, 1) <= 4 / greatest(45 * nn / n, 1e-6) THEN s END), max(hi)) threshold FROM c {'JOIN t USING (player_id) GROUP BY player_id' if by else ', t'}"""  # noqa: E731
    fa = f"""WITH ev AS ({oracle("inferences")}), lg AS (SELECT is_anomaly, 'position' attribute, position::VARCHAR AS g FROM ev UNION ALL SELECT is_anomaly, 'nationality', nationality::VARCHAR FROM ev), o AS (SELECT avg(is_anomaly) o FROM ev), au AS (SELECT attribute, g, round(avg(is_anomaly), 9) rate, count(*) n, round(avg(is_anomaly) - any_value(o), 9) delta, abs(avg(is_anomaly) - any_value(o)) > 0.02 biased FROM lg, o WHERE g IS NOT NULL GROUP BY 1, 2)"""
    return {
        "calibration_losses": f"WITH RECURSIVE {ls}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY t_us, event_id) r0, count(*) OVER (PARTITION BY player_id) n FROM ls) WHERE r0 > floor(n * 0.8::DOUBLE)), {fold('k', 'SELECT event_id, round(s, 9) smoothed FROM fo')}",
        "score_decisions": f"""WITH RECURSIVE {ft}, cx AS (SELECT player_id, round(avg(window_distance_m) * 1000, 6) distance_mean, max(positional_drift_score) drift_score, max(positional_drift_score) > 2 drift_flagged, max(acwr) q0 FROM ft WHERE player_id % 11 > 0 GROUP BY 1),
 s AS (SELECT player_id || '|' || bucket AS "window", f.player_id, bucket, window_distance_m, seq, round(least(1, window_distance_m / 100), 6) c, window_avg_speed_ms speed_ms, window_sprint_count % 2 sprint_flag, seq * 300 elapsed_s, distance_mean, coalesce(drift_score, 0) ds, coalesce(drift_flagged, false) df, coalesce(q0, 1) q FROM ft f LEFT JOIN cx USING (player_id)),
 a AS (SELECT *, seq % 9 > 0 AND window_distance_m > 45 an, ({slow}) sl, ({nos}) ns, ({late}) la FROM s), b AS (SELECT *, an AND (sl OR ns) AND la fa, q > 1.5 OR q < 0.8 wf FROM a),
 u AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY seq, "window") rn FROM b), l AS (SELECT player_id, rn, unnest([{{k: 'anomaly', a: an}}, {{k: 'fatigue', a: fa}}, {{k: 'drift', a: df}}, {{k: 'workload', a: wf}}], recursive := true) FROM u),
 m AS (SELECT DISTINCT player_id, k, CAST(0 AS BIGINT) rn, 0 s, 0 p, 0 q FROM l UNION ALL SELECT l.player_id, l.k, l.rn, CASE WHEN l.a THEN greatest(m.s, CASE WHEN m.p + 1 >= 10 THEN 3 WHEN m.p + 1 >= 3 THEN 2 ELSE 0 END) WHEN m.q + 1 >= 3 THEN 0 ELSE m.s END, CASE WHEN l.a THEN m.p + 1 ELSE 0 END, CASE WHEN l.a THEN 0 ELSE m.q + 1 END FROM m JOIN l ON l.player_id = m.player_id AND l.k = m.k AND l.rn = m.rn + 1),
 v AS (SELECT player_id, rn, bool_or(k = 'anomaly' AND s >= 2) x1, bool_or(k = 'fatigue' AND s >= 2) x2, bool_or(k = 'drift' AND s >= 2) x3, bool_or(k = 'workload' AND s >= 2) x4, max(s) FILTER (k = 'anomaly') s, max(p) FILTER (k = 'anomaly') p FROM m WHERE rn > 0 GROUP BY 1, 2)
 SELECT "window", player_id, x1 is_anomaly, x2 fatigue_flag, x3 drift_flag, x4 workload_flag, ['NONE', 'WATCH', 'WARNING', 'CRITICAL'][s + 1] alert_level, p persistence, coalesce(array_to_string([CASE WHEN x1 THEN 'anomaly:-:' || CASE WHEN c > 0.85 THEN 'high' ELSE 'medium' END || ':' || {conf('c')} END, CASE WHEN x2 THEN 'fatigue:' || CASE WHEN sl AND ns THEN 'speed_sprint_decline' WHEN sl THEN 'speed_decline' ELSE 'sprint_decline' END || CASE WHEN la THEN ':high:' ELSE ':medium:' END || {conf('c')} END,
  CASE WHEN x3 THEN 'drift:positional_zone_violation:medium:' || {conf('ds')} END, CASE WHEN x4 THEN 'workload:' || CASE WHEN q > 1.5 THEN 'acwr_overload' ELSE 'acwr_underload' END || ':' || CASE WHEN q > 1.8 OR q < 0.6 THEN 'high' ELSE 'medium' END || ':1.0000' END], ';'), '') signals FROM u JOIN v USING (player_id, rn)""",
        "resolved_thresholds": f"""WITH {ls}, fw AS (SELECT player_id, loss, CASE WHEN event_id % 997 = 0 THEN 'defensive__low' ELSE regime END AS regime, 1 AS one FROM ls WHERE player_id % 4 > 0 OR event_id % 5 = 0), fk AS (SELECT *, player_id || '|' || regime AS k FROM fw),
 tk AS ({thr('fk', 'k')}), tp AS ({thr('fk', 'player_id')}), tr AS ({thr('fk', 'regime')}), ta AS ({thr('fk', 'one')})
 SELECT d.player_id, d.regime, round(CASE WHEN tp.threshold IS NOT NULL THEN coalesce(tk.threshold, tp.threshold) ELSE coalesce(tr.threshold, ta.threshold) END, 9) AS threshold, CASE WHEN tp.threshold IS NOT NULL THEN 'per_player' WHEN ta.threshold IS NOT NULL THEN 'pilot_pooled' ELSE 'none' END AS source
 FROM (SELECT DISTINCT player_id, regime, k FROM fk) d LEFT JOIN tk ON tk.k = d.k LEFT JOIN tp ON tp.player_id = d.player_id LEFT JOIN tr ON tr.regime = d.regime, ta""",
        "score_measures": f"""WITH {ft}, b AS (SELECT player_id, avg(window_distance_m) m1, stddev_pop(window_distance_m) s1, avg(window_avg_speed_ms) m2, stddev_pop(window_avg_speed_ms) s2, avg(window_sprint_count) m3, stddev_pop(window_sprint_count) s3 FROM ft WHERE player_id % 7 > 0 GROUP BY 1)
 SELECT '1' schema_version, f.player_id, format('p{{:03d}}', f.player_id) external_id, match_id::VARCHAR match_id, bucket event_id, window_distance_m reconstruction_loss, 0.5::DOUBLE confidence, CASE WHEN seq % 4 > 0 THEN 45::DOUBLE END threshold, seq % 4 > 0 AND window_distance_m > 45 raw_threshold_breach, 'middle__low' regime, 'per_player' tracker_source,
 window_distance_m, window_avg_speed_ms, window_sprint_count::BIGINT window_sprint_ticks, round(coalesce(CASE WHEN s1 > 1e-9 THEN (window_distance_m - m1) / s1 END, 0), 6) baseline_distance_z, round(coalesce(CASE WHEN s2 > 1e-9 THEN (window_avg_speed_ms - m2) / s2 END, 0), 6) baseline_speed_z,
 round(coalesce(CASE WHEN s3 > 1e-9 THEN (window_sprint_count - m3) / s3 END, 0), 6) baseline_sprint_z, 0::DOUBLE session_total_distance_m, 0::DOUBLE session_high_speed_distance_m FROM ft f LEFT JOIN b USING (player_id)""",
        "fp_budget_threshold": f"WITH {ls}, {budget('')}",
        "fp_budget_by_player": f"WITH {ls}, {budget('player_id,')}",
        "evaluate_decisions": f"""WITH RECURSIVE {ls}, ca AS (SELECT *, player_id || '|' || regime k FROM ls WHERE event_id % 3 > 0), ev AS (SELECT * FROM ls WHERE event_id % 3 = 0), {fold('ev', '')}, fk AS ({thr('ca', 'k')}), gk AS ({thr('ca', 'player_id')}),
 hp AS (SELECT player_id, regime, count(*) n, quantile_cont(loss, 0.999) p FROM ca GROUP BY 1, 2),
 j AS (SELECT e.player_id, e.regime, e.event_id, fo.s, CASE WHEN hp.n IS NOT NULL THEN coalesce(fk.threshold, gk.threshold) ELSE gk.threshold END b, hp.n, hp.p FROM ev e JOIN fo USING (player_id, event_id) LEFT JOIN fk ON fk.k = e.player_id || '|' || e.regime LEFT JOIN gk ON gk.player_id = e.player_id LEFT JOIN hp ON hp.player_id = e.player_id AND hp.regime = e.regime),
 t AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN n >= 20 THEN greatest(round(b, 9), p) ELSE round(b, 9) END o FROM j) SELECT player_id, regime, event_id, round(s, 9) smoothed, round(o, 9) threshold, coalesce(s > o, false) is_anomaly FROM t""",
        "coach_attribution": f"WITH {ft}, lg AS ({' UNION ALL '.join(f'SELECT player_id, bucket, {chr(39)}{c}{chr(39)} feature, {e} AS v FROM ft' for c, e in coach.items())}) SELECT player_id, bucket, feature, round(v, 12) AS value FROM lg WHERE v <> 0",
        "magnitude_proxy": f"WITH {ft}, lg AS ({long}), t AS (SELECT player_id, bucket, sum(abs(v)) s FROM lg GROUP BY 1, 2) SELECT player_id, bucket, feature, round(CASE WHEN s > 0 THEN v / s * 2.5::DOUBLE ELSE 0 END, 9) AS value FROM lg JOIN t USING (player_id, bucket)",
        "xai_features": f"""WITH t AS (SELECT player_id, event_id, speed_ms, heart_rate_bpm::DOUBLE hr, CASE WHEN speed_ms >= 5.5 THEN 1 ELSE 0 END::DOUBLE sprint_flag, speed_ms * 1.5::DOUBLE distance_delta_m, (event_id % 9 - 4) / 10 rec FROM ({oracle('telemetry')})), b AS (SELECT player_id, {', '.join(f'round(avg({e}), 6) {c}_mean, round(stddev_pop({e}), 6) {c}_std' for c, e in zs)} FROM t WHERE player_id % 4 > 0 GROUP BY 1)
 SELECT player_id, event_id, sprint_flag window_sprint_count, round(distance_delta_m * 8, 6) window_distance_m, speed_ms window_avg_speed_ms, round(abs(rec) * greatest(coalesce(hr, 150), 1), 6) hr_recovery_time_s, {', '.join(f'round(CASE WHEN {c}_std > 0 THEN ({seen[c]} - {c}_mean) / {c}_std ELSE 0 END, 6) z_{c}' for c, _ in zs)} FROM t LEFT JOIN b USING (player_id)""",
        "score_events": f"WITH {ls} SELECT '1' schema_version, player_id, printf('p%03d', player_id) external_id, match_id::VARCHAR match_id, event_id, loss reconstruction_loss, confidence, CASE WHEN player_id % 7 > 0 THEN 75.0::DOUBLE END threshold, player_id % 7 > 0 AND loss > 75 raw_threshold_breach, regime, CASE WHEN event_id % 2 = 0 THEN 'regime' ELSE 'player' END tracker_source FROM ls",
        "feature_importance": f"WITH {ft}, lg AS ({long}), a AS ({imp('true')}), b AS ({imp('player_id % 2 = 0')}) SELECT feature, a.importance importance_a, CAST(a.rk AS INT) rank_a, b.importance importance_b, CAST(b.rk AS INT) rank_b, CAST(a.rk - b.rk AS INT) rank_change FROM a JOIN b USING (feature)",
        "inference_log": f"WITH {ft}, {ls}, c AS (SELECT player_id, match_id, max(acwr) q, sum(window_sprint_count) r FROM ft WHERE player_id % 5 > 0 GROUP BY 1, 2) SELECT player_id, match_id, event_id, CASE WHEN q > 2 THEN 'critical' WHEN r >= 2 THEN 'elevated' ELSE 'normal' END priority, CASE WHEN q > 2 THEN 'critical' WHEN q > 1.5 THEN 'high' ELSE 'low' END escalation, CASE WHEN r IS NOT NULL THEN 'locomotor_overload' END trajectory_state, confidence, loss, loss > 80 is_anomaly FROM ls LEFT JOIN c USING (player_id, match_id)",
        "alert_payload": f"WITH {ls} SELECT event_id, player_id, row_number() OVER (PARTITION BY player_id ORDER BY t_us, event_id) gate_windows, 'load' AS second, 'anomaly_flag' AS kind, printf('p%03d', player_id) external_id FROM ls WHERE label = 1 AND loss > 20",
        "audit_report": f"""{fa} SELECT attribute, CAST(row_number() OVER (PARTITION BY attribute ORDER BY biased DESC, abs(delta) DESC, g) AS INT) line_no, printf('%s=%s: rate %.3f over %d, difference %+.3f%s', attribute, g, rate, n, delta, CASE WHEN biased THEN ' BIASED' ELSE '' END) line, CASE WHEN bool_or(biased) OVER (PARTITION BY attribute) THEN 'review' ELSE 'pass' END verdict FROM au""",
    }
