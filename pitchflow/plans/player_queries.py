"""Registered queries over players' loads, baselines, scores and states, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import state as S
from ..operators import workload as L
from . import telemetry_queries as TQ
from .views import oracle, view

DAY = TQ.DAY
ORDER = ("t_us", "event_id")
METRICS = ("acceleration_load", "deceleration_load", "distance_covered")


def _scored(spark, d):
    return view(spark, d, "scored")


def half_split_trend(spark, d):
    return L.half_split_trend(view(spark, d, "telemetry"), "speed_ms", ("player_id",), ORDER).select("event_id", "trend")


def workload_status(spark, d):
    b = TQ.resample(spark, d).select("match_id", "player_id", "bucket", F.round("distance", 4).alias("load"))
    return L.workload_status(b, "load", "match_id")


def rolling_metrics(spark, d):
    r = L.rolling_metrics(view(spark, d, "loads"), METRICS)
    return r.select("player_id", "metric", *[L.figure(c) for c in ("last", "mean5", "mean7", "mean10", "season")], "n", "trend")


def acwr_matches(spark, d):
    a = L.acwr_matches(view(spark, d, "loads"))
    return a.select("player_id", *[F.round(c, 6).alias(c) for c in ("acute", "chronic", "acwr")])


def acwr_daily(spark, d):
    return L.acwr_daily(view(spark, d, "sessions"), "1998-08-01", 90, 365)


def historical_baseline(spark, d):
    return L.historical_baseline(view(spark, d, "sessions"), ("total_distance_m", "sprint_count", "max_speed_ms"))


def provisional_baseline(spark, d):
    return L.provisional_baseline(view(spark, d, "telemetry"), 2 * DAY, 3, 3, 3600.0)


def positional_norms(spark, d):
    n = L.positional_norms(view(spark, d, "telemetry"))
    return n.select("player_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "spread")], "n")


def positional_drift(spark, d):
    t = view(spark, d, "telemetry")
    return L.positional_drift(t, L.positional_norms(t).drop("n"), 10)


def fatigue_curve(spark, d):
    return L.fatigue_curve(view(spark, d, "telemetry"), DAY, 1, 4, 3600.0)


def session_features(spark, d):
    return L.session_features(TQ.resample(spark, d))


def distribution(spark, d):
    return L.distribution(view(spark, d, "telemetry"), ("speed_ms", "acceleration_ms2"))


def dynamic_threshold(spark, d):
    t = E.dynamic_threshold(_scored(spark, d), "player_id", "score", 30, 60)
    return t.withColumn("threshold", F.when(F.col("threshold") == float("inf"), None).otherwise(F.col("threshold")))


def ecdf_confidence(spark, d):
    s = _scored(spark, d)
    return E.ecdf_confidence(s, s.filter("event_id % 5 = 0"), "player_id", "score").select("event_id", F.round("confidence", 9).alias("confidence"))


def confusion(spark, d):
    return E.confusion(_scored(spark, d))


def auc(spark, d):
    return E.auc(_scored(spark, d))


def precision_at_k(spark, d):
    return E.precision_at_k(_scored(spark, d), "player_id")


def merge_episodes(spark, d):
    return E.merge_episodes(_scored(spark, d), "pred", "player_id", ORDER)


def _episodes(spark, d):
    s = _scored(spark, d)
    return E.merge_episodes(s, "pred", "player_id", ORDER), E.merge_episodes(s, "label", "player_id", ORDER)


def match_episodes(spark, d):
    return E.match_episodes(*_episodes(spark, d), "player_id")


def event_report(spark, d):
    return E.event_report(*_episodes(spark, d), _scored(spark, d).agg(F.count("*").alias("windows")), "player_id")


def threshold_pick(spark, d):
    s = _scored(spark, d)
    return E.budget_pick(E.threshold_sweep(s), s.agg(F.count("*").alias("windows"), F.sum("label").alias("positives")), 3.0)


def episode_metrics(spark, d):
    return E.episode_metrics(*_episodes(spark, d), "player_id")


def threshold_sweep(spark, d):
    return E.threshold_sweep(_scored(spark, d))


def fairness_audit(spark, d):
    return E.fairness_audit(view(spark, d, "inferences"), ("position", "nationality"))


def player_recalibration(spark, d):
    o = view(spark, d, "scored").filter("label = 1").select("player_id", F.col("event_id").alias("override_id"), F.create_map(F.lit("speed"), F.col("score") / 50, F.lit("load"), (F.col("event_id") % 7).cast("double")).alias("snapshot"))
    return E.player_recalibration(o)


def alert_states(spark, d):
    s = _scored(spark, d).withColumns({"active": F.col("score") > 60, "confidence": (F.col("event_id") % 10) / 10 + 0.2})
    return S.alert_states(s, ("player_id",), ORDER).drop("t_us")


def risk_trajectory(spark, d):
    return S.risk_trajectory(_scored(spark, d).withColumn("alert", F.col("pred")), ("player_id",), ORDER).drop("t_us")


def recalibrate_squad(spark, d):
    return E.recalibrate_squad(_scored(spark, d).withColumn("decision", F.when(F.col("event_id") % 9 < 4, "override").otherwise("accept")))


def _findings(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("cardio", "locomotor", "recovery"))), (F.col("event_id") % 3 + 1).cast("int"))
    s = _scored(spark, d)
    return s.select("player_id", "event_id", "t_us", kinds.alias("finding"), F.round(F.col("event_id") % 10 / 10, 1).alias("confidence"), F.floor(F.col("t_us") / (3600000000 * 12)).cast("long").alias("minute"), (F.col("event_id") % 4).alias("severity"))


def finding_transitions(spark, d):
    return S.finding_transitions(_findings(spark, d), ("player_id",), ORDER)


def finding_state(spark, d):
    return S.finding_state(_findings(spark, d), ("player_id",), ORDER).drop("t_us")


def episodes(spark, d):
    return S.episodes(_findings(spark, d), ("player_id",), ORDER, 4)


def alert_gate(spark, d):
    f = _findings(spark, d).withColumn("family", F.when(F.col("severity") > 0, F.col("finding")))
    return S.alert_gate(f, ("player_id",), ORDER, DAY).select("event_id", "passed")


def journal_state(spark, d):
    j = _scored(spark, d).select("player_id", "event_id", "t_us", F.col("score").alias("value"), F.when(F.col("event_id") % 11 == 0, "set").when(F.col("event_id") % 13 == 0, "delete").otherwise("increment").alias("op"))
    return S.rebuild_state(j, ("player_id",), ORDER)


def queries() -> dict:
    names = "half_split_trend workload_status rolling_metrics acwr_matches acwr_daily historical_baseline provisional_baseline positional_norms positional_drift fatigue_curve session_features distribution dynamic_threshold ecdf_confidence confusion auc precision_at_k merge_episodes match_episodes episode_metrics event_report threshold_pick threshold_sweep fairness_audit player_recalibration recalibrate_squad alert_states risk_trajectory finding_transitions finding_state episodes alert_gate journal_state"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    tel, sc, ld, ss = (f"WITH ev AS ({oracle(n)})" for n in ("telemetry", "scored", "loads", "sessions"))
    pw = "PARTITION BY player_id ORDER BY t_us, event_id"
    res = TQ.oracle_sql()["resample"]
    rs = f"WITH rsm AS ({res})"
    long = " UNION ALL ".join(f"SELECT player_id, match_id, '{m}' metric, {m}::DOUBLE v FROM ev" for m in METRICS)
    norms = "n AS (SELECT player_id, avg(x_pitch) cx, avg(y_pitch) cy, count(*) n FROM ev GROUP BY 1 HAVING count(*) >= 10), nd AS (SELECT e.*, cx, cy, sqrt(pow(x_pitch - cx, 2) + pow(y_pitch - cy, 2)) d FROM ev e JOIN n USING (player_id)), ns AS (SELECT player_id, any_value(cx) cx, any_value(cy) cy, stddev_samp(d) spread, count(*) n FROM nd GROUP BY 1)"
    ep = lambda flag, a: f"""{a}1 AS (SELECT *, row_number() OVER ({pw}) - 1 i, count(*) OVER (PARTITION BY player_id) m FROM ev), {a}2 AS (SELECT *, i - lag(i) OVER (PARTITION BY player_id ORDER BY i) g FROM {a}1 WHERE {flag} = 1),
 {a}3 AS (SELECT *, sum(CASE WHEN g <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY player_id ORDER BY i) episode FROM {a}2), {a} AS (SELECT player_id, CAST(episode AS BIGINT) episode, CAST(min(i) AS INT) AS "start", CAST(CASE WHEN any_value(m) - 1 - max(i) <= 2 THEN any_value(m) - 1 ELSE max(i) END AS INT) AS "end", count(*) n_positive FROM {a}3 GROUP BY 1, 2)"""  # noqa: E731
    ov = 'LEFT JOIN {t} t ON p.player_id = t.player_id AND p."start" <= t."end" AND p."end" >= t."start"'
    find = f"""{sc}, fi AS (SELECT player_id, event_id, t_us, ['cardio', 'locomotor', 'recovery'][event_id % 3 + 1] finding, round(event_id % 10 / 10, 1) confidence, CAST(floor(t_us / 43200000000) AS BIGINT) AS minute, event_id % 4 severity FROM ev)"""
    th = "linspace AS (SELECT CAST(k AS INT) k, a + k * ((b - a) / 49) threshold FROM (SELECT quantile_cont(score, 0.8) a, quantile_cont(score, 0.995) b FROM ev), range(0, 50) t(k))"
    rec = lambda first, rest, out: f"""WITH RECURSIVE ev AS ({oracle('scored')}), q AS (SELECT *, row_number() OVER ({pw}) rn FROM {{src}}), f AS ({first} FROM q WHERE rn = 1 UNION ALL {rest} FROM f JOIN q ON q.player_id = f.player_id AND q.rn = f.rn + 1) {out}"""
    return {
        "half_split_trend": f"""{tel}, r AS (SELECT *, row_number() OVER ({pw}) rn, sum(speed_ms) OVER ({pw} ROWS UNBOUNDED PRECEDING) t FROM ev), j AS (SELECT a.event_id, a.rn, b.t / (a.rn // 2) f, (a.t - b.t) / (a.rn - a.rn // 2) s FROM r a LEFT JOIN r b ON a.player_id = b.player_id AND b.rn = a.rn // 2)
 SELECT event_id, CASE WHEN rn < 2 THEN 'stable' WHEN f = 0 THEN CASE WHEN s > 0 THEN 'increasing' ELSE 'stable' END WHEN round((s - f) / abs(f), 9) > 0.05 THEN 'increasing' WHEN round((s - f) / abs(f), 9) < -0.05 THEN 'decreasing' ELSE 'stable' END trend FROM j""",
        "workload_status": f"{rs}, l AS (SELECT match_id, player_id, bucket, round(distance, 4) AS load FROM rsm), c AS (SELECT match_id, quantile_cont(load, 0.33) a, quantile_cont(load, 0.66) b FROM l GROUP BY 1) SELECT match_id, player_id, bucket, load, CASE WHEN load <= a THEN 'low' WHEN load >= b THEN 'high' ELSE 'normal' END status FROM l JOIN c USING (match_id)",
        "rolling_metrics": f"""{ld}, lg AS ({long}), r AS (SELECT *, row_number() OVER (PARTITION BY player_id, metric ORDER BY match_id DESC) rn FROM lg), a AS (SELECT player_id, metric, max(v) FILTER (rn = 1) AS last, avg(v) FILTER (rn <= 5) m5, avg(v) FILTER (rn <= 7) m7, avg(v) FILTER (rn <= 10) m10, avg(v) s, count(*) n FROM r GROUP BY 1, 2)
 SELECT player_id, metric, round(CAST(last AS DECIMAL(38, 9)), 6)::DOUBLE AS last, round(CAST(m5 AS DECIMAL(38, 9)), 6)::DOUBLE mean5, round(CAST(m7 AS DECIMAL(38, 9)), 6)::DOUBLE mean7, round(CAST(m10 AS DECIMAL(38, 9)), 6)::DOUBLE mean10, round(CAST(s AS DECIMAL(38, 9)), 6)::DOUBLE season, n, CASE WHEN s = 0 THEN CASE WHEN m5 = 0 THEN 'stable' ELSE 'improving' END WHEN round((m5 - s) / abs(s), 9) > 0.05 THEN 'improving' WHEN round((m5 - s) / abs(s), 9) < -0.05 THEN 'declining' ELSE 'stable' END trend FROM a""",
        "acwr_matches": f"{ld}, r AS (SELECT player_id, (acceleration_load + deceleration_load)::DOUBLE AS load, row_number() OVER (PARTITION BY player_id ORDER BY match_id DESC) rn FROM ev), a AS (SELECT player_id, max(load) FILTER (rn = 1) ac, avg(load) ch FROM r WHERE rn <= 4 GROUP BY 1) SELECT player_id, round(ac, 6) acute, round(ch, 6) chronic, round(CASE WHEN ch <> 0 THEN ac / ch END, 6) acwr FROM a",
        "acwr_daily": f"""{ss}, a AS (SELECT *, DATE '1998-08-01' - started_on age FROM ev WHERE started_on <= DATE '1998-08-01'), g AS (SELECT player_id, avg(total_distance_m) FILTER (age < 90) a, avg(total_distance_m) FILTER (age < 365) c, arg_max(total_distance_m, (-age, session_id)) l FROM a GROUP BY 1),
 h AS (SELECT player_id, coalesce(a, l) ac, coalesce(c, l) ch FROM g), k AS (SELECT *, CASE WHEN ch = 0 THEN 1 ELSE ac / ch END r FROM h) SELECT player_id, round(ac, 7) acute, round(ch, 7) chronic, round(r, 6) acwr, CASE WHEN r > 1.5 THEN 'high_risk' WHEN r < 0.8 THEN 'low_readiness' ELSE 'optimal' END flag FROM k""",
        "historical_baseline": f"{ss} SELECT player_id, count(*) n_sessions, " + ", ".join(f"round(avg({m}), 6) {m}_mean, round(CASE WHEN count({m}) > 1 THEN stddev_samp({m}) ELSE 1 END, 6) {m}_std" for m in ("total_distance_m", "sprint_count", "max_speed_ms")) + " FROM ev GROUP BY 1 HAVING count(*) >= 5",
        "provisional_baseline": f"""{tel}, b AS (SELECT *, (t_us - min(t_us) OVER (PARTITION BY match_id, player_id)) // {2 * DAY} w FROM ev), c AS (SELECT *, speed_ms * least(3600.0::DOUBLE, greatest(0::DOUBLE, (lead(t_us) OVER (PARTITION BY match_id, player_id, w ORDER BY t_us, event_id) - t_us) / 1e6::DOUBLE)) d, lead(t_us) OVER (PARTITION BY match_id, player_id, w ORDER BY t_us, event_id) l FROM b),
 p AS (SELECT match_id, player_id, w, sum(CASE WHEN l IS NOT NULL THEN d END) distance, max(speed_ms) top, count(*) n FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT player_id, count(*) n_windows, round(avg(distance), 6) distance_mean, round(stddev_pop(distance), 6) distance_std, round(avg(top), 6) top_mean FROM p GROUP BY 1 HAVING count(*) >= 3""",
        "positional_norms": f"{tel}, {norms} SELECT player_id, round(cx, 6) cx, round(cy, 6) cy, round(spread, 6) spread, n FROM ns",
        "positional_drift": f"{tel}, {norms}, j AS (SELECT e.player_id, event_id, t_us, sqrt(pow(x_pitch - cx, 2) + pow(y_pitch - cy, 2)) d, greatest(2 * spread, 5) lim FROM ev e JOIN ns USING (player_id)) SELECT player_id, event_id, round(avg(d) OVER w / lim, 6) drift, round(avg((d > lim)::INT) OVER w, 6) outside, avg((d > lim)::INT) OVER w >= 0.3 flagged FROM j WINDOW w AS ({pw} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
        "fatigue_curve": f"""{tel}, b AS (SELECT *, ((t_us - min(t_us) OVER (PARTITION BY match_id, player_id)) // {DAY})::DOUBLE seg FROM ev), c AS (SELECT *, speed_ms * least(3600.0::DOUBLE, (lead(t_us) OVER (PARTITION BY match_id, player_id, seg ORDER BY t_us, event_id) - t_us) / 1e6::DOUBLE) d, lead(t_us) OVER (PARTITION BY match_id, player_id, seg ORDER BY t_us, event_id) l FROM b),
 s AS (SELECT match_id, player_id, seg, coalesce(sum(CASE WHEN l IS NULL THEN speed_ms * 3600 ELSE d END), 0) d FROM c GROUP BY 1, 2, 3), f AS (SELECT match_id, player_id, regr_slope(d, seg) sl, regr_intercept(d, seg) ic, regr_r2(d, seg) r2 FROM s GROUP BY 1, 2 HAVING count(*) >= 4) SELECT player_id, round(median(sl), 6) slope, round(median(ic), 6) intercept, round(median(r2), 6) r2, count(*) n_sessions FROM f GROUP BY 1""",
        "session_features": f"{rs}, n AS (SELECT *, (mean_speed + lead(mean_speed) OVER (PARTITION BY match_id, player_id ORDER BY bucket)) / 2 * 15.0::DOUBLE a FROM rsm) SELECT match_id, player_id, round(coalesce(sum(a), 0), 6) distance, round(avg(mean_speed), 9) mean_speed, count(*) FILTER (any_sprint) sprints, round(avg(mean_hr), 9) mean_hr FROM n GROUP BY 1, 2",
        "distribution": f"{tel} " + " UNION ALL ".join(f"SELECT '{c}' AS column, min({c}) AS min, round(quantile_cont({c}, 0.25), 9) p25, round(quantile_cont({c}, 0.5), 9) median, round(quantile_cont({c}, 0.75), 9) p75, round(quantile_cont({c}, 0.9), 9) p90, max({c}) AS max, round(avg({c}), 9) mean FROM ev" for c in ("speed_ms", "acceleration_ms2")),
        "dynamic_threshold": f"""{sc}, q AS (SELECT player_id, quantile_cont(score, 0.95) p, count(*) n FROM ev GROUP BY 1), k AS (SELECT e.*, p, n, count(*) FILTER (score <= p) OVER (PARTITION BY player_id) kept FROM ev e JOIN q USING (player_id)), c AS (SELECT * FROM k WHERE kept < 15 OR score <= p),
 m AS (SELECT player_id, quantile_cont(score, 0.5) mid, quantile_cont(score, 0.995) hi, count(*) n_clean, any_value(n) n FROM c GROUP BY 1), a AS (SELECT player_id, quantile_cont(abs(score - mid), 0.5) mad FROM c JOIN m USING (player_id) GROUP BY 1)
 SELECT player_id, round(CASE WHEN n < 30 THEN NULL WHEN n_clean >= 60 THEN hi ELSE mid + 5 * 1.4826::DOUBLE * mad END, 9) threshold, n, n_clean FROM m JOIN a USING (player_id)""",
        "ecdf_confidence": f"{sc} SELECT event_id, round(CASE WHEN count(*) FILTER (event_id % 5 = 0) OVER (PARTITION BY player_id) > 0 THEN count(*) FILTER (event_id % 5 = 0) OVER (PARTITION BY player_id ORDER BY score) / count(*) FILTER (event_id % 5 = 0) OVER (PARTITION BY player_id) END, 9) confidence FROM ev",
        "confusion": f"{sc}, c AS (SELECT count(*) FILTER (label = 1 AND pred = 1) tp, count(*) FILTER (label = 0 AND pred = 1) fp, count(*) FILTER (label = 1 AND pred = 0) fn, count(*) FILTER (label = 0 AND pred = 0) tn FROM ev) SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) recall, round(2 * tp / (2 * tp + fp + fn), 9) f1 FROM c",
        "auc": f"{sc}, r AS (SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 rk FROM ev), g AS (SELECT score, sum(label) p, count(*) n FROM ev GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) tp, sum(n) OVER (ORDER BY score DESC) a FROM g) SELECT (SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) FROM r) roc_auc, round(sum(p * tp / a) / sum(p), 9) average_precision FROM c",
        "precision_at_k": f"{sc}, r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY score DESC, event_id) rn, sum(label) OVER (PARTITION BY player_id) k FROM ev) SELECT player_id, round(avg(label), 9) precision_at_k, count(*) k FROM r WHERE rn <= k GROUP BY 1",
        "merge_episodes": f"{sc}, {ep('pred', 'pe')} SELECT * FROM pe",
        "match_episodes": f'{sc}, {ep("pred", "pe")}, {ep("label", "te")} SELECT p.player_id, p."start", p."end", min(t."start") true_start FROM pe p {ov.format(t="te")} GROUP BY 1, 2, 3',
        "episode_metrics": f'{sc}, {ep("pred", "pe")}, {ep("label", "te")}, a AS (SELECT p.player_id, p."start" s, min(t."start") x FROM pe p {ov.format(t="te")} GROUP BY p.player_id, p."start"), b AS (SELECT p.player_id, p."start" s, min(t."start") x FROM te p {ov.format(t="pe")} GROUP BY p.player_id, p."start") SELECT (SELECT count(x) FROM a) tp, (SELECT count(*) - count(x) FROM a) fp, (SELECT round(avg(x - s), 9) FROM a) mean_lead, (SELECT count(*) - count(x) FROM b) fn, (SELECT count(*) FROM b) n_true',
        "recalibrate_squad": f"""{sc}, o AS (SELECT count(*) n, count(*) FILTER (event_id % 9 < 4) / count(*) r FROM ev) SELECT n n_overrides_analyzed, round(r, 9) override_rate, 0.05::DOUBLE old, CASE WHEN r > 0.4 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS new, CASE WHEN r > 0.4 THEN 'too many overrides' ELSE 'few overrides' END AS reason FROM o WHERE n >= 10 AND (r > 0.4 OR (r > 0 AND r < 0.05))""",
        "event_report": f"""{sc}, {ep('pred', 'pe')}, {ep('label', 'te')}, m AS (SELECT p.player_id, p."start" s, min(t."start") x FROM pe p {ov.format(t='te')} GROUP BY p.player_id, p."start", p."end"),
 c AS (SELECT count(x) tp, count(*) - count(x) fp, (SELECT count(*) FROM te) - count(DISTINCT (player_id, x)) FILTER (x IS NOT NULL) fn, avg((s - x) * 120::DOUBLE) lead, count(*) / greatest((SELECT count(*) FROM te), 1) fr FROM m), q AS (SELECT *, tp / greatest(tp + fp, 1) pr, tp / greatest(tp + fn, 1) re FROM c)
 SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) recall, round(2 * pr * re / greatest(pr + re, 1e-12), 6) f1, round(fp * 5400::DOUBLE / ((SELECT count(*) FROM ev) * 120), 6) fp_per_match, round(fr, 6) fragmentation, round(1 / greatest(fr, 1e-6), 6) stability, round(lead, 6) mean_lead_s FROM q""",
        "threshold_pick": f"""{sc}, {th}, w AS (SELECT k, threshold, count(*) FILTER (label = 0) fp, count(*) FILTER (label = 1) tp FROM linspace LEFT JOIN ev ON score >= threshold GROUP BY k, threshold), t AS (SELECT count(*) n, sum(label) p FROM ev)
 SELECT k, round(threshold, 9) threshold, fp, tp, round(fp * 5400::DOUBLE / (n * 120), 6) fp_per_match, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(p, 1), 6) recall FROM w, t WHERE fp * 5400::DOUBLE / (n * 120) <= 3 ORDER BY k LIMIT 1""",
        "threshold_sweep": f"{sc}, {th} SELECT k, round(threshold, 9) threshold, count(*) FILTER (label = 0) fp, count(*) FILTER (label = 1) tp FROM linspace LEFT JOIN ev ON score >= threshold GROUP BY k, threshold",
        "fairness_audit": f"""WITH ev AS ({oracle("inferences")}), lg AS (SELECT is_anomaly, 'position' attribute, position::VARCHAR AS "group" FROM ev UNION ALL SELECT is_anomaly, 'nationality', nationality::VARCHAR FROM ev), o AS (SELECT avg(is_anomaly) o FROM ev) SELECT attribute, "group", round(avg(is_anomaly), 9) rate, count(*) n, round(avg(is_anomaly) - any_value(o), 9) delta, abs(avg(is_anomaly) - any_value(o)) > 0.15 biased FROM lg, o WHERE "group" IS NOT NULL GROUP BY 1, 2""",
        "player_recalibration": f"{sc}, x AS (SELECT player_id, event_id, 'speed' feature, score / 50 v FROM ev WHERE label = 1 UNION ALL SELECT player_id, event_id, 'load', (event_id % 7)::DOUBLE FROM ev WHERE label = 1) SELECT player_id, feature, count(*) n, round(avg(v), 9) mean_value FROM x WHERE abs(v) > 2 GROUP BY 1, 2 HAVING count(*) >= 3",
        "alert_states": rec(
            "SELECT player_id, event_id, rn, CASE WHEN c < 0.4 THEN 4 ELSE 0 END s, CASE WHEN c >= 0.4 AND o THEN 1 ELSE 0 END p, CASE WHEN c >= 0.4 AND NOT o THEN 1 ELSE 0 END r, 0 e",
            """SELECT player_id, event_id, rn, s, p, r, f_e + CASE WHEN f_s = 0 AND s > 0 AND s < 4 THEN 1 ELSE 0 END FROM (SELECT q.player_id, q.event_id, q.rn, f.s f_s, f.e f_e, CASE WHEN c < 0.4 THEN f.p WHEN o THEN f.p + 1 ELSE 0 END p, CASE WHEN c < 0.4 THEN f.r WHEN o THEN 0 ELSE f.r + 1 END r,
 CASE WHEN c < 0.4 THEN 4 WHEN o THEN greatest(f.s, CASE WHEN f.p + 1 >= 10 THEN 3 WHEN f.p + 1 >= 3 THEN 2 ELSE 0 END) WHEN f.r + 1 >= 3 THEN 0 ELSE f.s END s""",
            "SELECT player_id, event_id, ['NONE', 'WATCH', 'WARNING', 'CRITICAL', 'HOLD'][s + 1] state, p persistence, e episode FROM f",
        ).replace("{src}", "(SELECT *, score > 60 o, (event_id % 10) / 10 + 0.2::DOUBLE c FROM ev)").replace("q.rn = f.rn + 1)", "q.rn = f.rn + 1) z)"),
        "risk_trajectory": f"{sc}, r AS (SELECT *, coalesce((pred = 0 AND lag(pred) OVER ({pw}) = 0)::INT, 0) z FROM ev), i AS (SELECT *, sum(z) OVER ({pw}) isl FROM r), t AS (SELECT player_id, event_id, CAST(sum(pred) OVER (PARTITION BY player_id, isl ORDER BY t_us, event_id) AS BIGINT) total FROM i) SELECT *, CASE WHEN total >= 8 THEN 'critical' WHEN total >= 5 THEN 'high' WHEN total >= 3 THEN 'elevated' ELSE 'normal' END AS level FROM t",
        "finding_transitions": f"{find}, r AS (SELECT *, lag(finding) OVER w b, lag(confidence) OVER w c, lag(minute) OVER w m FROM fi WINDOW w AS ({pw})), n AS (SELECT b AS source, finding AS target, count(*) n FROM r WHERE c >= 0.55 AND confidence >= 0.55 AND minute - m BETWEEN 0 AND 3 GROUP BY 1, 2) SELECT source, target, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) total, round((n + 1) / (sum(n) OVER (PARTITION BY source) + 2), 9) probability FROM n",
        "finding_state": f"{find}, r AS (SELECT *, row_number() OVER ({pw}) rn FROM fi), p AS (SELECT *, lag(severity) OVER w ps, lag(confidence) OVER w pc, lag(rn) OVER w pr FROM r WINDOW w AS (PARTITION BY player_id, finding ORDER BY t_us, event_id)) SELECT player_id, event_id, finding, CASE WHEN pr IS NULL OR rn - pr > 50 THEN 'active' WHEN severity > ps OR confidence > pc + 0.1 THEN 'escalating' WHEN confidence < pc - 0.1 THEN 'resolving' WHEN severity = ps AND abs(confidence - pc) < 0.05 THEN 'stabilizing' ELSE 'active' END state FROM p",
        "episodes": f"{find}, r AS (SELECT *, CASE WHEN lag(finding) OVER w = finding AND abs(minute - lag(minute) OVER w) <= 4 THEN 0 ELSE 1 END z FROM fi WINDOW w AS ({pw})), e AS (SELECT *, sum(z) OVER ({pw}) ep FROM r) SELECT player_id, CAST(ep AS BIGINT) episode, any_value(finding) finding, min(minute) start_minute, max(minute) end_minute, count(*) n_windows, max(severity) severity, round(avg(confidence), 9) confidence FROM e GROUP BY 1, 2 HAVING count(*) >= 2",
        "alert_gate": rec(
            "SELECT player_id, event_id, rn, fam f, CASE WHEN fam IS NULL THEN 0 ELSE t_us END t, fam IS NOT NULL ok",
            f"SELECT q.player_id, q.event_id, q.rn, CASE WHEN fam IS NULL THEN NULL WHEN NOT (coalesce(f.f = fam, false) AND t_us - f.t < {DAY}) THEN fam ELSE f.f END, CASE WHEN fam IS NOT NULL AND NOT (coalesce(f.f = fam, false) AND t_us - f.t < {DAY}) THEN t_us ELSE f.t END, fam IS NOT NULL AND NOT (coalesce(f.f = fam, false) AND t_us - f.t < {DAY})",
            "SELECT event_id, ok passed FROM f",
        ).replace("{src}", "(SELECT *, CASE WHEN event_id % 4 > 0 THEN ['cardio', 'locomotor', 'recovery'][event_id % 3 + 1] END fam FROM ev)"),
        "journal_state": f"{sc}, j AS (SELECT player_id, event_id, t_us, score v, CASE WHEN event_id % 11 = 0 THEN 'set' WHEN event_id % 13 = 0 THEN 'delete' ELSE 'increment' END op FROM ev), e AS (SELECT *, count(*) FILTER (op <> 'increment') OVER ({pw}) era FROM j), m AS (SELECT *, max(era) OVER (PARTITION BY player_id) mx FROM e) SELECT player_id, round(sum(CASE WHEN op = 'delete' THEN 0 ELSE v END), 6) AS value FROM m WHERE era = mx GROUP BY 1 HAVING NOT bool_or(op = 'delete') OR count(*) > 1",
    }
