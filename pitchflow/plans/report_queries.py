"""Registered queries of summaries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from . import player_queries as PQ
from .views import oracle, view

DAY = PQ.DAY


def _scored(spark, d):
    return view(spark, d, "scored")


def score_summary(spark, d):
    return R.score_summary(_scored(spark, d))


def window_report(spark, d):
    s = _scored(spark, d).withColumn("segment", (F.col("event_id") % 6).cast("long"))
    return R.window_report(s, ("player_id", "segment"))


def occupancy_sweep(spark, d):
    return R.occupancy_sweep(view(spark, d, "telemetry"), 2 * DAY, (1, 3, 5))


def regime_coverage(spark, d):
    return R.regime_coverage(_scored(spark, d).withColumn("regime", F.when(F.col("event_id") % 3 == 0, "defensive__low").otherwise("middle__high")))


def example_windows(spark, d):
    return R.example_windows(_scored(spark, d), 100.0)


def dominant_finding(spark, d):
    return R.dominant_finding(PQ._findings(spark, d), ("player_id", "minute"))


def salient_episodes(spark, d):
    return R.salient_episodes(_trended(spark, d), "cardio", trend="worsening")


def _trended(spark, d):
    e = PQ.episodes(spark, d).withColumns({"trend": F.when(F.col("start_minute") % 3 == 0, "worsening").otherwise("stable"), "response": F.when(F.col("n_windows") >= 3, "persisted").otherwise("resolved")})
    return e.withColumn("severity", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("severity") + 1).cast("int")))


def context_summary(spark, d):
    return R.context_summary(PQ.episodes(spark, d), episode_patterns(spark, d), salient_episodes(spark, d))


def episode_patterns(spark, d):
    return R.episode_patterns(PQ.episodes(spark, d))


def persistence_sweep(spark, d):
    return R.persistence_sweep(_scored(spark, d).withColumns({"active": F.col("score") > 60, "confidence": F.lit(1.0)}), (1, 2, 3))


def aggregate_metrics(spark, d):
    l, p = F.col("label") == 1, F.col("pred") == 1
    return R.aggregate_metrics(_scored(spark, d).groupBy("player_id").agg(F.count_if(l & p).alias("tp"), F.count_if(~l & p).alias("fp"), F.count_if(l & ~p).alias("fn")))


def override_summary(spark, d):
    o = _scored(spark, d).select(F.concat(F.lit("type"), F.col("event_id") % 3).alias("recommendation_type"), F.when(F.col("label") == 1, "override").otherwise("accept").alias("decision"))
    return R.override_summary(o)


def match_metadata(spark, d):
    return R.match_metadata(view(spark, d, "tactical"))


def validate_match(spark, d):
    t = view(spark, d, "tactical")
    return R.validate_match(t, t.filter("player_id % 7 <> 0").select("player_id"))


def quality_report(spark, d):
    return R.quality_report(view(spark, d, "telemetry"))


def evaluation_summary(spark, d):
    s = _scored(spark, d)
    source = F.when(F.col("player_id") % 4 == 0, "none").when(F.col("player_id") % 4 == 1, "pilot_pooled").otherwise("per_player")
    return R.evaluation_summary(s.select("player_id", F.when(F.col("player_id") % 4 > 0, F.col("pred") == 1).alias("raw_threshold_breach"), source.alias("tracker_source")))


def team_hulls(spark, d):
    """A team's places in a quarter of a day as if they were one tick's."""
    t = view(spark, d, "telemetry").select("match_id", (F.col("player_id") % 2).alias("team"), F.floor(F.col("t_us") / 21_600_000_000).cast("long").alias("tick"), "x_pitch", "y_pitch")
    return R.team_hulls(t, ("match_id", "team", "tick"))


def match_details(spark, d):
    positions = view(spark, d, "telemetry").filter("event_id % 3 = 0 AND match_id % 2 = 0")
    return R.match_metadata(view(spark, d, "tactical"), positions, view(spark, d, "matches").filter("match_id % 5 > 0"))


def quality_details(spark, d):
    t = view(spark, d, "telemetry").withColumn("speed_ms", F.when(F.col("event_id") % 13 > 0, F.col("speed_ms"))).withColumn("phase", F.get(F.array(F.lit("LOW_TEMPO"), F.lit("COUNTER"), F.lit("SETTLED")), (F.col("event_id") % 4).cast("int")))
    roster = t.select("player_id", F.concat(F.lit("pos"), (F.col("player_id") % 4).cast("string")).alias("position")).distinct()
    sessions = view(spark, d, "sessions").select((F.col("session_id") % 3 > 0).alias("is_match"), F.when(F.col("session_id") % 5 > 0, F.col("sprint_count") / F.lit(2)).alias("xg"))
    return R.quality_details(t, roster, sessions)


def queries() -> dict:
    return {f.__name__: f for f in (score_summary, window_report, occupancy_sweep, regime_coverage, example_windows, dominant_finding, salient_episodes, episode_patterns, context_summary, persistence_sweep, aggregate_metrics, override_summary, match_metadata, validate_match, quality_report, quality_details, match_details, evaluation_summary, team_hulls)}


def oracle_sql() -> dict[str, str]:
    tel, tac, sc = (f"WITH ev AS ({oracle(n)})" for n in ("telemetry", "tactical", "scored"))
    eps = f"WITH eps AS ({PQ.oracle_sql()['episodes']})"
    sal = "sr AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY end_minute DESC, episode DESC) rn FROM eps), ss AS (SELECT *, round(5 * (finding = 'cardio')::INT + 3 * (start_minute % 3 = 0)::INT + [0, 1, 2, 4][severity + 1] + 2 * (n_windows >= 3)::INT + rn / least(20, count(*) OVER (PARTITION BY player_id)), 6) salience FROM sr WHERE rn <= 20), sk AS (SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY salience DESC, rn) AS INT) AS rank FROM ss), sal AS (SELECT player_id, rank, episode, finding, salience FROM sk WHERE rank <= 3)"
    pat = "pn AS (SELECT *, lead(finding) OVER (PARTITION BY player_id ORDER BY episode) nx FROM eps), pp AS (SELECT player_id, 'recurring' kind, finding pattern, count(*) n FROM pn GROUP BY 1, 2, 3 UNION ALL SELECT player_id, 'transition', finding || '>' || nx, count(*) FROM pn WHERE nx IS NOT NULL GROUP BY 1, 2, 3), pat AS (SELECT player_id, kind, pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY player_id, kind ORDER BY n DESC, pattern) k FROM pp WHERE n >= 2) WHERE k <= 4)"
    find = PQ.oracle_sql()["episodes"].split(", r AS (")[0]
    pw = "PARTITION BY player_id ORDER BY t_us, event_id"
    return {
        "score_summary": f"{sc} SELECT count(*) n, round(avg(pred), 9) breach_rate, count(DISTINCT player_id) n_players, count(DISTINCT CASE WHEN pred = 1 THEN player_id END) n_flagged_players FROM ev",
        "window_report": f"{sc} SELECT 'player_id' dimension, player_id::VARCHAR AS value, count(*) n, round(avg(pred), 9) flag_rate, max(score) max_score FROM ev GROUP BY player_id UNION ALL SELECT 'segment', (event_id % 6)::VARCHAR, count(*), round(avg(pred), 9), max(score) FROM ev GROUP BY event_id % 6",
        "occupancy_sweep": f"{tel}, p AS (SELECT match_id, player_id, (t_us - t0) // {2 * DAY} w, count(*) n FROM (SELECT *, min(t_us) OVER (PARTITION BY match_id, player_id) t0 FROM ev) GROUP BY 1, 2, 3), a AS (SELECT gate, player_id, count(*) c FROM p, (VALUES (1), (3), (5)) g(gate) WHERE n >= gate GROUP BY 1, 2) SELECT a.gate AS gate, CAST(sum(c) AS BIGINT) n_windows, count(*) n_players, round(median(c), 6) median_windows, round(avg(c), 6) mean_windows, round(stddev_samp(c) / sqrt(count(*)), 6) standard_error, (SELECT string_agg(c || ':' || k, ',' ORDER BY c) FROM (SELECT c, count(*) k FROM a x WHERE x.gate = a.gate GROUP BY c)) histogram FROM a GROUP BY a.gate",
        "regime_coverage": f"{sc} SELECT player_id, CASE WHEN event_id % 3 = 0 THEN 'defensive__low' ELSE 'middle__high' END regime, count(*) n, count(*) >= 30 calibrated FROM ev GROUP BY 1, 2",
        "example_windows": f"{sc} SELECT player_id, arg_min(event_id, (score, event_id)) lowest, arg_min(event_id, (-score, event_id)) FILTER (pred = 1) highest_flagged, arg_min(event_id, (abs(score - 100), event_id)) borderline FROM ev GROUP BY 1",
        "dominant_finding": f"{find} SELECT player_id, minute, finding, severity FROM fi QUALIFY row_number() OVER (PARTITION BY player_id, minute ORDER BY severity DESC, confidence DESC, finding DESC) = 1",
        "salient_episodes": f"{eps}, {sal} SELECT * FROM sal",
        "episode_patterns": f"{eps}, {pat} SELECT * FROM pat",
        "context_summary": f"""{eps}, {sal}, {pat}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY episode DESC) rn, lag(finding) OVER (PARTITION BY player_id ORDER BY episode) bf FROM eps) WHERE rn <= 50),
 t AS (SELECT player_id, string_agg(finding, ' -> ' ORDER BY episode) trajectory FROM (SELECT *, lag(finding) OVER (PARTITION BY player_id ORDER BY episode) b FROM e) WHERE b IS NULL OR b <> finding GROUP BY 1),
 g AS (SELECT player_id, count(*) n_episodes, arg_max(finding, episode) active_pattern, string_agg(finding || ' (severity ' || severity || ', minutes ' || start_minute || '-' || end_minute || ')', '; ' ORDER BY episode) FILTER (rn <= 3) recent FROM e GROUP BY 1),
 p AS (SELECT player_id, string_agg(pattern, ',' ORDER BY pattern) FILTER (kind = 'recurring') a, string_agg(pattern, ',' ORDER BY pattern) FILTER (kind = 'transition') b FROM pat GROUP BY 1), r AS (SELECT player_id, string_agg(finding, ',' ORDER BY rank) c FROM sal GROUP BY 1)
 SELECT player_id, n_episodes, trajectory, recent, coalesce(a, '') recurring, coalesce(b, '') transitions, coalesce(c, '') relevant, active_pattern FROM g JOIN t USING (player_id) LEFT JOIN p USING (player_id) LEFT JOIN r USING (player_id)""",
        "persistence_sweep": f"""WITH RECURSIVE ev AS ({oracle("scored")}), q AS (SELECT player_id, v, score > 60 o, row_number() OVER (PARTITION BY player_id, v ORDER BY t_us, event_id) rn FROM ev, (VALUES (1), (2), (3)) g(v)),
 f AS (SELECT player_id, v, 0::BIGINT rn, 0 p, 0 r, false up, 0 e FROM (SELECT DISTINCT player_id, v FROM q) UNION ALL SELECT q.player_id, q.v, q.rn, CASE WHEN o THEN p + 1 ELSE 0 END, CASE WHEN o THEN 0 ELSE r + 1 END, CASE WHEN o THEN up OR p + 1 >= q.v ELSE up AND r + 1 < 3 END, e + CASE WHEN o AND NOT up AND p + 1 >= q.v THEN 1 ELSE 0 END FROM f JOIN q ON q.player_id = f.player_id AND q.v = f.v AND q.rn = f.rn + 1)
 SELECT v min_persistence, CAST(sum(n) AS BIGINT) n_windows, CAST(sum(e) AS BIGINT) n_alerts, count(*) n_players FROM (SELECT player_id, v, count(*) n, count(DISTINCT e) e FROM f WHERE up GROUP BY 1, 2) GROUP BY 1""",
        "aggregate_metrics": f"{sc}, p AS (SELECT player_id, count(*) FILTER (label = 1 AND pred = 1) tp, count(*) FILTER (label = 0 AND pred = 1) fp, count(*) FILTER (label = 1 AND pred = 0) fn FROM ev GROUP BY 1) SELECT round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END), 9) macro_precision, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END), 9) macro_recall, round(sum(tp) / (sum(tp) + sum(fp)), 9) micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) micro_recall FROM p",
        "override_summary": f"{sc} SELECT 'type' || (event_id % 3) recommendation_type, count(*) n, round(avg(label), 9) override_rate FROM ev GROUP BY 1",
        "match_metadata": f"{tac} SELECT match_id, count(*) n_events, count(DISTINCT player_id) n_players, string_agg(DISTINCT team_id, ' vs. ' ORDER BY team_id) teams, min(t_us) begin_us, max(t_us) end_us FROM ev GROUP BY 1",
        "validate_match": f"{tac} SELECT match_id, count(*) FILTER (player_id % 7 = 0) not_in_roster, count(*) FILTER (team_id IS NULL) without_team, count(*) n FROM ev GROUP BY 1",
        "evaluation_summary": f"""{sc}, t AS (SELECT player_id, CASE WHEN player_id % 4 > 0 THEN pred END b, ['none', 'pilot_pooled', 'per_player', 'per_player'][player_id % 4 + 1] src FROM ev)
 SELECT 'windows' figure, NULL AS name, count(*)::DOUBLE AS value FROM t UNION ALL SELECT 'players', NULL, count(DISTINCT player_id) FROM t UNION ALL SELECT 'calibrated_players', NULL, count(DISTINCT player_id) FILTER (src = 'per_player') FROM t
 UNION ALL SELECT 'breaches', NULL, sum(b) FROM t UNION ALL SELECT 'breach_rate', NULL, round(avg(b), 9) FROM t UNION ALL SELECT 'tracker_source', src, count(*) FROM t GROUP BY 2""",
        "match_details": f"""WITH ev AS ({oracle("tactical")}), p AS (SELECT match_id, count(*) n FROM ({oracle("telemetry")}) WHERE event_id % 3 = 0 AND match_id % 2 = 0 GROUP BY 1), s AS (SELECT match_id, min(date) AS date FROM ({oracle("matches")}) WHERE match_id % 5 > 0 GROUP BY 1)
 SELECT match_id, count(*) n_events, count(DISTINCT player_id) n_players, coalesce(string_agg(DISTINCT team_id, ' vs. ' ORDER BY team_id), '') teams, min(t_us) begin_us, max(t_us) end_us, coalesce(any_value(p.n), 0) n_positions, any_value(s.date) AS date FROM ev LEFT JOIN p USING (match_id) LEFT JOIN s USING (match_id) GROUP BY 1""",
        "quality_details": f"""WITH t AS (SELECT event_id, match_id, player_id, t_us, x_pitch, heart_rate_bpm, CASE WHEN event_id % 13 > 0 THEN speed_ms END AS speed_ms, ['LOW_TEMPO', 'COUNTER', 'SETTLED'][event_id % 4 + 1] AS phase FROM ({oracle("telemetry")})),
p AS (SELECT 'pos' || player_id % 4 AS name, avg(x_pitch) m, stddev_samp(x_pitch) s FROM t WHERE x_pitch IS NOT NULL GROUP BY 1 HAVING count(*) > 10),
r AS (SELECT *, sum(CASE WHEN coalesce(speed_ms >= 5.5, false) THEN 0 ELSE 1 END) OVER (PARTITION BY match_id, player_id ORDER BY t_us, event_id) g FROM t), n AS (SELECT count(*) n FROM r WHERE speed_ms >= 5.5 GROUP BY match_id, player_id, g),
l AS (SELECT speed_ms, {", ".join(f"lead(heart_rate_bpm, {k}) OVER w h{k}" for k in range(1, 6))} FROM t WHERE speed_ms IS NOT NULL AND heart_rate_bpm IS NOT NULL WINDOW w AS (PARTITION BY match_id, player_id ORDER BY t_us, event_id)),
c AS ({" UNION ALL ".join(f"SELECT {k} k, round(corr(speed_ms, h{k}), 6) v FROM l" for k in range(1, 6))}),
x AS (SELECT sprint_count / 2::DOUBLE xg FROM ({oracle("sessions")}) WHERE session_id % 3 > 0 AND session_id % 5 > 0)
SELECT 'x_mean' figure, name, round(m, 6) AS value FROM p UNION ALL SELECT 'x_spread', name, round(s, 6) FROM p UNION ALL SELECT 'speed_share', 'high', round(avg((speed_ms > 5.5)::INT), 9) FROM t UNION ALL SELECT 'speed_share', 'walk', round(avg((speed_ms < 2)::INT), 9) FROM t
UNION ALL SELECT 'sprint_fano', NULL, round(var_pop(n) / avg(n), 6) FROM n UNION ALL SELECT 'phase_share', phase, round(count(*) / (SELECT count(*) FROM t), 9) FROM t WHERE phase IS NOT NULL GROUP BY 2
UNION ALL SELECT 'hr_lag', k::VARCHAR, v FROM c UNION ALL SELECT 'best_hr_lag', NULL, arg_max(k, v)::DOUBLE FROM c UNION ALL SELECT 'xg', 'mean', round(avg(xg), 6) FROM x UNION ALL SELECT 'xg', 'max', max(xg) FROM x UNION ALL SELECT 'dropout', NULL, round(avg((speed_ms IS NULL)::INT), 9) FROM t""",
        "quality_report": f"""{tel}, t AS (SELECT *, lag(speed_ms) OVER w l, abs(acceleration_ms2 - lag(acceleration_ms2) OVER w) j, (t_us - lag(t_us) OVER w) / 1e6::DOUBLE dt, t_us < lag(t_us) OVER (PARTITION BY match_id, player_id ORDER BY event_id) late FROM ev WINDOW w AS (PARTITION BY match_id, player_id ORDER BY t_us, event_id)) SELECT round(corr(speed_ms, l), 6) autocorrelation, round(avg(abs(acceleration_ms2)), 9) mean_accel, round(avg(j), 9) mean_jerk, round(quantile_cont(abs(acceleration_ms2), 0.99), 9) p99_accel, round(avg((heart_rate_bpm IS NULL)::INT), 9) missing_hr, round(avg(coalesce(speed_ms >= 5.5, false)::INT), 9) sprint_share,
 round(avg(coalesce(late, false)::INT), 9) late_share, round(avg(coalesce(speed_ms < 0.5, false)::INT), 9) still_share, round(avg(speed_ms), 9) mean_speed, round(stddev_pop(speed_ms), 6) speed_spread, round(avg(dt), 3) mean_dt, round(stddev_pop(dt), 3) dt_spread FROM t""",
    }
