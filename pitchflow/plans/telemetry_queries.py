"""Registered queries over ticks and their SQL. Gaps and buckets are of the events' scale: hours and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as T
from ..operators import windows as X
from .views import oracle, view

HOUR, DAY = 3_600_000_000, 86_400_000_000
BUCKET = 6 * HOUR


def _ticks(spark, d):
    return view(spark, d, "telemetry")


def clean_positions(spark, d):
    return T.clean_positions(_ticks(spark, d)).select("event_id", "speed_ms", "acceleration_ms2", "heart_rate_bpm", F.array_join("issues", ",").alias("issues"), "valid")


def observation_quality(spark, d):
    return T.with_quality(_ticks(spark, d)).select("event_id", "quality")


def movement_class(spark, d):
    t = T.with_intensity_flags(_ticks(spark, d))
    return t.select("event_id", T.movement_class(F.col("speed_ms")).alias("movement"), T.zone_id(F.col("x_pitch"), F.col("y_pitch")).alias("zone"), "is_sprint", "is_high_intensity")


def distance_delta(spark, d):
    return T.with_distance_delta(_ticks(spark, d)).select("event_id", F.round("distance_delta", 4).alias("distance_delta"))


def telemetry_validity(spark, d):
    return T.telemetry_validity(_ticks(spark, d), gap_us=DAY).select("event_id", "confidence", "status")


def causal_filter(spark, d):
    return T.causal_filter(_ticks(spark, d).withColumn("t_us", F.col("t_us") - (F.col("event_id") % 5) * DAY)).select("event_id", "t_us")


def resample(spark, d):
    return T.resample(_ticks(spark, d), BUCKET)


def session_summary(spark, d):
    return T.session_summary(resample(spark, d))


def event_features(spark, d):
    t = _ticks(spark, d)
    t0 = t.filter("player_id % 13 > 0").groupBy("match_id", "player_id").agg((F.min("t_us") + BUCKET // 2).alias("t0_us"))
    return T.event_window_features(view(spark, d, "labelled"), t0, BUCKET)


def merged_features(spark, d):
    f = event_features(spark, d).select("match_id", "player_id", "bucket", "pass_event_count", "shot_event_count", "sprint_distance_m")
    return T.merge_event_features(resample(spark, d).select("match_id", "player_id", "bucket", "n_ticks"), f)


def enrich_fatigue(spark, d):
    t = _ticks(spark, d)
    base = t.filter("player_id % 2 = 0").groupBy("player_id").agg(F.lit(0.001).alias("alpha"), F.round(F.max("speed_ms"), 4).alias("beta"), F.round(F.avg("speed_ms"), 4).alias("start_speed"))
    return T.enrich_fatigue(t, base).select("event_id", "expected_speed")


def build_windows(spark, d):
    w = X.gap_audit(X.build_windows(_ticks(spark, d), 8, 4), DAY)
    return w.select("match_id", "player_id", "window", "start_us", "end_us", "mean_speed", "max_gap_us", "has_gap", X.classify_regime(F.col("mean_x"), F.col("sprint_share")).alias("regime"))


def gap_filter(spark, d):
    return X.gap_filter(X.build_windows(_ticks(spark, d), 4, 4), "drop", 2 * DAY).select("match_id", "player_id", "window", "max_gap_us")


def accumulate_windows(spark, d):
    return X.accumulate_windows(_ticks(spark, d), 4, 2, 2 * DAY)


def sliding_buffer(spark, d):
    return X.sliding_buffer(_ticks(spark, d), 4, 2 * DAY)


def tick_features(spark, d):
    return X.tick_features(_ticks(spark, d))


def trailing_window(spark, d):
    return X.trailing_window(_ticks(spark, d), 86400.0 * 2)


def ema(spark, d):
    e = X.ema(_ticks(spark, d), "speed_ms", ("player_id",), ("t_us", "event_id"))
    return e.select("event_id", F.round("ema", 9).alias("ema"))


def ema_held(spark, d):
    t = T.telemetry_validity(_ticks(spark, d), gap_us=DAY)
    return X.ema(t, "speed_ms", ("player_id",), ("t_us", "event_id"), update_if=F.col("confidence") >= 0.8).select("event_id", F.round("ema", 9).alias("ema"))


def trend_signal(spark, d):
    return X.trend_labels(X.trend_signal(_ticks(spark, d), "speed_ms", ("player_id",), ("t_us", "event_id")), "workload").drop("t_us")


def queries() -> dict:
    names = "clean_positions observation_quality movement_class distance_delta telemetry_validity causal_filter resample session_summary event_features merged_features enrich_fatigue build_windows gap_filter accumulate_windows sliding_buffer tick_features trailing_window ema ema_held trend_signal"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    ev = f"WITH ev AS ({oracle('telemetry')})"
    pw = "PARTITION BY match_id, player_id ORDER BY t_us, event_id"
    aw = "PARTITION BY match_id, player_id ORDER BY event_id"
    dist = f"""dd AS (SELECT *, CASE WHEN lag(x_pitch) OVER ({pw}) IS NULL THEN 0 ELSE sqrt(pow(x_pitch - lag(x_pitch) OVER ({pw}), 2) + pow(y_pitch - lag(y_pitch) OVER ({pw}), 2)) END dist,
 (t_us - min(t_us) OVER (PARTITION BY match_id, player_id)) // {BUCKET} bucket FROM ev)"""
    res = f"""{dist}, rs AS (SELECT match_id, player_id, bucket, round(avg(speed_ms), 9) mean_speed, max(speed_ms) max_speed, round(coalesce(avg(acceleration_ms2), 0), 9) mean_accel, round(avg(x_pitch), 9) mean_x, round(avg(y_pitch), 9) mean_y,
 round(sum(dist), 9) distance, bool_or(speed_ms >= 5.5) any_sprint, round(avg(heart_rate_bpm), 9) mean_hr, count(speed_ms) n_ticks FROM dd GROUP BY 1, 2, 3)"""
    num = lambda i: f"CASE WHEN value_{i} IS NOT NULL THEN coalesce(TRY_CAST(value_{i} AS DOUBLE), 0) END"
    agg = {"mean": "avg", "max": "max", "sum": "sum"}

    def feat(name: str) -> str:
        label, how, slot, factor = T.EVENT_FEATURES[name]
        if how == "count":
            return f"(count(*) FILTER (label = '{label}'))::DOUBLE {name}"
        v = f"({num(slot)}) {'/ 3.6::DOUBLE' if factor != 1 else ''}"
        return f"round(coalesce({agg[how.split('_')[0]]}({f'abs({v})' if how.endswith('_abs') else v}) FILTER (label = '{label}'), 0), 9) {name}"

    feats = f"""t0 AS (SELECT match_id, player_id, min(t_us) + {BUCKET // 2} t0 FROM ev WHERE player_id % 13 > 0 GROUP BY 1, 2), lab AS ({oracle("labelled")}),
 fe AS (SELECT match_id, player_id, (t_us - t0) // {BUCKET} bucket, {', '.join(feat(n) for n in T.EVENT_FEATURES)} FROM lab JOIN t0 USING (match_id, player_id) WHERE t_us >= t0 GROUP BY 1, 2, 3)"""
    valid = f"""b AS (SELECT *, (speed_ms IS NOT NULL)::INT + (heart_rate_bpm IS NOT NULL)::INT + (x_pitch IS NOT NULL)::INT + (acceleration_ms2 IS NOT NULL)::INT >= 3 w, lag(t_us) OVER ({aw}) bt FROM ev),
 v1 AS (SELECT *, CASE WHEN abs(acceleration_ms2) > 12 THEN 0 ELSE 1 END::DOUBLE c FROM b), v2 AS (SELECT * REPLACE (CASE WHEN speed_ms > 16.2 THEN 0 WHEN speed_ms > 13.5 THEN c - 0.25 ELSE c END AS c) FROM v1),
 v3 AS (SELECT * REPLACE (CASE WHEN heart_rate_bpm IS NULL THEN c - 0.2 WHEN heart_rate_bpm NOT BETWEEN 30 AND 220 THEN 0 ELSE c END AS c) FROM v2),
 v4 AS (SELECT * REPLACE (CASE WHEN w THEN round(CASE WHEN t_us - bt <= 0 THEN 0 WHEN t_us - bt > {DAY} THEN c - 0.3 ELSE c END, 6) ELSE 0 END AS c) FROM v3),
 va AS (SELECT *, greatest(c, 0)::DOUBLE confidence, CASE WHEN c <= 0 THEN 'INVALID' WHEN c < 0.8 THEN 'DEGRADED' ELSE 'VALID' END status FROM v4)"""
    wins = lambda steps, stride: f"""n AS (SELECT *, row_number() OVER ({pw}) - 1 k, count(*) OVER (PARTITION BY match_id, player_id) m, t_us - lag(t_us) OVER ({pw}) dt FROM ev),
 w AS (SELECT a.match_id, a.player_id, a.k // {stride} AS window, min(b.t_us) start_us, max(b.t_us) end_us, round(avg(b.speed_ms), 9) mean_speed, round(avg(b.x_pitch), 6) mx, round(avg((coalesce(b.speed_ms, 0) >= 5.5)::INT), 6) ss,
 max(CASE WHEN b.k > a.k THEN b.dt END) max_gap_us FROM n a JOIN n b ON a.match_id = b.match_id AND a.player_id = b.player_id AND b.k BETWEEN a.k AND a.k + {steps - 1} WHERE a.k % {stride} = 0 AND a.k + {steps} <= a.m GROUP BY a.match_id, a.player_id, a.k)"""  # noqa: E731
    isl = f"""i1 AS (SELECT *, coalesce((t_us - lag(t_us) OVER ({aw}) NOT BETWEEN 0 AND {2 * DAY})::INT, 0) r FROM ev), i2 AS (SELECT *, sum(r) OVER ({aw}) island FROM i1),
 i3 AS (SELECT *, row_number() OVER w - 1 k, count(*) OVER (PARTITION BY match_id, player_id, island) m FROM i2 WINDOW w AS (PARTITION BY match_id, player_id, island ORDER BY event_id))"""
    fold = lambda src, on: f"""q AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY t_us, event_id) rn FROM {src}),
 f AS (SELECT player_id, event_id, rn, CASE WHEN {on} THEN speed_ms END s FROM q WHERE rn = 1 UNION ALL
 SELECT q.player_id, q.event_id, q.rn, CASE WHEN NOT ({on}) THEN f.s WHEN f.s IS NULL THEN q.speed_ms ELSE 0.25::DOUBLE * q.speed_ms + 0.75::DOUBLE * f.s END FROM f JOIN q ON q.player_id = f.player_id AND q.rn = f.rn + 1)
 SELECT event_id, round(s, 9) ema FROM f"""  # noqa: E731
    issues = "array_to_string(list_filter([CASE WHEN x_pitch IS NULL OR y_pitch IS NULL THEN 'missing_coordinates' END, CASE WHEN speed_ms < 0 THEN 'negative_speed' END, CASE WHEN speed_ms > 12 THEN 'speed_artefact' END, CASE WHEN abs(acceleration_ms2) > 25 THEN 'accel_artefact' END], lambda x: x IS NOT NULL), ',')"
    return {
        "clean_positions": f"{ev} SELECT event_id, CASE WHEN speed_ms < 0 THEN NULL ELSE least(speed_ms, 12.0::DOUBLE) END speed_ms, CASE WHEN abs(acceleration_ms2) <= 25 THEN acceleration_ms2 END acceleration_ms2, CASE WHEN heart_rate_bpm BETWEEN 20 AND 250 THEN heart_rate_bpm END heart_rate_bpm, {issues} issues, {issues} = '' valid FROM ev",
        "observation_quality": f"{ev} SELECT event_id, CASE WHEN heart_rate_bpm IS NULL THEN 0.75::DOUBLE ELSE 1 END quality FROM ev",
        "movement_class": f"""{ev} SELECT event_id, CASE WHEN speed_ms >= 7 THEN 'sprint' WHEN speed_ms >= 5.5 THEN 'high_intensity_run' WHEN speed_ms >= 2 THEN 'jog' ELSE 'walk' END movement,
 CASE WHEN x_pitch < 33.3 THEN 'def' WHEN x_pitch < 66.7 THEN 'mid' ELSE 'att' END || '_' || CASE WHEN y_pitch < 33.3 THEN 'L' WHEN y_pitch < 66.7 THEN 'C' ELSE 'R' END AS zone, speed_ms >= 5.5 is_sprint, speed_ms >= 4.17 is_high_intensity FROM ev""",
        "distance_delta": f"{ev}, {dist} SELECT event_id, round(dist, 4) distance_delta FROM dd",
        "telemetry_validity": f"{ev}, {valid} SELECT event_id, confidence, status FROM va",
        "causal_filter": f"{ev}, s AS (SELECT event_id, match_id, player_id, t_us - (event_id % 5) * {DAY} t_us FROM ev) SELECT event_id, t_us FROM s QUALIFY t_us >= max(t_us) OVER ({aw} ROWS UNBOUNDED PRECEDING)",
        "resample": f"{ev}, {res} SELECT * FROM rs WHERE n_ticks > 0",
        "session_summary": f"{ev}, {res} SELECT match_id, player_id, min(bucket) first_bucket, max(bucket) last_bucket, round(sum(distance), 9) total_distance, count(*) FILTER (any_sprint) sprint_buckets, max(max_speed) max_speed, round(sum(CASE WHEN max_speed >= 4.17 THEN distance ELSE 0 END), 9) high_speed_distance, count(*) n_buckets FROM rs GROUP BY 1, 2",
        "event_features": f"{ev}, {feats} SELECT * FROM fe",
        "merged_features": f"{ev}, {res}, {feats} SELECT r.match_id, r.player_id, r.bucket, n_ticks, coalesce(pass_event_count, 0) pass_event_count, coalesce(shot_event_count, 0) shot_event_count, coalesce(sprint_distance_m, 0) sprint_distance_m FROM rs r LEFT JOIN fe USING (match_id, player_id, bucket)",
        "enrich_fatigue": f"{ev}, bl AS (SELECT player_id, round(max(speed_ms), 4) beta FROM ev WHERE player_id % 2 = 0 GROUP BY 1) SELECT event_id, round(coalesce(beta, speed_ms * 1.3::DOUBLE) * exp(-(CASE WHEN beta IS NULL THEN 0.005::DOUBLE ELSE 0.001::DOUBLE END) * ((t_us - min(t_us) OVER (PARTITION BY match_id, player_id)) / 6e7::DOUBLE)), 4) expected_speed FROM ev LEFT JOIN bl USING (player_id)",
        "build_windows": f"""{ev}, {wins(8, 4)} SELECT match_id, player_id, "window", start_us, end_us, mean_speed, max_gap_us, max_gap_us > {DAY} has_gap, CASE WHEN mx < 33 THEN 'defensive' WHEN mx > 67 THEN 'attacking' ELSE 'middle' END || '__' || CASE WHEN ss >= 0.15 THEN 'high' WHEN ss >= 0.04 THEN 'medium' ELSE 'low' END regime FROM w""",
        "gap_filter": f"""{ev}, {wins(4, 4)} SELECT match_id, player_id, "window", max_gap_us FROM w WHERE max_gap_us <= {2 * DAY}""",
        "accumulate_windows": f"{ev}, {isl} SELECT a.match_id, a.player_id, CAST(a.island AS BIGINT) island, a.event_id first_event_id, max(b.event_id) last_event_id, a.t_us start_us, max(b.t_us) end_us, round(avg(b.speed_ms), 9) mean_speed FROM i3 a JOIN i3 b ON a.match_id = b.match_id AND a.player_id = b.player_id AND a.island = b.island AND b.k BETWEEN a.k AND a.k + 3 WHERE a.k % 2 = 0 AND a.k + 4 <= a.m GROUP BY a.match_id, a.player_id, a.island, a.event_id, a.t_us",
        "sliding_buffer": f"{ev}, {isl} SELECT a.match_id, a.player_id, a.event_id, a.t_us, min(b.t_us) start_us, round(avg(b.speed_ms), 9) mean_speed FROM i3 a JOIN i3 b ON a.match_id = b.match_id AND a.player_id = b.player_id AND a.island = b.island AND b.k BETWEEN a.k - 3 AND a.k WHERE a.k >= 3 GROUP BY a.match_id, a.player_id, a.event_id, a.t_us",
        "tick_features": f"""{ev}, l AS (SELECT *, lag(speed_ms) OVER w ls, lag(heart_rate_bpm) OVER w lh, lag(x_pitch) OVER w lx, lag(y_pitch) OVER w ly, lag(event_id) OVER w le FROM ev WINDOW w AS ({pw})), k AS (SELECT *, coalesce(x_pitch, 50) x, coalesce(y_pitch, 50) y FROM l)
 SELECT match_id, player_id, event_id, t_us, coalesce(speed_ms, 0) speed_ms, round(coalesce(CASE WHEN speed_ms IS NULL OR ls IS NULL THEN NULL ELSE greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (speed_ms - ls) / 15.0::DOUBLE)) END, 0), 9) acceleration_ms2, coalesce(heart_rate_bpm, 0)::DOUBLE heart_rate_bpm, coalesce(speed_ms >= 5.5, false)::INT::DOUBLE sprint_flag, x x_pitch, y y_pitch,
 round(CASE WHEN le IS NULL THEN 0 ELSE sqrt(pow((x - coalesce(lx, x)) / 100 * 20, 2) + pow((y - coalesce(ly, y)) / 100 * 40, 2)) END, 9) distance_delta_m, round(coalesce(CASE WHEN heart_rate_bpm IS NULL OR lh IS NULL THEN NULL ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (lh - heart_rate_bpm) / greatest(lh, 1))) END, 0), 9) hr_recovery_rate, {', '.join(f'0::DOUBLE {n}' for n in T.EVENT_FEATURES)} FROM k""",
        "trailing_window": f"{ev} SELECT match_id, player_id, event_id, t_us, CAST(count(*) FILTER (speed_ms >= 5.5) OVER w AS BIGINT) sprints, round(avg(speed_ms) OVER w, 9) mean_speed, round(CASE WHEN count(speed_ms) OVER w >= 2 THEN sum(speed_ms) OVER w * (172800.0::DOUBLE / count(speed_ms) OVER w) ELSE 0 END, 5) distance FROM ev WINDOW w AS (PARTITION BY match_id, player_id ORDER BY t_us RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW)",
        "ema": f"WITH RECURSIVE ev AS ({oracle('telemetry')}), {fold('ev', 'q.speed_ms IS NOT NULL')}",
        "ema_held": f"WITH RECURSIVE ev AS ({oracle('telemetry')}), {valid}, {fold('va', 'q.confidence >= 0.8')}",
        "trend_signal": f"""{ev}, r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY t_us, event_id)::DOUBLE i FROM ev), s AS (SELECT player_id, event_id, round(CASE WHEN count(speed_ms) OVER w >= 4 THEN regr_slope(speed_ms, i) OVER w ELSE 0 END, 9) slope, round(stddev_pop(speed_ms) OVER w, 9) volatility, count(speed_ms) OVER w n,
  list_filter(list({{'x': i, 'y': speed_ms}}) OVER w, lambda q: q.y IS NOT NULL) l FROM r WINDOW w AS (PARTITION BY player_id ORDER BY t_us, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
 m AS (SELECT *, list_avg(list_transform(l, lambda q: q.x)) mx, list_avg(list_transform(l, lambda q: q.y)) my FROM s), k AS (SELECT *, list_transform(l, lambda q: q.x - mx) xs, list_transform(l, lambda q: q.y - my) ys FROM m),
 u AS (SELECT *, list_sum(list_transform(xs, lambda x: x * x)) s2, list_sum(list_transform(xs, lambda x: x * x * x)) s3, list_sum(list_transform(xs, lambda x: x * x * x * x)) s4, list_dot_product(xs, ys) sxy, list_dot_product(list_transform(xs, lambda x: x * x), ys) sxxy FROM k),
 c AS (SELECT player_id, event_id, slope, round(CASE WHEN n >= 6 THEN (sxxy * s2 - sxy * s3) / ((s4 - s2 * s2 / n) * s2 - s3 * s3) ELSE 0 END, 9) curvature, volatility, n FROM u)
 SELECT *, CASE WHEN n < 4 THEN 'insufficient data' WHEN slope > 0.05 THEN 'increasing' WHEN slope < -0.05 THEN 'declining' ELSE 'stable' END direction, CASE WHEN n < 4 THEN 'steady' WHEN curvature > 0.02 THEN 'accelerating_deterioration' WHEN curvature < -0.02 THEN 'accelerating_recovery' ELSE 'steady' END acceleration,
  CASE WHEN n < 4 THEN 'low' WHEN volatility >= 0.35 THEN 'high' WHEN volatility >= 0.15 THEN 'medium' ELSE 'low' END volatility_band FROM c""",
    }
