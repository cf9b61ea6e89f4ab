"""Projections, validity and resampling of tracking ticks. Ticks: match_id, player_id, t_us, event_id (arrival order),
speed_ms, acceleration_ms2, heart_rate_bpm, x_pitch, y_pitch; null marks an absent value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.thresholds import TELEMETRY, TelemetryThresholds

ORDER = ("t_us", "event_id")


def player_window(*order: str) -> W:
    return W.partitionBy("match_id", "player_id").orderBy(*(order or ORDER))


def normalise_coords(x_m: Column, y_m: Column, t: TelemetryThresholds = TELEMETRY) -> tuple[Column, Column]:
    """Metres from the centre to 0..100 of the pitch; the centre where a coordinate is missing."""
    def one(m: Column, length: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (m + length / 2) / length * 100))

    missing = x_m.isNull() | y_m.isNull()
    return F.when(missing, 50.0).otherwise(one(x_m, t.pitch_length)), F.when(missing, 50.0).otherwise(one(y_m, t.pitch_width))


def gps_to_pitch(lat: Column, lon: Column, lat0: float, lon0: float, length_m: float, width_m: float) -> tuple[Column, Column]:
    """Equirectangular projection about an origin to 0..100, rounded to 2 places."""
    radius = 6_371_000.0
    x = F.radians(lon - lon0) * F.cos(F.radians(F.lit(lat0))) * radius
    y = F.radians(lat - lat0) * radius
    clamp = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 2)
    return clamp(x / length_m * 100), clamp(y / width_m * 100)


def with_intensity_flags(ticks: DataFrame, t: TelemetryThresholds = TELEMETRY) -> DataFrame:
    s = F.col("speed_ms")
    return ticks.withColumns({"is_sprint": F.coalesce(s >= t.sprint, F.lit(False)), "is_high_intensity": F.coalesce(s >= t.high_intensity, F.lit(False))})


def movement_class(speed: Column, kept: Column | None = None) -> Column:
    found = F.when(speed >= 7.0, "sprint").when(speed >= 5.5, "high_intensity_run").when(speed >= 2.0, "jog").otherwise("walk")
    return found if kept is None else F.coalesce(kept, found)


def zone_id(x: Column, y: Column) -> Column:
    third = F.when(x < 33.3, "def").when(x < 66.7, "mid").otherwise("att")
    return F.concat_ws("_", third, F.when(y < 33.3, "L").when(y < 66.7, "C").otherwise("R"))


def classify_ownership(group: Column, own: str) -> Column:
    return F.when(group == "Ball", "BALL").when(group == own, "OWN").otherwise("OPPONENT")


def clean_positions(ticks: DataFrame, t: TelemetryThresholds = TELEMETRY) -> DataFrame:
    """Flags (not drops) implausible values: speed above the limit is cut to it, negative speed and large acceleration
    and heart rates out of range become null; valid: no issue."""
    s, a, h = F.col("speed_ms"), F.col("acceleration_ms2"), F.col("heart_rate_bpm")
    issues = F.array(
        F.when(F.col("x_pitch").isNull() | F.col("y_pitch").isNull(), "missing_coordinates"), F.when(s < 0, "negative_speed"), F.when(s > t.max_speed, "speed_artefact"), F.when(F.abs(a) > t.max_accel, "accel_artefact")
    )
    return ticks.withColumns({
        "issues": F.array_compact(issues), "speed_ms": F.when(s < 0, None).when(s > t.max_speed, t.max_speed).otherwise(s),
        "acceleration_ms2": F.when(F.abs(a) > t.max_accel, None).otherwise(a), "heart_rate_bpm": F.when(h.between(t.hr_low, t.hr_high), h),
    }).withColumn("valid", F.size("issues") == 0)


def with_quality(ticks: DataFrame) -> DataFrame:
    """Share of the four measurements that a tick has; 0 where it has no position or a speed below 0."""
    share = sum((F.col(c).isNotNull().cast("int") for c in ("speed_ms", "heart_rate_bpm", "x_pitch", "y_pitch")), F.lit(0)) / 4
    ok = F.col("x_pitch").isNotNull() & F.col("y_pitch").isNotNull() & F.coalesce(F.col("speed_ms") >= 0, F.lit(True))
    return ticks.withColumn("quality", F.when(ok, share).otherwise(0.0))


def with_distance_delta(ticks: DataFrame) -> DataFrame:
    """Distance from the last tick that had coordinates; 0 for the first, and for ticks without."""
    has = F.col("x_pitch").isNotNull() & F.col("y_pitch").isNotNull()
    last = F.last(F.when(has, F.struct("x_pitch", "y_pitch")), ignorenulls=True).over(player_window().rowsBetween(W.unboundedPreceding, -1))
    d = F.sqrt(F.pow(F.col("x_pitch") - last.x_pitch, 2) + F.pow(F.col("y_pitch") - last.y_pitch, 2))
    return ticks.withColumn("distance_delta", F.coalesce(F.when(has, d), F.lit(0.0)))


def telemetry_validity(ticks: DataFrame, replay: bool = False, t: TelemetryThresholds = TELEMETRY, gap_us: int | None = None) -> DataFrame:
    """confidence and status of each tick. Ticks with fewer than three of four measurements are invalid and don't count
    as predecessors. Times are held against the predecessor in order of arrival (event_id): going back is invalid (in
    replay at most 0.7), a gap costs 0.3 (in replay nothing)."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("speed_ms", "heart_rate_bpm", "x_pitch", "acceleration_ms2")), F.lit(0))
    whole = filled >= 3
    before = F.last(F.when(whole, F.col("t_us")), ignorenulls=True).over(W.partitionBy("match_id", "player_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    s, h, dt = F.col("speed_ms"), F.col("heart_rate_bpm"), F.col("t_us") - F.col("_before")
    c = F.when(F.coalesce(F.abs("acceleration_ms2") > t.valid_accel, F.lit(False)), 0.0).otherwise(1.0)
    c = F.when(s > t.valid_speed * 1.2, 0.0).when(s > t.valid_speed, c - t.speed_penalty).otherwise(c)
    c = F.when(h.isNull(), c - t.hr_absent_penalty).when(~h.between(t.valid_hr_low, t.valid_hr_high), 0.0).otherwise(c)
    if replay:
        c = F.when(dt <= 0, F.least(c, F.lit(0.7))).otherwise(c)
    else:
        c = F.when(dt <= 0, 0.0).when(dt > (gap_us or t.gap_us), c - t.gap_penalty).otherwise(c)
    c = F.when(whole, c).otherwise(0.0)
    return ticks.withColumn("_before", before).withColumn("_c", F.round(c, 6)).withColumns({
        "confidence": F.greatest("_c", F.lit(0.0)), "status": F.when(F.col("_c") <= 0, "INVALID").when(F.col("_c") < t.degraded, "DEGRADED").otherwise("VALID")
    }).drop("_before", "_c")


def effective_confidence(confidence: Column, replay: bool, floor: float = 0.8) -> Column:
    return F.greatest(confidence, F.lit(floor)) if replay else confidence


def causal_filter(ticks: DataFrame) -> DataFrame:
    """Ticks no earlier than any that arrived before. What is left out never raises the maximum, so a running one does."""
    w = W.partitionBy("match_id", "player_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return ticks.withColumn("_max", F.max("t_us").over(w)).filter("t_us >= _max").drop("_max")


def with_buckets(ticks: DataFrame, bucket_us: int) -> DataFrame:
    """bucket: the tick's interval since the player's first tick of the match."""
    t0 = F.min("t_us").over(W.partitionBy("match_id", "player_id"))
    return ticks.withColumn("bucket", F.floor((F.col("t_us") - t0) / bucket_us).cast("long"))


def resample(ticks: DataFrame, bucket_us: int = 15_000_000, t: TelemetryThresholds = TELEMETRY) -> DataFrame:
    """Ticks to buckets; those without any speed are dropped. Path length counts in the bucket it leads into."""
    b = with_buckets(with_distance_delta(ticks), bucket_us)
    s = F.col("speed_ms")
    out = b.groupBy("match_id", "player_id", "bucket").agg(
        F.round(F.avg(s), 9).alias("mean_speed"), F.max(s).alias("max_speed"), F.round(F.coalesce(F.avg("acceleration_ms2"), F.lit(0.0)), 9).alias("mean_accel"), F.round(F.avg("x_pitch"), 9).alias("mean_x"),
        F.round(F.avg("y_pitch"), 9).alias("mean_y"), F.round(F.sum("distance_delta"), 9).alias("distance"), F.bool_or(F.coalesce(s >= t.sprint, F.lit(False))).alias("any_sprint"), F.round(F.avg("heart_rate_bpm"), 9).alias("mean_hr"), F.count(s).alias("n_ticks"),
    )
    return out.filter("n_ticks > 0")


def session_summary(buckets: DataFrame, t: TelemetryThresholds = TELEMETRY) -> DataFrame:
    return buckets.groupBy("match_id", "player_id").agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.round(F.sum("distance"), 9).alias("total_distance"), F.count_if("any_sprint").alias("sprint_buckets"), F.max("max_speed").alias("max_speed"),
        F.round(F.sum(F.when(F.col("max_speed") >= t.high_intensity, F.col("distance")).otherwise(0.0)), 9).alias("high_speed_distance"), F.count("*").alias("n_buckets"),
    )


# A feature's label, how it is aggregated, and its slot (value_i) and factor; speeds come in km/h.
EVENT_FEATURES = {
    "accel_event_count": ("Acceleration", "count", 0, 1.0), "accel_mean_ms2": ("Acceleration", "mean", 5, 1.0), "accel_max_ms2": ("Acceleration", "max", 4, 1.0),
    "decel_event_count": ("Deceleration", "count", 0, 1.0), "decel_mean_ms2": ("Deceleration", "mean_abs", 5, 1.0), "decel_max_ms2": ("Deceleration", "max_abs", 4, 1.0),
    "sprint_event_count": ("Sprint", "count", 0, 1.0), "sprint_distance_m": ("Sprint", "sum", 2, 1.0), "sprint_duration_s": ("Sprint", "sum", 1, 1.0), "sprint_max_speed_ms": ("Sprint", "max", 3, 1 / 3.6),
    "jump_event_count": ("Jump", "count", 0, 1.0), "jump_avg_height_m": ("Jump", "mean", 2, 1.0), "jump_max_height_m": ("Jump", "max", 2, 1.0),
    "cod_event_count": ("Change of Direction", "count", 0, 1.0), "cod_angle_sum_deg": ("Change of Direction", "sum_abs", 1, 1.0), "cod_angle_mean_deg": ("Change of Direction", "mean_abs", 1, 1.0),
    "possession_event_count": ("Ball Possession", "count", 0, 1.0), "possession_duration_s": ("Ball Possession", "sum", 1, 1.0),
    "pass_event_count": ("Pass", "count", 0, 1.0), "pass_avg_distance_m": ("Pass", "mean", 1, 1.0), "pass_avg_ball_speed_ms": ("Pass", "mean", 2, 1 / 3.6),
    "shot_event_count": ("Shots", "count", 0, 1.0), "shot_avg_speed_ms": ("Shots", "mean", 2, 1 / 3.6), "shot_avg_distance_m": ("Shots", "mean", 1, 1.0),
}


def event_window_features(events: DataFrame, t0: DataFrame, bucket_us: int) -> DataFrame:
    """24 features of the events (match_id, player_id, t_us, label, value_1 to value_5 as text) per (match, player, bucket)
    since the player's t0: players without one and events before it are dropped; text that is no number counts as 0, a
    slot that lacks is left out; a bucket of other events alone is a row of zeros. One pass, combined before the shuffle."""
    e = events.join(t0, ["match_id", "player_id"]).filter("t_us >= t0_us").withColumn("bucket", F.floor((F.col("t_us") - F.col("t0_us")) / bucket_us).cast("long"))

    def feature(name: str) -> Column:
        label, how, slot, factor = EVENT_FEATURES[name]
        here = F.col("label") == label
        if how == "count":
            return F.count_if(here).cast("double").alias(name)
        v = F.when(here & F.col(f"value_{slot}").isNotNull(), F.coalesce(F.expr(f"try_cast(value_{slot} AS double)"), F.lit(0.0)) * factor)
        v = F.abs(v) if how.endswith("_abs") else v
        total = {"mean": F.avg, "max": F.max, "sum": F.sum}[how.split("_")[0]](v)
        return F.round(F.coalesce(total, F.lit(0.0)), 9).alias(name)

    return e.groupBy("match_id", "player_id", "bucket").agg(*[feature(n) for n in EVENT_FEATURES])


def merge_event_features(buckets: DataFrame, features: DataFrame) -> DataFrame:
    """Features onto buckets by (match, player, bucket); 0 where there are none."""
    keys = ["match_id", "player_id", "bucket"]
    return buckets.join(features, keys, "left").fillna(0, [c for c in features.columns if c not in keys])


def enrich_fatigue(ticks: DataFrame, baselines: DataFrame) -> DataFrame:
    """Expected speed beta * exp(-alpha * minutes), the residual times 15, and the drop from the starting speed in
    percent. A player without a baseline has alpha 0.005 and beta 1.3 times the speed."""
    minutes = (F.col("t_us") - F.min("t_us").over(W.partitionBy("match_id", "player_id"))) / 6e7
    s = F.col("speed_ms")
    e = ticks.withColumn("_min", minutes).join(baselines, "player_id", "left")
    expected = F.coalesce("beta", s * 1.3) * F.exp(-F.coalesce("alpha", F.lit(0.005)) * F.col("_min"))
    start = F.coalesce("start_speed", "beta", s * 1.3)
    return e.withColumns({"expected_speed": F.round(expected, 4), "residual": F.round((s - expected) * 15, 2), "speed_drop_pct": F.round(F.when(start > 0, (start - s) / start * 100).otherwise(0.0), 1)}).drop("_min", "alpha", "beta", "start_speed")


def inject_faults(ticks: DataFrame, seed: int, dropout: float = 0.05, freeze: float = 0.05, spike: float = 0.02, jitter: float = 0.0) -> DataFrame:
    """Sensor faults by a hash of the tick's key, so that the same ticks fail wherever they run. With jitter, places of
    ticks that didn't drop out move by that deviation (normal, on the 0 to 100 of the pitch, within it), and ts_jitter_s
    says by how many seconds, -2 to 2, the tick's time would be off."""
    drawn = lambda k: F.pmod(F.xxhash64("match_id", "player_id", "event_id", F.lit(seed), *([F.lit(k)] if k else [])), F.lit(1_000_000)) / 1e6
    u = drawn(0)
    before = F.lag("speed_ms").over(player_window())
    s = F.when(u < dropout, None).when(u < dropout + freeze, F.coalesce(before, F.col("speed_ms"))).when(u < dropout + freeze + spike, F.col("speed_ms") * 3).otherwise(F.col("speed_ms"))
    out = ticks.withColumn("fault", F.when(u < dropout, "dropout").when(u < dropout + freeze, "freeze").when(u < dropout + freeze + spike, "spike")).withColumn("speed_ms", s)
    if jitter > 0:
        far, angle = F.sqrt(-2 * F.log(drawn(1) + 5e-7)) * jitter, drawn(2) * (2 * math.pi)
        moved = lambda c, by: F.when(F.coalesce(F.col("fault") == "dropout", F.lit(False)), F.col(c)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(c) + by)))
        out = out.withColumns({"x_pitch": moved("x_pitch", far * F.cos(angle)), "y_pitch": moved("y_pitch", far * F.sin(angle)), "ts_jitter_s": (F.floor(drawn(3) * 5) - 2).cast("int")})
    return out
