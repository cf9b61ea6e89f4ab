"""Sequence windows, gaps, regimes, smoothing and trends over a player's ticks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .telemetry import EVENT_FEATURES, ORDER, player_window

KEYS = ("match_id", "player_id")


def build_windows(ticks: DataFrame, steps: int = 8, stride: int = 8) -> DataFrame:
    """Full windows of `steps` ticks, one every `stride`: each tick is dealt to the windows that hold it."""
    n = F.row_number().over(player_window()) - 1
    lo, hi = F.greatest(F.floor((F.col("_n") - steps + stride) / stride), F.lit(0)), F.floor(F.col("_n") / stride)
    t = ticks.withColumn("_n", n).withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).filter("_lo <= _hi")
    t = t.withColumn("window", F.explode(F.sequence("_lo", "_hi")))
    agg = t.groupBy(*KEYS, "window").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*ORDER, "speed_ms", "x_pitch", "y_pitch", "heart_rate_bpm"))).alias("ticks"),
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.round(F.avg("x_pitch"), 6).alias("mean_x"), F.round(F.avg((F.coalesce(F.col("speed_ms") >= 5.5, F.lit(False))).cast("int")), 6).alias("sprint_share"),
        F.round(F.avg("speed_ms"), 9).alias("mean_speed"),
    )
    return agg.filter(F.col("n") == steps).drop("n")


def gap_audit(windows: DataFrame, threshold_us: int = 60_000_000) -> DataFrame:
    """max_gap_us inside each window, and whether it exceeds the threshold."""
    gaps = F.zip_with(F.slice("ticks", 2, 10_000), F.slice("ticks", 1, F.size("ticks") - 1), lambda b, a: b.t_us - a.t_us)
    return windows.withColumn("max_gap_us", F.array_max(gaps)).withColumn("has_gap", F.col("max_gap_us") > threshold_us)


def gap_filter(windows: DataFrame, mode: str = "drop", threshold_us: int = 60_000_000) -> DataFrame:
    audited = gap_audit(windows, threshold_us)
    return audited.filter("NOT has_gap") if mode == "drop" else audited


def classify_regime(mean_x: Column, sprint_share: Column) -> Column:
    territory = F.when(mean_x < 33, "defensive").when(mean_x > 67, "attacking").otherwise("middle")
    return F.concat_ws("__", territory, F.when(sprint_share >= 0.15, "high").when(sprint_share >= 0.04, "medium").otherwise("low"))


def _islands(ticks: DataFrame, gap_us: int) -> DataFrame:
    """island: runs of a player's ticks, in order of arrival, without a step back or a gap."""
    w = W.partitionBy(*KEYS).orderBy("event_id")
    step = F.col("t_us") - F.lag("t_us").over(w)
    t = ticks.withColumn("_reset", F.coalesce(((step < 0) | (step > gap_us)).cast("int"), F.lit(0)))
    return t.withColumn("island", F.sum("_reset").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_reset")


def accumulate_windows(ticks: DataFrame, steps: int = 8, stride: int = 8, gap_us: int = 60_000_000) -> DataFrame:
    """What a live buffer emits: it is emptied by a gap or a step back, gives a full window of `steps` ticks and lets go
    of the oldest `stride` of them. In an island of m ticks windows begin at k = 0, d, 2d, ... while k + steps <= m."""
    d = min(stride, steps)
    w = W.partitionBy(*KEYS, "island").orderBy("event_id")
    t = _islands(ticks, gap_us).withColumns({"_k": F.row_number().over(w) - 1, "_end": F.lead("event_id", steps - 1).over(w), "_end_us": F.lead("t_us", steps - 1).over(w)})
    mean = F.round(F.avg("speed_ms").over(w.rowsBetween(0, steps - 1)), 9)
    return t.withColumn("mean_speed", mean).filter((F.col("_k") % d == 0) & F.col("_end").isNotNull()).select(*KEYS, "island", F.col("event_id").alias("first_event_id"), F.col("_end").alias("last_event_id"), F.col("t_us").alias("start_us"), F.col("_end_us").alias("end_us"), "mean_speed")


def sliding_buffer(ticks: DataFrame, steps: int = 8, gap_us: int = 60_000_000) -> DataFrame:
    """One row per tick from an island's steps-th on: the window that ends there."""
    w = W.partitionBy(*KEYS, "island").orderBy("event_id")
    frame = w.rowsBetween(1 - steps, 0)
    t = _islands(ticks, gap_us).withColumns({"n": F.row_number().over(w), "start_us": F.min("t_us").over(frame), "mean_speed": F.round(F.avg("speed_ms").over(frame), 9)})
    return t.filter(F.col("n") >= steps).select(*KEYS, "event_id", "t_us", "start_us", "mean_speed")


def tick_features(ticks: DataFrame, step_s: float = 15.0, length_m: float = 40.0, width_m: float = 20.0) -> DataFrame:
    """The 32 channels of a tick: speed, acceleration against the last tick that has a speed (in +-10), heart rate, sprint,
    place, way since then in metres (the axes scaled apart), relative heart-rate recovery (in +-1), and the features of
    the tick's events, 0 where ticks doesn't have them."""
    before = player_window().rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("speed_ms").isNotNull(), F.struct("speed_ms", "heart_rate_bpm", "x_pitch", "y_pitch")), ignorenulls=True).over(before)
    clip = lambda c, a: F.when(c.isNotNull(), F.greatest(F.lit(-a), F.least(F.lit(a), c)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    accel = zero(clip((F.col("speed_ms") - last.speed_ms) / step_s, 10.0))
    recovery = zero(clip((last.heart_rate_bpm - F.col("heart_rate_bpm")) / F.greatest(last.heart_rate_bpm, F.lit(1)), 1.0))
    x, y = F.coalesce("x_pitch", F.lit(50.0)), F.coalesce("y_pitch", F.lit(50.0))
    dx, dy = (x - F.coalesce(last.x_pitch, x)) / 100 * width_m, (y - F.coalesce(last.y_pitch, y)) / 100 * length_m
    moved = F.when(last.isNotNull(), F.sqrt(dx * dx + dy * dy)).otherwise(0.0)
    events = [(zero(F.col(c).cast("double")) if c in ticks.columns else F.lit(0.0)).alias(c) for c in EVENT_FEATURES]
    return ticks.select(
        *KEYS, "event_id", "t_us", zero(F.col("speed_ms")).alias("speed_ms"), F.round(accel, 9).alias("acceleration_ms2"), zero(F.col("heart_rate_bpm").cast("double")).alias("heart_rate_bpm"), F.coalesce(F.col("speed_ms") >= 5.5, F.lit(False)).cast("double").alias("sprint_flag"),
        x.alias("x_pitch"), y.alias("y_pitch"), F.round(moved, 9).alias("distance_delta_m"), F.round(recovery, 9).alias("hr_recovery_rate"), *events,
    )


def trailing_window(ticks: DataFrame, seconds: float) -> DataFrame:
    """Sprints, mean speed and distance over the trailing time of each tick."""
    w = W.partitionBy(*KEYS).orderBy("t_us").rangeBetween(-int(seconds * 1e6), 0)
    n, s = F.count("speed_ms").over(w), F.sum("speed_ms").over(w)
    return ticks.select(*KEYS, "event_id", "t_us", F.sum((F.col("speed_ms") >= 5.5).cast("int")).over(w).cast("long").alias("sprints"), F.round(F.avg("speed_ms").over(w), 9).alias("mean_speed"), F.round(F.when(n >= 2, s * (seconds / n)).otherwise(0.0), 5).alias("distance"))


#: After so many steps an older value weighs under 1e-16 of the average (at alpha = 0.25).
MEMORY = 130


def ema(rows: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], alpha: float = 0.25, update_if: Column | None = None) -> DataFrame:
    """Exponential average S = alpha * x + (1 - alpha) * S from the first value on, held where update_if doesn't hold.

    Values fade: a row's average is the fold over the last values that count, as many as leave a trace in a double. So
    no row depends on a whole history, work is linear in the rows, and memory is that of one frame."""
    last = MEMORY if alpha == 0.25 else math.ceil(math.log(1e-17) / math.log(1 - alpha))
    held = F.coalesce(update_if, F.lit(False)) if update_if is not None else F.lit(True)
    w = W.partitionBy(*keys).orderBy(*order)
    r = rows.select(*keys, *order, F.col(value).cast("double").alias(value), (held & F.col(value).isNotNull()).alias("_on"))
    frame = W.partitionBy(*keys, "_on").orderBy(*order).rowsBetween(1 - last, 0)
    s = F.aggregate(F.collect_list(value).over(frame), F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))
    r = r.withColumn("_s", F.when(F.col("_on"), s))
    return r.select(*keys, *order, value, F.last("_s", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("ema"))


def trend_signal(rows: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], last: int = 50) -> DataFrame:
    """slope (from 4 values on), curvature (the quadratic coefficient by least squares, from 6 on), population deviation of
    the last values, per row. The index is centred, and the fit follows from sums over the frame."""
    w = W.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(1 - last, 0)
    r = rows.withColumn("_i", F.row_number().over(w).cast("double"))
    n = F.count(value).over(frame)
    slope = F.when(n >= 4, F.expr(f"regr_slope({value}, _i)").over(frame)).otherwise(0.0)
    values = F.collect_list(F.struct(F.col("_i").alias("i"), F.col(value).cast("double").alias("v"))).over(frame)
    r = r.withColumns({"_slope": slope, "_volatility": F.stddev_pop(value).over(frame), "n": n, "_vs": F.filter(values, lambda x: x.v.isNotNull())})
    total = lambda f: F.aggregate("_vs", F.lit(0.0), lambda s, x: s + f(x))
    r = r.withColumn("_mid", total(lambda x: x.i) / F.col("n"))
    power = lambda k: total(lambda x: F.pow(x.i - F.col("_mid"), k))
    r = r.withColumns({"_s2": power(2), "_s3": power(3), "_s4": power(4), "_y": total(lambda x: x.v), "_xy": total(lambda x: (x.i - F.col("_mid")) * x.v), "_xxy": total(lambda x: F.pow(x.i - F.col("_mid"), 2) * x.v)})
    # normal equations of v = a + b x + c x^2 with sum(x) = 0
    top = (F.col("_xxy") - F.col("_s2") * F.col("_y") / F.col("n")) - F.col("_s3") / F.col("_s2") * F.col("_xy")
    below = (F.col("_s4") - F.pow("_s2", 2) / F.col("n")) - F.pow("_s3", 2) / F.col("_s2")
    curvature = F.when((F.col("n") >= 6) & (below != 0), top / below).otherwise(0.0)
    return r.select(*keys, *order, F.round("_slope", 9).alias("slope"), F.round(curvature, 9).alias("curvature"), F.round("_volatility", 9).alias("volatility"), "n")


# Fixed values per metric: slopes that worsen and recover, the curvature that counts, deviations of the bands.
TREND_METRICS = {"anomaly": (0.03, -0.03, 0.01, 0.05, 0.12), "recovery": (0.005, -0.005, 0.003, 0.01, 0.03), "workload": (0.05, -0.05, 0.02, 0.15, 0.35)}


def trend_labels(signals: DataFrame, metric: str) -> DataFrame:
    """direction by the slope (for workload increasing or declining), acceleration by the curvature, and the band of the
    volatility; under four values there is no direction."""
    up, down, bend, medium, high = TREND_METRICS[metric]
    rise, fall = ("increasing", "declining") if metric == "workload" else ("worsening", "recovering")
    direction = F.when(F.col("n") < 4, "insufficient data").when(F.col("slope") > up, rise).when(F.col("slope") < down, fall).otherwise("stable")
    acceleration = F.when(F.col("curvature") > bend, "accelerating_deterioration").when(F.col("curvature") < -bend, "accelerating_recovery").otherwise("steady")
    v = F.when(F.col("n") < 4, 0.0).otherwise(F.col("volatility"))
    return signals.withColumns({"direction": direction, "acceleration": F.when(F.col("n") < 4, "steady").otherwise(acceleration), "volatility_band": F.when(v >= high, "high").when(v >= medium, "medium").otherwise("low")})
