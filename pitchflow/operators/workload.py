"""Workload, baselines and cross-match trends per player."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import quantiles


def workload_windows(buckets: DataFrame, high_intensity: float = 4.17) -> DataFrame:
    """buckets with their loads; needs n_accel, mean_accel, n_decel, mean_decel, sprint_distance, distance, max_speed."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    accel, decel = zero("n_accel") * zero("mean_accel"), zero("n_decel") * F.abs(zero("mean_decel"))
    return buckets.withColumns({
        "acceleration_load": F.round(accel, 6), "deceleration_load": F.round(decel, 6), "current_load": F.round(accel + decel, 6), "sprint_load": zero("sprint_distance"),
        "high_intensity_load": F.when(zero("max_speed") >= high_intensity, zero("distance")).otherwise(0.0), "distance_covered": zero("distance"),
    })


def figure(c: str) -> Column:
    """A mean at nine decimals, then half up to six, so that the last bits of a double decide nothing."""
    return F.round(F.round(c, 9), 6).alias(c)


def half_split_trend(rows: DataFrame, value: str, keys: tuple[str, ...], order: tuple[str, ...], band: float = 0.05) -> DataFrame:
    """trend of each row's prefix: the mean of its first half against that of the rest. Prefix sums give both: row n's
    half is the running sum at row floor(n / 2), joined by row number, so the work is linear. The change is taken at nine
    decimals: one of exactly the band is stable, in whatever order a sum's last bits came about."""
    w = W.partitionBy(*keys).orderBy(*order)
    p = rows.select(*keys, *order, F.row_number().over(w).alias("rn"), F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"))
    half = p.select(*keys, F.col("rn").alias("h"), F.col("total").alias("half_total"))
    j = p.withColumn("h", F.floor(F.col("rn") / 2).cast("int")).join(half, [*keys, "h"], "left")
    first, rest = F.col("half_total") / F.col("h"), (F.col("total") - F.col("half_total")) / (F.col("rn") - F.col("h"))
    change = F.round((rest - first) / F.abs(first), 9)
    trend = F.when(F.col("rn") < 2, "stable").when(first == 0, F.when(rest > 0, "increasing").otherwise("stable")).when(change > band, "increasing").when(change < -band, "decreasing").otherwise("stable")
    return j.select(*keys, *order, trend.alias("trend"))


def workload_status(rows: DataFrame, load: str, key: str) -> DataFrame:
    """low, normal or high by the 33rd and 66th percentile of all loads of the same key."""
    cut = rows.groupBy(key).agg(F.percentile(load, F.array(F.lit(0.33), F.lit(0.66))).alias("cut"))
    status = F.when(F.col(load) <= F.col("cut")[0], "low").when(F.col(load) >= F.col("cut")[1], "high").otherwise("normal")
    return rows.join(cut, key).withColumn("status", status).drop("cut")


def rolling_metrics(rows: DataFrame, metrics: tuple[str, ...], player: str = "player_id", order: str = "match_id", band: float = 0.05) -> DataFrame:
    """Per player and metric: last value, means of the last 5, 7 and 10 matches and of all, and the trend of the last 5
    against all, by a change at nine decimals."""
    long = rows.unpivot([player, order], list(metrics), "metric", "value")
    rn = F.row_number().over(W.partitionBy(player, "metric").orderBy(F.col(order).desc()))
    r = long.withColumn("rn", rn)
    mean = lambda n: F.avg(F.when(F.col("rn") <= n, F.col("value")))
    out = r.groupBy(player, "metric").agg(F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("last"), mean(5).alias("mean5"), mean(7).alias("mean7"), mean(10).alias("mean10"), F.avg("value").alias("season"), F.count("*").alias("n"))
    change = F.round((F.col("mean5") - F.col("season")) / F.abs("season"), 9)
    trend = F.when(F.col("season") == 0, F.when(F.col("mean5") == 0, "stable").otherwise("improving")).when(change > band, "improving").when(change < -band, "declining").otherwise("stable")
    return out.withColumn("trend", trend)


def acwr_matches(loads: DataFrame, player: str = "player_id", order: str = "match_id") -> DataFrame:
    """Load of the last match over the mean of the last four; null without any."""
    r = loads.withColumn("load", F.col("acceleration_load") + F.col("deceleration_load")).withColumn("rn", F.row_number().over(W.partitionBy(player).orderBy(F.col(order).desc())))
    a = r.filter("rn <= 4").groupBy(player).agg(F.max(F.when(F.col("rn") == 1, F.col("load"))).alias("acute"), F.avg("load").alias("chronic"))
    return a.withColumn("acwr", F.when(F.col("chronic") != 0, F.col("acute") / F.col("chronic")))


def acwr_daily(sessions: DataFrame, as_of: str, acute_days: int = 7, chronic_days: int = 28) -> DataFrame:
    """Mean distance of the last 7 days over that of the last 28; an empty window falls back to the player's last
    session. Ratio 1 where the chronic mean is 0; above 1.5 high risk, below 0.8 low readiness."""
    day = F.lit(as_of).cast("date")
    age = F.datediff(day, F.col("started_on"))
    s = sessions.filter(age >= 0).withColumn("age", age)
    within = lambda n: F.avg(F.when(F.col("age") < n, F.col("total_distance_m")))
    last = F.max_by("total_distance_m", F.struct((-F.col("age")).alias("minus"), "session_id"))
    g = s.groupBy("player_id").agg(within(acute_days).alias("a"), within(chronic_days).alias("c"), last.alias("last"))
    acute, chronic = F.coalesce("a", "last"), F.coalesce("c", "last")
    ratio = F.when(chronic == 0, 1.0).otherwise(acute / chronic)
    return g.select("player_id", F.round(acute, 7).alias("acute"), F.round(chronic, 7).alias("chronic"), F.round(ratio, 6).alias("acwr"), F.when(ratio > 1.5, "high_risk").when(ratio < 0.8, "low_readiness").otherwise("optimal").alias("flag"))


def historical_baseline(sessions: DataFrame, metrics: tuple[str, ...], least: int = 5) -> DataFrame:
    """Mean and sample deviation of each metric for players with enough sessions; a deviation of 0 or none is 1."""
    aggs = [x for m in metrics for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.when(F.count(m) > 1, F.stddev_samp(m)).otherwise(1.0), 6).alias(f"{m}_std"))]
    return sessions.groupBy("player_id").agg(F.count("*").alias("n_sessions"), *aggs).filter(F.col("n_sessions") >= least)


def provisional_baseline(ticks: DataFrame, window_us: int = 120_000_000, least_rows: int = 6, least_windows: int = 5, max_dt_s: float = 5.0) -> DataFrame:
    """Mean and population deviation over a player's windows within a match of distance = sum of speed times the time to
    the next tick (at most max_dt_s)."""
    t0 = F.min("t_us").over(W.partitionBy("match_id", "player_id"))
    b = ticks.withColumn("window", F.floor((F.col("t_us") - t0) / window_us))
    w = W.partitionBy("match_id", "player_id", "window").orderBy("t_us", "event_id")
    dt = F.least(F.lit(max_dt_s), F.greatest(F.lit(0.0), (F.lead("t_us").over(w) - F.col("t_us")) / 1e6))
    per = b.withColumn("d", F.when(F.lead("t_us").over(w).isNotNull(), F.col("speed_ms") * dt)).groupBy("match_id", "player_id", "window").agg(F.sum("d").alias("distance"), F.max("speed_ms").alias("top"), F.count("*").alias("n"))
    out = per.filter(F.col("n") >= least_rows).groupBy("player_id").agg(F.count("*").alias("n_windows"), F.round(F.avg("distance"), 6).alias("distance_mean"), F.round(F.stddev_pop("distance"), 6).alias("distance_std"), F.round(F.avg("top"), 6).alias("top_mean"))
    return out.filter(F.col("n_windows") >= least_windows)


def baseline_with_fallback(historical: DataFrame, provisional: DataFrame) -> DataFrame:
    """Historical baselines, and provisional ones of players without."""
    rest = provisional.join(historical.select("player_id"), "player_id", "left_anti").withColumn("basis", F.lit("provisional"))
    return historical.withColumn("basis", F.lit("historical")).unionByName(rest, allowMissingColumns=True)


def positional_norms(ticks: DataFrame, least: int = 10) -> DataFrame:
    """Mean position and sample deviation of the distance from it."""
    has = ticks.filter("x_pitch IS NOT NULL AND y_pitch IS NOT NULL")
    c = has.groupBy("player_id").agg(F.avg("x_pitch").alias("cx"), F.avg("y_pitch").alias("cy"), F.count("*").alias("n")).filter(F.col("n") >= least)
    d = F.sqrt(F.pow(F.col("x_pitch") - F.col("cx"), 2) + F.pow(F.col("y_pitch") - F.col("cy"), 2))
    return has.join(c, "player_id").groupBy("player_id").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.stddev_samp(d).alias("spread"), F.count("*").alias("n"))


def positional_drift(ticks: DataFrame, norms: DataFrame, last: int = 60, flag: float = 0.3) -> DataFrame:
    """Mean distance of the last positions from the player's norm over twice its spread (5 at least), and the share
    outside."""
    j = ticks.filter("x_pitch IS NOT NULL AND y_pitch IS NOT NULL").join(norms, "player_id")
    d = F.sqrt(F.pow(F.col("x_pitch") - F.col("cx"), 2) + F.pow(F.col("y_pitch") - F.col("cy"), 2))
    limit = F.greatest(2 * F.col("spread"), F.lit(5.0))
    frame = W.partitionBy("player_id").orderBy("t_us", "event_id").rowsBetween(1 - last, 0)
    outside = F.avg((d > limit).cast("int")).over(frame)
    return j.select("player_id", "event_id", F.round(F.avg(d).over(frame) / limit, 6).alias("drift"), F.round(outside, 6).alias("outside"), (outside >= flag).alias("flagged"))


def fatigue_curve(ticks: DataFrame, segment_us: int, least_rows: int = 30, least_segments: int = 4, max_dt_s: float = 5.0) -> DataFrame:
    """Least squares of distance by segment within each session, then medians of slope, intercept and fit."""
    t0 = F.min("t_us").over(W.partitionBy("match_id", "player_id"))
    b = ticks.withColumn("segment", F.floor((F.col("t_us") - t0) / segment_us).cast("double"))
    w = W.partitionBy("match_id", "player_id", "segment").orderBy("t_us", "event_id")
    dt = F.least(F.lit(max_dt_s), (F.lead("t_us").over(w) - F.col("t_us")) / 1e6)
    seg = b.withColumn("d", F.col("speed_ms") * dt).groupBy("match_id", "player_id", "segment").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"), F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    fit = seg.groupBy("match_id", "player_id").agg(F.regr_slope("d", "segment").alias("slope"), F.regr_intercept("d", "segment").alias("intercept"), F.regr_r2("d", "segment").alias("r2"), F.count("*").alias("n")).filter(F.col("n") >= least_segments)
    return fit.groupBy("player_id").agg(F.round(F.median("slope"), 6).alias("slope"), F.round(F.median("intercept"), 6).alias("intercept"), F.round(F.median("r2"), 6).alias("r2"), F.count("*").alias("n_sessions"))


def session_features(buckets: DataFrame, dx: float = 15.0) -> DataFrame:
    """Trapezoid integral of mean speed over buckets, mean speed and sprint buckets of a session."""
    nxt = F.lead("mean_speed").over(W.partitionBy("match_id", "player_id").orderBy("bucket"))
    b = buckets.withColumn("_area", (F.col("mean_speed") + nxt) / 2 * dx)
    return b.groupBy("match_id", "player_id").agg(F.round(F.coalesce(F.sum("_area"), F.lit(0.0)), 6).alias("distance"), F.round(F.avg("mean_speed"), 9).alias("mean_speed"), F.count_if("any_sprint").alias("sprints"), F.round(F.avg("mean_hr"), 9).alias("mean_hr"))


def dedupe_player_match(stats: DataFrame, sums: tuple[str, ...], firsts: tuple[str, ...]) -> DataFrame:
    """One row per (match, player): the full session's, else its halves added up with their first attributes. Of several
    full sessions the first in order of description, begin (begin_us, where the table has it) and figures counts, missing
    ones first; an attribute is that of the first half that has it, by description, then begin, then the attribute itself."""
    full = F.col("description").contains(" vs. ")
    keys, begin = ["match_id", "player_id"], [c for c in ("begin_us",) if c in stats.columns]
    order = [F.col(c).asc_nulls_first() for c in ("description", *begin, *sums, *firsts)]
    whole = stats.filter(full).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n").select(*keys, *sums, *firsts)
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & F.col("description").isNotNull(), F.struct("description", *begin, F.col(c).alias("value"))))["value"]
    halves = stats.filter(~F.coalesce(full, F.lit(False))).join(whole.select(*keys), keys, "left_anti").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[first(c).alias(c) for c in firsts])
    return whole.unionByName(halves)


def distribution(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """min, quartiles, 90th percentile, max and mean of columns, exact."""
    parts = []
    for c in columns:
        a = df.agg(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.round(F.avg(c), 9).alias("mean"))
        a = a.crossJoin(F.broadcast(quantiles(df, c, (0.25, 0.5, 0.75, 0.9))))  # one row each
        parts.append(a.select(F.lit(c).alias("column"), "min", *[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("p25", "median", "p75", "p90"))], "max", "mean"))
    return reduce(DataFrame.union, parts)
