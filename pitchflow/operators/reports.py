"""Summaries of scored windows, matches and feedback."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import quantiles
from .state import alert_states
from .walks import Walk, ordered_walk


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.round(F.avg("pred"), 9).alias("breach_rate"), F.count_distinct("player_id").alias("n_players"), F.count_distinct(F.when(F.col("pred") == 1, F.col("player_id"))).alias("n_flagged_players"))


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """figure, name, value of scored windows (player_id, raw_threshold_breach, tracker_source): how many windows, players,
    players with a calibration of their own, breaches, their rate among windows that could breach (null without one), and
    windows by tracker source."""
    breach = F.col("raw_threshold_breach").cast("int")
    own = F.count_distinct(F.when(F.col("tracker_source") == "per_player", F.col("player_id")))
    one = scored.agg(F.count("*").alias("windows"), F.count_distinct("player_id").alias("players"), own.alias("calibrated_players"), F.coalesce(F.sum(breach), F.lit(0)).alias("breaches"), F.round(F.avg(breach), 9).alias("breach_rate"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("p")
    sources = scored.groupBy("tracker_source").agg(F.count("*").cast("double").alias("value"))
    return one.select(pairs).select("p.figure", F.lit(None).cast("string").alias("name"), "p.value").unionByName(sources.select(F.lit("tracker_source").alias("figure"), F.col("tracker_source").alias("name"), "value"))


def window_report(scored: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Counts and flag rates of each dimension on its own, in one pass over grouping sets."""
    sets = scored.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    g = sets.agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.round(F.avg("pred"), 9).alias("flag_rate"), F.max("score").alias("max_score"))
    name = F.lit(None).cast("string")
    for i, d in enumerate(reversed(dims)):
        full = (1 << len(dims)) - 1
        name = F.when(F.col("_g") == full - (1 << i), d).otherwise(name)
    return g.select(name.alias("dimension"), F.coalesce(*[F.col(d).cast("string") for d in dims]).alias("value"), "n", "flag_rate", "max_score")


def occupancy_sweep(ticks: DataFrame, window_us: int, gates: tuple[int, ...]) -> DataFrame:
    """For each least number of rows: valid windows, players with any, their median and mean windows, the mean's standard
    error, and a histogram (players by windows, as text)."""
    t0 = F.min("t_us").over(W.partitionBy("match_id", "player_id"))
    per = ticks.withColumn("w", F.floor((F.col("t_us") - t0) / window_us)).groupBy("match_id", "player_id", "w").agg(F.count("*").alias("n"))
    at = per.withColumn("gate", F.explode(F.array(*map(F.lit, gates)))).filter(F.col("n") >= F.col("gate")).groupBy("gate", "player_id").agg(F.count("*").alias("windows"))
    sizes = at.groupBy("gate", "windows").agg(F.count("*").alias("players"))  # as many rows as there are different counts
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("windows", "players"))), lambda x: F.concat_ws(":", x.windows.cast("string"), x.players.cast("string"))), ",")
    bars = sizes.groupBy("gate").agg(text.alias("histogram"))
    sem = F.when(F.count("*") > 1, F.stddev_samp("windows") / F.sqrt(F.count("*")))
    got = at.groupBy("gate").agg(F.sum("windows").alias("n_windows"), F.count("*").alias("n_players"), F.round(F.median("windows"), 6).alias("median_windows"), F.round(F.avg("windows"), 6).alias("mean_windows"), F.round(sem, 6).alias("standard_error"))
    return got.join(bars, "gate")


def regime_coverage(calibration: DataFrame, least: int = 30) -> DataFrame:
    return calibration.groupBy("player_id", "regime").agg(F.count("*").alias("n")).withColumn("calibrated", F.col("n") >= least)


def example_windows(scored: DataFrame, threshold: float) -> DataFrame:
    """Per player the lowest score, the highest flagged one and the one nearest to the threshold."""
    key = lambda c: F.struct(c.alias("c"), F.col("event_id"))
    return scored.groupBy("player_id").agg(
        F.min_by("event_id", key(F.col("score"))).alias("lowest"), F.min_by("event_id", F.when(F.col("pred") == 1, key(-F.col("score")))).alias("highest_flagged"), F.min_by("event_id", key(F.abs(F.col("score") - threshold))).alias("borderline")
    )


def dominant_finding(findings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Highest severity, then confidence, then name."""
    return findings.groupBy(*keys).agg(F.max(F.struct("severity", "confidence", "finding")).alias("m")).select(*keys, F.col("m.finding").alias("finding"), F.col("m.severity").alias("severity"))


def salient_episodes(episodes: DataFrame, current: str, k: int = 3, pool: int = 20, trend: str | None = None) -> DataFrame:
    """The k most salient of each player's newest `pool` episodes (finding, trend, severity, response, end_minute): same
    finding 5, same trend 3, unresolved (persisted or unknown) 2, severity critical 4, high 2, medium 1, and the place in
    the pool from the newest on as a share of it; ties to newer ones."""
    w = W.partitionBy("player_id").orderBy(F.col("end_minute").desc(), F.col("episode").desc())
    e = episodes.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= pool).withColumn("_n", F.count("*").over(W.partitionBy("player_id")))
    yes = lambda c, n: F.when(c, n).otherwise(0)
    severity = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    score = yes(F.col("finding") == current, 5) + yes(F.col("trend") == trend, 3) + yes(F.col("response").isin("persisted", "unknown"), 2) + severity + F.col("rn") / F.col("_n")
    e = e.withColumn("salience", F.round(score, 6))
    top = F.row_number().over(W.partitionBy("player_id").orderBy(F.col("salience").desc(), "rn"))
    return e.withColumn("rank", top).filter(F.col("rank") <= k).select("player_id", "rank", "episode", "finding", "salience")


def episode_patterns(episodes: DataFrame, least: int = 2, top: int = 4) -> DataFrame:
    """The `top` finding types of `least` or more episodes of a player, and the `top` that follow one another so often."""
    w = W.partitionBy("player_id").orderBy("episode")
    e = episodes.withColumn("next", F.lead("finding").over(w))
    recurring = e.groupBy("player_id", F.lit("recurring").alias("kind"), F.col("finding").alias("pattern")).agg(F.count("*").alias("n"))
    pairs = e.filter("next IS NOT NULL").groupBy("player_id", F.lit("transition").alias("kind"), F.concat_ws(">", "finding", "next").alias("pattern")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("player_id", "kind").orderBy(F.col("n").desc(), "pattern"))
    return recurring.unionByName(pairs).filter(F.col("n") >= least).withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def context_summary(episodes: DataFrame, patterns: DataFrame, salient: DataFrame, last: int = 3) -> DataFrame:
    """One row a player: how its episodes went on (findings in order, repeats once), the last of them in words, what
    recurs and what follows what, the salient ones, and the active pattern. A player's episodes are few; of long histories
    the newest 50 are told."""
    rn = F.row_number().over(W.partitionBy("player_id").orderBy(F.col("episode").desc()))
    e = episodes.withColumn("_rn", rn).filter("_rn <= 50")
    in_order = F.array_sort(F.collect_list(F.struct("episode", "finding")))
    steps = F.transform(in_order, lambda x: x.finding)
    once = F.filter(steps, lambda f, i: (i == 0) | (f != F.get(steps, i - 1)))
    words = F.format_string("%s (severity %d, minutes %d-%d)", F.col("finding"), F.col("severity"), F.col("start_minute"), F.col("end_minute"))
    newest = F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= last, F.struct("episode", words.alias("t"))))), lambda x: x.t)
    g = e.groupBy("player_id").agg(F.array_join(once, " -> ").alias("trajectory"), F.array_join(newest, "; ").alias("recent"), F.max_by("finding", "episode").alias("active_pattern"), F.count("*").alias("n_episodes"))
    named = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("pattern")))), ",")
    p = patterns.groupBy("player_id").agg(named("recurring").alias("recurring"), named("transition").alias("transitions"))
    r = salient.groupBy("player_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "finding"))), lambda x: x.finding), ",").alias("relevant"))
    out = g.join(p, "player_id", "left").join(r, "player_id", "left")
    return out.select("player_id", "n_episodes", "trajectory", "recent", *[F.coalesce(c, F.lit("")).alias(c) for c in ("recurring", "transitions", "relevant")], "active_pattern")


def persistence_sweep(signals: DataFrame, values: tuple[int, ...]) -> DataFrame:
    """For each least persistence: windows in a raised state of the alert machine, alerts (episodes) and players with any.
    signals: player_id, t_us, event_id, active, confidence."""
    parts = []
    for v in values:
        s = alert_states(signals, ("player_id",), ("t_us", "event_id"), warn=v)
        raised = s.filter(F.col("state").isin("WARNING", "CRITICAL"))
        per = raised.groupBy("player_id").agg(F.count("*").alias("n"), F.count_distinct("episode").alias("e"))
        parts.append(per.agg(F.lit(v).alias("min_persistence"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_windows"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_alerts"), F.count("*").alias("n_players")))
    return reduce(DataFrame.union, parts)


def aggregate_metrics(per_player: DataFrame) -> DataFrame:
    """Macro means over players (absent values left out) and micro figures from summed counts."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return per_player.agg(F.round(F.avg(p), 9).alias("macro_precision"), F.round(F.avg(r), 9).alias("macro_recall"), F.round(tp / (tp + fp), 9).alias("micro_precision"), F.round(tp / (tp + fn), 9).alias("micro_recall"))


def override_summary(overrides: DataFrame, since_us: int | None = None, player_id: int | None = None, kind: str | None = None) -> DataFrame:
    """Override rate of each recommendation type, of the rows that pass the filters."""
    o = overrides
    for c, v, test in (("t_us", since_us, "__ge__"), ("player_id", player_id, "__eq__"), ("recommendation_type", kind, "__eq__")):
        if v is not None:
            o = o.filter(getattr(F.col(c), test)(F.lit(v)))
    return o.groupBy("recommendation_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("decision") == "override").cast("int")), 9).alias("override_rate"))


def match_metadata(events: DataFrame, positions: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """Events, players, teams and times per match of the events; with positions (match_id) also how many there are, with
    statistics (match_id, date) the first date of the match, null without one."""
    m = events.groupBy("match_id").agg(F.count("*").alias("n_events"), F.count_distinct("player_id").alias("n_players"), F.array_join(F.array_sort(F.collect_set("team_id")), " vs. ").alias("teams"), F.min("t_us").alias("begin_us"), F.max("t_us").alias("end_us"))
    if positions is not None:
        m = m.join(positions.groupBy("match_id").agg(F.count("*").alias("n_positions")), "match_id", "left").fillna(0, ["n_positions"])
    if statistics is not None:
        m = m.join(statistics.groupBy("match_id").agg(F.min("date").alias("date")), "match_id", "left")
    return m


def validate_match(events: DataFrame, roster: DataFrame) -> DataFrame:
    """Warnings per match: events of players outside the roster, events without a team."""
    known = roster.select("player_id", F.lit(True).alias("_k")).distinct()
    e = events.join(known, "player_id", "left")
    return e.groupBy("match_id").agg(F.count_if(F.col("_k").isNull()).alias("not_in_roster"), F.count_if(F.col("team_id").isNull()).alias("without_team"), F.count("*").alias("n"))


def quality_report(ticks: DataFrame) -> DataFrame:
    """One row: lag-1 autocorrelation of speed, mean and 99th percentile of absolute acceleration and of its change from
    tick to tick, shares of missing heart rates and of sprints, of ticks out of order, of standing still, mean and
    deviation of speed, mean and deviation of the time between ticks."""
    w = W.partitionBy("match_id", "player_id").orderBy("t_us", "event_id")
    arrival = W.partitionBy("match_id", "player_id").orderBy("event_id")
    t = ticks.withColumns({"_l": F.lag("speed_ms").over(w), "_jerk": F.abs(F.col("acceleration_ms2") - F.lag("acceleration_ms2").over(w)), "_dt": (F.col("t_us") - F.lag("t_us").over(w)) / 1e6, "_late": (F.col("t_us") < F.lag("t_us").over(arrival)).cast("int"), "_a": F.abs("acceleration_ms2")})
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("int"), F.lit(0))), 9)
    one = t.agg(
        F.round(F.corr("speed_ms", "_l"), 6).alias("autocorrelation"), F.round(F.avg("_a"), 9).alias("mean_accel"), F.round(F.avg("_jerk"), 9).alias("mean_jerk"), share(F.col("heart_rate_bpm").isNull()).alias("missing_hr"), share(F.col("speed_ms") >= 5.5).alias("sprint_share"),
        share(F.col("_late")).alias("late_share"), share(F.col("speed_ms") < 0.5).alias("still_share"), F.round(F.avg("speed_ms"), 9).alias("mean_speed"), F.round(F.stddev_pop("speed_ms"), 6).alias("speed_spread"), F.round(F.avg("_dt"), 3).alias("mean_dt"), F.round(F.stddev_pop("_dt"), 3).alias("dt_spread"),
    )
    return one.crossJoin(F.broadcast(quantiles(t, "_a", (0.99,)).select(F.round(F.col("q")[0], 9).alias("p99_accel"))))  # one row each


def quality_details(ticks: DataFrame, roster: DataFrame, sessions: DataFrame, most_lag: int = 5, high_ms: float = 5.5, walk_ms: float = 2.0) -> DataFrame:
    """figure, name, value: what a quality report has beyond quality_report().

    x_mean and x_spread (sample deviation) by position, of positions with more than 10 places; speed_share over high_ms and
    under walk_ms; sprint_fano, the variance by the mean of the lengths of a player's sprints in ticks (over 1.2 they
    cluster); phase_share of each phase; hr_lag, the correlation of speed with the heart rate so many ticks later, and
    best_hr_lag, the lag of the highest; xg mean and max of matches; dropout, the share of ticks without a speed.

    ticks: match_id, player_id, t_us, event_id, speed_ms, heart_rate_bpm, x_pitch, phase. roster: player_id, position.
    sessions: is_match, xg. Sprints are islands and all lags leads of one window, so ticks are sorted once for either;
    every figure is an aggregate that is combined before it is shuffled."""
    w = W.partitionBy("match_id", "player_id").orderBy("t_us", "event_id")
    row = lambda df, figure, name, value: df.select(F.lit(figure).alias("figure"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    placed = ticks.filter("x_pitch IS NOT NULL").join(roster.dropDuplicates(["player_id"]), "player_id").groupBy("position").agg(F.avg("x_pitch").alias("m"), F.stddev_samp("x_pitch").alias("s"), F.count("*").alias("n")).filter("n > 10")
    out = [row(placed, "x_mean", F.col("position"), F.round("m", 6)), row(placed, "x_spread", F.col("position"), F.round("s", 6))]
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    known = ticks.filter("speed_ms IS NOT NULL").agg(share(F.col("speed_ms") > high_ms).alias("high"), share(F.col("speed_ms") < walk_ms).alias("walk"))
    out += [row(known, "speed_share", F.lit(n), F.col(n)) for n in ("high", "walk")]
    sprint = F.coalesce(F.col("speed_ms") >= high_ms, F.lit(False))
    runs = ticks.withColumn("_s", sprint).withColumn("_before", F.sum((~F.col("_s")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_s").groupBy("match_id", "player_id", "_before").agg(F.count("*").alias("n"))
    fano = runs.agg(F.round(F.var_pop("n") / F.greatest(F.avg("n"), F.lit(1e-6)), 6).alias("v")).filter("v IS NOT NULL")
    out.append(row(fano, "sprint_fano", F.lit(None), F.col("v")))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    phases = ticks.groupBy("phase").agg(F.count("*").alias("n")).withColumn("v", F.round(F.col("n") / total, 9))  # a row a phase
    out.append(row(phases.filter("phase IS NOT NULL"), "phase_share", F.col("phase"), F.col("v")))
    both = ticks.filter("speed_ms IS NOT NULL AND heart_rate_bpm IS NOT NULL").select("speed_ms", *[F.lead("heart_rate_bpm", k).over(w).alias(f"h{k}") for k in range(1, most_lag + 1)])
    lags = both.agg(*[F.round(F.corr("speed_ms", f"h{k}"), 6).alias(f"c{k}") for k in range(1, most_lag + 1)])
    pairs = F.array(*[F.struct((-F.coalesce(f"c{k}", F.lit(-2.0))).alias("minus"), F.lit(k).alias("k")) for k in range(1, most_lag + 1)])
    out += [row(lags, "hr_lag", F.lit(k), F.col(f"c{k}")) for k in range(1, most_lag + 1)] + [row(lags, "best_hr_lag", F.lit(None), F.array_min(pairs)["k"])]
    xg = sessions.filter("is_match AND xg IS NOT NULL").agg(F.round(F.avg("xg"), 6).alias("mean"), F.max("xg").alias("max"))
    out += [row(xg.filter(F.col(n).isNotNull()), "xg", F.lit(n), F.col(n)) for n in ("mean", "max")]
    out.append(row(ticks.agg(share(F.col("speed_ms").isNull()).alias("v")), "dropout", F.lit(None), F.col("v")))
    return reduce(DataFrame.unionByName, out)


class _Hull(Walk):
    def __init__(self):
        self.n, self.points = 0, set()

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        there = rows.dropna(subset=["x_pitch", "y_pitch"])
        self.n += len(there)
        self.points.update(zip(there["x_pitch"].tolist(), there["y_pitch"].tolist(), strict=True))
        return []

    def end(self) -> list[tuple]:
        area = hull_area(self.points)
        return [(self.n, round(area, 6))] if self.n >= 4 and area > 0 else []


def hull_area(points: set[tuple[float, float]]) -> float:
    """Area of the smallest convex polygon around the points; 0 for points on a line."""
    if len(points) < 3:
        return 0.0
    ordered = sorted(points)
    chain: list[tuple[float, float]] = []
    for way in (ordered, ordered[::-1]):  # the lower side from left to right, then the upper one back
        start = len(chain)
        for p in way:
            while len(chain) - start >= 2 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chain.pop()
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(chain, chain[1:] + chain[:1], strict=True))) / 2


def team_hulls(ticks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n_players, area: how compact a team stands at a tick. keys: what the rows of a tick of a team share. Ticks of
    fewer than 4 places, and places on a line, have no row. A tick's few places are walked, sorted by the keys."""
    return ordered_walk(ticks.select(*keys, "x_pitch", "y_pitch"), keys, ("x_pitch",), _Hull, "n_players bigint, area double")
