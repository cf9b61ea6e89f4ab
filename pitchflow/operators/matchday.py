"""Rosters, metrics, loads, timelines and trends over matches, and rows for publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workload import dedupe_player_match, figure, half_split_trend, rolling_metrics, workload_status

# Minutes of a match's segments, the loads of a window, what is summed over a session's halves.
SEGMENTS = ((0, 15), (15, 30), (30, 45), (45, 60), (60, 75), (75, 90))
LOADS = ("acceleration_load", "deceleration_load", "sprint_load", "high_intensity_load", "distance_covered")
TOTALS = ("distance_m", "sprints", "accelerations", "decelerations", "distance_high_m", "distance_very_high_m")


def canonical_team(team: Column, aliases: dict[str, str]) -> Column:
    """The team's usual id; unknown ones and null stay."""
    if not aliases:
        return team
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), team), team)


def first_per_match(matches: DataFrame, order: str) -> DataFrame:
    """One row a match id, the first in order."""
    rows = [c for c in matches.columns if c != "match_id"]
    return matches.groupBy("match_id").agg(F.min_by(F.struct(*rows), order).alias("r")).select("match_id", "r.*").select(matches.columns)


def newest_match(matches: DataFrame) -> DataFrame:
    """The match of the latest date, ties to the larger id; dates that don't parse come last. A maximum, not a sort."""
    key = F.struct(F.expr("try_cast(date AS date)").alias("d"), "match_id")
    return matches.agg(F.max_by(F.struct(*matches.columns), key).alias("r")).filter("r IS NOT NULL").select("r.*")


def match_roster(stats: DataFrame) -> DataFrame:
    """Position, team, time on the field and ownership of each player in each match."""
    s = dedupe_player_match(stats.filter("player_id IS NOT NULL"), ("time_on_field_s",), ("position", "team", "ownership"))
    return s.select("match_id", "player_id", "position", "team", "time_on_field_s", "ownership")


def player_match_loads(windows: DataFrame) -> DataFrame:
    """Sums of each player's window loads in a match."""
    return windows.groupBy("match_id", "player_id").agg(*[F.round(F.sum(c), 6).alias(c) for c in LOADS])


def metrics_with_loads(metrics: DataFrame, loads: DataFrame) -> DataFrame:
    """Loads onto the metrics of the same match and player; players without loads keep nulls, loads without metrics go."""
    return metrics.join(loads.select("match_id", "player_id", *LOADS), ["match_id", "player_id"], "left")


def high_intensity(high: str = "distance_high_m", very_high: str = "distance_very_high_m") -> Column:
    return F.coalesce(F.col(high), F.lit(0.0)) + F.coalesce(F.col(very_high), F.lit(0.0))


def player_match_metrics(stats: DataFrame, loads: DataFrame) -> DataFrame:
    """One row a player and match: distance, sprints, accelerations, decelerations, distance at high and very high speed
    together, and the loads where there are any."""
    s = dedupe_player_match(stats.filter("player_id IS NOT NULL"), TOTALS, ("ownership",))
    m = s.select("match_id", "player_id", "ownership", "distance_m", "sprints", "accelerations", "decelerations", F.round(high_intensity(), 6).alias("high_intensity_actions"))
    return metrics_with_loads(m, loads)


def match_timeline(windows: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Per match and quarter of an hour (also those without data): the loads' totals, how many players have data, and the
    three players with the largest sum over 0 of each load. windows: match_id, player_id, elapsed_s and LOADS; only
    players (player_id) count if given. A group for the leaders is a match's roster."""
    w = windows if players is None else windows.join(players.select("player_id").distinct(), "player_id", "left_semi")
    minute = F.col("elapsed_s") / 60
    segment = F.coalesce(*[F.when((minute >= a) & (minute < b), F.lit(f"{a}-{b}")) for a, b in SEGMENTS])
    per = w.withColumn("segment", segment).filter("segment IS NOT NULL").groupBy("match_id", "segment", "player_id").agg(*[F.sum(c).alias(c) for c in LOADS])
    best = lambda c: F.slice(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct((-F.round(c, 6)).alias("minus"), "player_id")))), 1, 3)
    said = lambda c: F.concat(F.lit(f"{c}:"), F.array_join(F.transform(best(c), lambda x: x.player_id.cast("string")), ","))
    got = per.groupBy("match_id", "segment").agg(*[F.round(F.sum(c), 4).alias(c) for c in LOADS], F.count("*").alias("n_players"), F.concat_ws(";", *[said(c) for c in LOADS]).alias("leaders"))
    grid = windows.select("match_id").distinct().withColumn("segment", F.explode(F.array(*[F.lit(f"{a}-{b}") for a, b in SEGMENTS])))
    none = F.lit(";".join(f"{c}:" for c in LOADS))
    return grid.join(got, ["match_id", "segment"], "left").select("match_id", "segment", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in LOADS], F.coalesce("n_players", F.lit(0)).alias("n_players"), F.coalesce("leaders", none).alias("leaders"))


def workload_events(windows: DataFrame, roster: DataFrame) -> DataFrame:
    """Windows of the own team's players as they are published: loads, trends of load and speed up to the window, status
    within the match, name and position. The roster restricts first, so percentiles are those of the own team."""
    own = roster.filter("ownership = 'OWN'").select("player_id", F.col("name").alias("player_name"), F.coalesce("position", F.lit("unknown")).alias("position"))
    w = windows.join(own, "player_id")
    keys, order = ("match_id", "player_id"), ("bucket",)
    load = half_split_trend(w, "current_load", keys, order).withColumnRenamed("trend", "load_trend")
    speed = half_split_trend(w, "mean_speed", keys, order).withColumnRenamed("trend", "performance_trend")
    s = workload_status(w, "current_load", "match_id").withColumnRenamed("status", "workload_status")
    out = s.join(load, [*keys, *order]).join(speed, [*keys, *order])
    return out.select(F.lit("1").alias("schema_version"), *keys, "player_name", "position", *order, "elapsed_s", "current_load", "load_trend", *LOADS, "performance_trend", "workload_status")


def player_trends(stats: DataFrame) -> DataFrame:
    """Rolling figures of the own team's players over their matches, in order of the session's begin where the table has
    one, else of the match id."""
    own = stats.filter("ownership = 'OWN' AND player_id IS NOT NULL").withColumn("high_intensity_actions", high_intensity())
    order = "begin_us" if "begin_us" in stats.columns else "match_id"
    metrics = ("distance_m", "sprints", "accelerations", "decelerations", "high_intensity_actions")
    r = rolling_metrics(own.fillna(0, list(metrics)).withColumn("_order", F.struct(F.col(order).alias("o"), "match_id", "description")), metrics, order="_order")
    return r.select("player_id", "metric", *[figure(c) for c in ("last", "mean5", "mean7", "mean10", "season")], F.col("n").alias("n_matches"), "trend")


def load_trends(loads: DataFrame, matches: DataFrame) -> DataFrame:
    """Rolling figures of each player's loads over matches, and acute over chronic load. Matches are in order of their
    dates if all of them parse, else of their ids; undated matches are left out only in the former case."""
    dated = matches.select(F.col("match_id").cast("string").alias("_m"), F.expr("try_cast(date AS date)").alias("_d"))
    all_dated = dated.agg(F.coalesce(F.bool_and(F.col("_d").isNotNull()), F.lit(False)).alias("_by_date"))
    m = dated.groupBy("_m").agg(F.max("_d").alias("_d"))
    r = loads.withColumn("_m", F.col("match_id").cast("string")).join(m, "_m", "left").crossJoin(F.broadcast(all_dated))  # one row
    r = r.filter("NOT _by_date OR _d IS NOT NULL").withColumn("_order", F.struct(F.when(F.col("_by_date"), F.col("_d")).alias("d"), F.col("_m").alias("m")))
    r = r.fillna(0.0, list(LOADS))
    rolled = rolling_metrics(r, LOADS, order="_order")
    load = F.col("acceleration_load") + F.col("deceleration_load")
    recent = r.withColumn("_l", load).withColumn("_rn", F.row_number().over(W.partitionBy("player_id").orderBy(F.col("_order").desc())))
    a = recent.groupBy("player_id").agg(F.max(F.when(F.col("_rn") == 1, F.col("_l"))).alias("acute"), F.avg(F.when(F.col("_rn") <= 4, F.col("_l"))).alias("chronic"))
    ratio = F.when(F.col("chronic") != 0, F.round(F.col("acute") / F.col("chronic"), 6))
    a = a.select("player_id", F.round("acute", 6).alias("acute_load"), F.round("chronic", 6).alias("chronic_load"), ratio.alias("acwr"))
    return rolled.select("player_id", "metric", *[figure(c) for c in ("last", "mean5", "mean7", "mean10", "season")], F.col("n").alias("n_matches"), "trend").join(a, "player_id")


def label_windows(windows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Windows with their session's label; false where there is none."""
    known = labels.groupBy(key).agg(F.bool_or("label").alias("label"))
    return windows.join(known, key, "left").withColumn("label", F.coalesce("label", F.lit(False)))


def window_stats(ticks: DataFrame, baselines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distance, mean speed and sprint ticks of each window, and how far they lie from the player's baseline in its
    deviations: 0 where the baseline or its deviation lacks. keys hold player_id."""
    w = ticks.groupBy(*keys).agg(F.sum(F.coalesce("distance_delta", F.lit(0.0))).alias("distance"), F.avg("speed_ms").alias("mean_speed"), F.count_if(F.col("speed_ms") >= 5.5).alias("sprints"))
    j = w.join(baselines, "player_id", "left")
    z = lambda c: F.round(F.when((F.col(f"{c}_std") != 0) & F.col(c).isNotNull(), (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(0.0), 6).alias(f"z_{c}")
    return j.select(*keys, F.round("distance", 6).alias("distance"), F.round("mean_speed", 9).alias("mean_speed"), "sprints", z("distance"), z("mean_speed"), z("sprints"))


def to_event_rows(ticks: DataFrame, source: str = "tracking") -> DataFrame:
    """Ticks in the form of observations: an external id, an ISO time, one name a measure, and what is missing null."""
    return ticks.select(
        F.format_string("p%03d", F.col("player_id")).alias("player_external_id"), F.date_format(F.timestamp_micros(F.col("t_us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("match_id").cast("string").alias("match_id"), F.lit(source).alias("source"),
        "speed_ms", F.col("acceleration_ms2").alias("acceleration"), F.col("heart_rate_bpm").cast("int").alias("heart_rate_bpm"), "x_pitch", "y_pitch", F.coalesce(F.col("speed_ms") >= 5.5, F.lit(False)).alias("is_sprint"),
    )


def template_summary(findings: DataFrame) -> DataFrame:
    """A sentence or two on a window from its first finding, when no other text is to be had."""
    sure = F.when(F.col("confidence") >= 0.85, "clear").when(F.col("confidence") >= 0.7, "likely").otherwise("possible")
    lasting = F.when(F.col("trend") == "persistent", " It has lasted for several windows.").otherwise("")
    text = F.concat(F.initcap(sure), F.lit(" "), F.replace(F.col("finding"), F.lit("_"), F.lit(" ")), F.format_string(" (%s severity, confidence %d %%).", F.col("severity"), F.floor(F.col("confidence") * 100 + 0.5).cast("int")), lasting)
    return findings.filter("rank = 1").select(*[c for c in ("match_id", "player_id", "bucket") if c in findings.columns], text.alias("summary"))


# Sentences of a summary.
ACTIONS = {"substitution": "Consider substituting ", "fatigue_alert": "Fatigue alert for ", "positional_drift": "Positional drift detected for ", "workload_warning": "Workload warning for "}
OTHER_ACTION = "Performance anomaly — "
LOAD_SENTENCES = {"high_risk": "Acute workload significantly exceeds chronic baseline — elevated injury risk. ", "low_readiness": "Recent load is below chronic baseline — reduced physical readiness. "}
CLOSING = "Analysis is based on this player's own historical data, not squad averages."


def alert_summary(alerts: DataFrame) -> DataFrame:
    """alerts (recommendation, confidence, player_name, workload_status, findings: finding_type, summary; contributions:
    label, value as text, effect) with the text of an alert: what to do and how sure it is, the first finding's summary and
    the names of two more, or, without findings, up to three of the first five contributions that raise the anomaly and two
    that lower it, then the workload and a closing sentence. All from columns."""
    look = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit("")))
    action = F.concat(F.coalesce(look(ACTIONS, F.col("recommendation")), F.lit(OTHER_ACTION)), F.coalesce("player_name", F.lit("")))
    head = F.concat(action, F.lit(" (confidence: "), F.floor(F.coalesce("confidence", F.lit(0.0)) * 100).cast("string"), F.lit("%). "))
    found = F.coalesce("findings", F.expr("array()").cast(alerts.schema["findings"].dataType))
    others = F.array_join(F.transform(F.slice(found, 2, 2), lambda f: F.replace(f["finding_type"], F.lit("_"), F.lit(" "))), ", ")
    by_findings = F.concat(F.coalesce(F.get(found, F.lit(0))["summary"], F.lit("")), F.lit(" "), F.when(F.size(found) > 1, F.concat(F.lit("Additional signals: "), others, F.lit(". "))).otherwise(""))
    first = F.slice(F.coalesce("contributions", F.expr("array()").cast(alerts.schema["contributions"].dataType)), 1, 5)

    def named(title: str, keep, n: int):
        chosen = F.slice(F.filter(first, keep), 1, n)
        parts = F.array_join(F.transform(chosen, lambda c: F.concat(c["label"], F.lit(" ("), c["value"], F.lit(")"))), "; ")
        return F.when(F.size(chosen) > 0, F.concat(F.lit(title), parts, F.lit(". "))).otherwise("")

    by_effects = F.concat(named("Primary anomaly contributors: ", lambda c: c["effect"] > 0, 3), named("Anomaly-dampening signals: ", lambda c: c["effect"] < 0, 2))
    text = F.concat(head, F.when(F.size(found) > 0, by_findings).otherwise(by_effects), F.coalesce(look(LOAD_SENTENCES, F.col("workload_status")), F.lit("")), F.lit(CLOSING))
    return alerts.withColumn("summary", F.trim(text))
