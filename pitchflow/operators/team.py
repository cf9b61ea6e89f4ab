"""Team state on anchored ticks, its trends, insights and situations, and possessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.thresholds import ATTACK, CONTROL, OUTCOME_SCORE, PHYSICAL, TEAM, TeamThresholds


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((F.greatest(a, F.lit(0)) + (b - 1)) / b).cast("long")


def team_state(events: DataFrame, window_us: int, step_us: int | None = None, t: TeamThresholds = TEAM) -> DataFrame:
    """One row per (match, team, tick), zero rows included; a null team is a team of its own.

    Ticks are t0 + window, then every step while before the match's last event, then that event's time. A tick's window
    is (tick - window, tick]; the first tick's also holds its lower bound. Every event is dealt to the few ticks whose
    windows hold it and counted there: an equi-aggregation, no range join. Events are scanned once for the grid and once
    for the counts; both shuffles combine partial counts first."""
    step = step_us or window_us
    seconds = window_us / 1e6
    bounds = events.groupBy("match_id").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t_end")).withColumn("n_regular", _ceil_div(F.col("t_end") - F.col("t0") - window_us, step))
    teams = events.select("match_id", "team_id").distinct()
    tick = F.when(F.col("k") == F.col("n_regular"), F.col("t_end")).otherwise(F.col("t0") + window_us + F.col("k") * step)
    grid = teams.join(bounds, "match_id").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_regular")))).withColumn("tick_us", tick)
    since = F.col("t_us") - F.col("t0")
    first, last = _ceil_div(since - window_us, step), F.least(F.greatest(_ceil_div(since, step) - 1, F.lit(0)), F.col("n_regular") - 1)
    tail_start = F.col("t_end") - window_us
    in_tail = (F.col("t_us") > tail_start) | ((F.col("n_regular") == 0) & (F.col("t_us") == tail_start))
    regular = F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    ticks = F.concat(regular, F.when(in_tail, F.array("n_regular")).otherwise(F.expr("CAST(array() AS array<bigint>)")))
    kind = F.col("event_type")
    placed = events.join(bounds, "match_id").withColumn("k", F.explode(ticks))
    counts = placed.groupBy("match_id", "team_id", "k").agg(
        F.count_if(kind == "turnover").alias("turnovers"), F.count_if(kind == "possession").alias("possessions"), F.count_if(kind.isin(*ATTACK)).alias("attacks"),
        F.count_if(kind.isin(*PHYSICAL)).alias("efforts"), F.count_distinct("player_id").alias("players"), F.count("*").alias("n_events"),
    )
    g, c = grid.alias("g"), counts.alias("c")
    joined = g.join(c, (F.col("g.match_id") == F.col("c.match_id")) & F.col("g.team_id").eqNullSafe(F.col("c.team_id")) & (F.col("g.k") == F.col("c.k")), "left")
    n = {x: F.coalesce(F.col(f"c.{x}"), F.lit(0)) for x in ("turnovers", "possessions", "attacks", "efforts", "players", "n_events")}
    both = n["turnovers"] + n["possessions"]
    load = n["efforts"] * 60.0 / seconds
    return joined.select(
        F.col("g.match_id").alias("match_id"), F.col("g.team_id").alias("team_id"), F.lit(window_us).cast("long").alias("window_us"), "tick_us",
        F.round(F.when(both > 0, n["turnovers"] / both).otherwise(0.0), 4).alias("possession_pressure"), F.round(n["attacks"] * 60.0 / seconds, 4).alias("attack_activity"), F.round(load, 4).alias("physical_load"),
        F.round(F.when(n["players"] > 0, load / n["players"]).otherwise(0.0), 4).alias("fatigue_burden"), F.round(F.least(F.lit(1.0), n["n_events"] / (t.full_confidence_events_per_min * seconds / 60)), 4).alias("confidence"),
    )


def team_state_dual(events: DataFrame, short_us: int = 60_000_000, long_us: int = 300_000_000) -> DataFrame:
    return team_state(events, short_us).unionByName(team_state(events, long_us))


def _label(delta: Column, threshold: float) -> Column:
    return F.when(delta >= threshold, "increasing").when(delta <= -threshold, "decreasing").otherwise("stable")


def team_trend(states: DataFrame, t: TeamThresholds = TEAM) -> DataFrame:
    """Changes between consecutive states of a (match, team, window); labels by the unrounded change."""
    w = W.partitionBy("match_id", "team_id", "window_us").orderBy("tick_us")
    metrics = {"possession_pressure": None, "attack_activity": t.attack_trend, "physical_load": t.load_trend, "fatigue_burden": t.burden_trend}
    deltas = states.withColumns({f"d_{m}": F.col(m) - F.lag(m).over(w) for m in metrics}).filter("d_attack_activity IS NOT NULL")
    return deltas.select(
        "match_id", "team_id", "window_us", "tick_us", *[F.round(f"d_{m}", 4).alias(f"{m}_delta") for m in metrics],
        _label(F.col("d_attack_activity"), t.attack_trend).alias("attack_trend"), _label(F.col("d_physical_load"), t.load_trend).alias("load_trend"), _label(F.col("d_fatigue_burden"), t.burden_trend).alias("fatigue_trend"),
    )


def coach_insights(trends: DataFrame, t: TeamThresholds = TEAM) -> DataFrame:
    """Up to eight insights per trend row, composites besides the single ones they are made of."""
    a, load, p = F.col("attack_activity_delta"), F.col("physical_load_delta"), F.col("possession_pressure_delta")
    ra, rl, rp = F.abs(a) / t.attack_insight, F.abs(load) / t.load_insight, F.abs(p) / t.pressure_insight
    rank = lambda r: F.when(r >= t.severity_high, 2).when(r >= t.severity_medium, 1).otherwise(0)
    confidence = lambda r: F.least(F.lit(1.0), F.round(t.confidence_base + t.confidence_slope * (r - 1), 3))
    up, down = (F.col("attack_trend") == "increasing") & (a >= t.attack_insight), (F.col("attack_trend") == "decreasing") & (a <= -t.attack_insight)
    spike, drop = (F.col("load_trend") == "increasing") & (load >= t.load_insight), (F.col("load_trend") == "decreasing") & (load <= -t.load_insight)

    def one(when: Column, category: str, value: Column, threshold: float, ratio: Column) -> Column:
        return F.when(when, F.struct(F.lit(category).alias("category"), rank(ratio).alias("rank"), confidence(ratio).alias("confidence"), value.alias("value"), F.lit(float(threshold)).alias("threshold")))

    def two(when: Column, category: str) -> Column:
        return F.when(when, F.struct(F.lit(category).alias("category"), F.greatest(rank(ra), rank(rl)).alias("rank"), F.least(confidence(ra), confidence(rl)).alias("confidence"), load.alias("value"), F.lit(t.load_insight).alias("threshold")))

    found = F.array(
        one(up, "attack_activity_rising", a, t.attack_insight, ra), one(down, "attack_activity_falling", a, -t.attack_insight, ra),
        one(spike, "workload_spike", load, t.load_insight, rl), one(drop, "workload_drop", load, -t.load_insight, rl),
        one(p >= t.pressure_insight, "possession_pressure_increasing", p, t.pressure_insight, rp), one(p <= -t.pressure_insight, "possession_pressure_decreasing", p, -t.pressure_insight, rp),
        two(up & spike, "high_attack_high_load"), two(down & spike, "low_attack_high_load"),
    )
    i = trends.withColumn("i", F.explode(F.filter(found, lambda x: x.isNotNull())))
    severity = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("i.rank") + 1)
    text = F.format_string("%s of %s: change %.2f, threshold %.2f", F.regexp_replace("i.category", "_", " "), F.coalesce("team_id", F.lit("no team")), F.col("i.value"), F.col("i.threshold"))
    return i.select("match_id", "team_id", "window_us", "tick_us", "i.category", severity.alias("severity"), "i.confidence", "i.value", "i.threshold", text.alias("message"))


# Which insights support a situation.
SUPPORT = {
    "ATTACKING_SURGE_WITH_RISK": ("high_attack_high_load", "attack_activity_rising", "workload_spike"),
    "HIGH_TEMPO_ATTACK": ("attack_activity_rising", "workload_spike"),
    "INEFFICIENT_HIGH_EFFORT": ("low_attack_high_load", "attack_activity_falling", "workload_spike"),
    "POSSESSION_INSTABILITY": ("possession_pressure_increasing",),
    "SUSTAINED_PRESSURE": ("possession_pressure_decreasing", "attack_activity_rising"),
    "FATIGUE_ONSET": ("workload_spike",),
    "DEFENSIVE_RECOVERY_PHASE": ("possession_pressure_decreasing", "attack_activity_falling", "workload_drop"),
    "RECOVERY_CONSOLIDATION": ("workload_drop", "possession_pressure_decreasing"),
    "EFFICIENT_TRANSITION": ("attack_activity_rising", "workload_drop"),
    "CONTROLLED_TEMPO": (),
}


def possessions_at(possessions: DataFrame, trends: DataFrame, t: TeamThresholds = TEAM) -> DataFrame:
    """Aggregates of the possessions that end in (tick - window, tick] of each trend row: a join on the team's match, whose
    ticks and possessions are few, with the range as its condition."""
    p, s = possessions.alias("p"), trends.select("match_id", "team_id", "window_us", "tick_us").alias("s")
    on = (F.col("p.match_id") == F.col("s.match_id")) & F.col("p.team_id").eqNullSafe(F.col("s.team_id")) & (F.col("p.end_us") > F.col("s.tick_us") - F.col("s.window_us")) & (F.col("p.end_us") <= F.col("s.tick_us"))
    n = F.count("*")
    return s.join(p, on).groupBy(*[F.col(f"s.{c}").alias(c) for c in ("match_id", "team_id", "window_us", "tick_us")]).agg(
        n.alias("n_possessions"), F.round(F.count_if(F.col("p.outcome") == "turnover") / n, 4).alias("turnover_rate"), F.count_if(F.col("p.possession_quality") >= t.quality_high).alias("n_high_quality"),
        F.round(F.avg("p.possession_quality"), 4).alias("mean_quality"),
    )


def coach_situations(possessions: DataFrame, states: DataFrame, trends: DataFrame, insights: DataFrame, t: TeamThresholds = TEAM) -> DataFrame:
    """The first of ten ordered rules that holds at a trend row, or no row."""
    keys = ["match_id", "team_id", "window_us", "tick_us"]
    support = insights.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", "confidence"))).alias("insights"))
    rows = trends.alias("t")
    for name, other in (("s", states.select(*keys, "attack_activity")), ("i", support), ("a", possessions_at(possessions, trends, t))):
        same = [F.col(f"t.{k}").eqNullSafe(F.col(f"{name}.{k}")) for k in keys]
        rows = rows.join(other.alias(name), same, "left")
    has = lambda c: F.coalesce(F.map_contains_key("insights", F.lit(c)), F.lit(False))
    n, turn, high, quality = (F.coalesce(c, F.lit(0)) for c in ("n_possessions", "turnover_rate", "n_high_quality", "mean_quality"))
    attack, load, fatigue, pressure, level = (F.col(c) for c in ("attack_trend", "load_trend", "fatigue_trend", "possession_pressure_delta", "attack_activity"))
    rules = (
        ("ATTACKING_SURGE_WITH_RISK", has("high_attack_high_load") & (n > 0) & (turn >= t.turnover_heavy)),
        ("HIGH_TEMPO_ATTACK", (attack == "increasing") & (level >= t.attack_floor) & (n > 0) & (quality >= t.quality_high) & (load == "increasing")),
        ("INEFFICIENT_HIGH_EFFORT", has("low_attack_high_load")),
        ("POSSESSION_INSTABILITY", (n > 0) & (turn >= t.turnover_heavy) & (pressure >= t.pressure_worsening)),
        ("SUSTAINED_PRESSURE", (high >= t.high_quality_possessions) & (attack != "decreasing") & (level >= t.attack_floor) & (pressure <= -t.pressure_improving)),
        ("FATIGUE_ONSET", (fatigue == "increasing") & (load != "decreasing") & (attack != "increasing")),
        ("DEFENSIVE_RECOVERY_PHASE", (attack != "increasing") & (level <= t.attack_ceiling) & (load == "decreasing") & (pressure <= -t.pressure_improving)),
        ("RECOVERY_CONSOLIDATION", (fatigue == "decreasing") & (load != "increasing") & (pressure <= 0)),
        ("EFFICIENT_TRANSITION", (attack == "increasing") & (load == "decreasing")),
        ("CONTROLLED_TEMPO", (attack == "stable") & (load == "stable") & (fatigue == "stable") & (F.abs(pressure) < t.pressure_stable)),
    )
    situation = F.lit(None).cast("string")
    relevant = F.expr("CAST(array() AS array<string>)")
    for name, rule in reversed(rules):
        situation = F.when(rule, F.lit(name)).otherwise(situation)
    for name, categories in SUPPORT.items():
        if categories:
            relevant = F.when(F.col("situation") == name, F.array(*map(F.lit, categories))).otherwise(relevant)
    rows = rows.withColumn("situation", situation).filter("situation IS NOT NULL")
    present = F.array_sort(F.filter(relevant, lambda c: has(c)))
    rows = rows.withColumn("present", present)
    size = F.size("present")
    return rows.select(
        *[F.col(f"t.{k}").alias(k) for k in keys], F.col("situation").alias("situation_type"), F.when(size >= 2, "high").when(size == 1, "medium").otherwise("low").alias("severity"),
        F.when(size > 0, F.array_min(F.transform("present", lambda c: F.element_at("insights", c)))).otherwise(t.trend_only_confidence).alias("confidence"), F.array_join("present", ",").alias("source_insights"),
        n.cast("long").alias("n_possessions"), turn.cast("double").alias("turnover_rate"),
    )


def possessions(events: DataFrame) -> DataFrame:
    """Possession spans of a match. The holder before an event depends on the last control event alone, so spans are
    islands: a control event of a team that doesn't hold the ball begins one. A span ends by its shot or turnover, else
    neutral at its last event; an open span that another team's shot cuts off isn't emitted."""
    order = [F.col("t_us"), F.when(F.col("event_type").isin("shot", "turnover"), 0).otherwise(1), F.col("event_id")]
    w = W.partitionBy("match_id").orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    kind = F.col("event_type")
    control = kind.isin(*CONTROL)
    e = events.withColumn("_last", F.last(F.when(control, F.struct("event_type", "team_id")), ignorenulls=True).over(before))
    held = F.coalesce(F.col("_last.event_type") == "possession", F.lit(False))
    mine = held & F.col("team_id").eqNullSafe(F.col("_last.team_id"))
    e = e.withColumn("_start", (control & ~mine).cast("int")).withColumn("_attached", control | mine)
    e = e.withColumn("span", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_attached")
    spans = e.groupBy("match_id", "span").agg(
        F.min_by("team_id", F.struct(*order)).alias("team_id"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count_if(kind == "shot").alias("shots"), F.count_if(kind == "turnover").alias("turnovers"),
        F.count_if(kind.isin(*ATTACK)).alias("attacks"), F.count_if(kind.isin(*PHYSICAL)).alias("efforts"), F.count_if(kind.isin("sprint_event", "acceleration_event")).alias("transitions"), F.count("*").alias("n_events"),
    )
    following = W.partitionBy("match_id").orderBy("span")
    spans = spans.withColumns({"_next_shots": F.lead("shots").over(following), "_next_n": F.lead("n_events").over(following)})
    closed = (F.col("shots") > 0) | (F.col("turnovers") > 0)
    cut_off = ~closed & (F.coalesce("_next_shots", F.lit(0)) == 1) & (F.col("_next_n") == 1)
    outcome = F.when(F.col("shots") > 0, "shot").when(F.col("turnovers") > 0, "turnover").otherwise("neutral")
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    factor = F.when(seconds > 0, 60 / seconds).otherwise(0.0)
    attack = F.col("attacks") * factor
    score = F.when(outcome == "shot", 0.85).when(outcome == "turnover", 0.0).otherwise(0.5)
    if "shot_outcome" in events.columns:
        score = F.when(outcome == "shot", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOME_SCORE.items() for x in kv]), F.col("shot_outcome")), F.lit(0.85))).otherwise(score)
        last_shot = e.filter(kind == "shot").groupBy("match_id", "span").agg(F.max_by("shot_outcome", F.struct(*order)).alias("shot_outcome"))
        spans = spans.join(last_shot, ["match_id", "span"], "left")
    kept = spans.filter(~cut_off)
    return kept.select(
        "match_id", "team_id", "start_us", "end_us", outcome.alias("outcome"), F.row_number().over(following).alias("seq"), "n_events", F.round(attack, 4).alias("attack_activity"), F.round(F.col("efforts") * factor, 4).alias("physical_load"),
        F.round(F.col("transitions") * factor, 4).alias("transition_rate"), F.round(0.5 * score + 0.5 * F.least(F.lit(1.0), attack / 15), 4).alias("possession_quality"),
    )


def final_rows(rows: DataFrame, at: str = "tick_us") -> DataFrame:
    """Rows before their match's last tick: what later events can't change."""
    last = W.partitionBy("match_id")
    return rows.withColumn("_last", F.max(at).over(last)).filter(F.col(at) < F.col("_last")).drop("_last")


def opponent_team(events: DataFrame, own: str, context: DataFrame | None = None) -> DataFrame:
    """Per match the opponent that its latest context (match_id, t_us, opponent_team_id) names; where that names none, the
    team other than `own` that most events name, ties to the first by name."""
    n = events.filter(F.col("team_id").isNotNull() & (F.col("team_id") != own)).groupBy("match_id", "team_id").agg(F.count("*").alias("n"))
    counted = n.groupBy("match_id").agg(F.min_by("team_id", F.struct((-F.col("n")).alias("minus"), "team_id")).alias("opponent_id"), F.max("n").alias("n_events"))
    if context is None:
        return counted
    told = context.groupBy("match_id").agg(F.max(F.struct("t_us", "opponent_team_id"))["opponent_team_id"].alias("_told")).filter("_told <> ''")
    return counted.join(told, "match_id", "full").select("match_id", F.coalesce("_told", "opponent_id").alias("opponent_id"), "n_events")
