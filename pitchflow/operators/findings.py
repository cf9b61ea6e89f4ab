"""Findings on scored windows, what they add up to over a match, and what is recommended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.thresholds import FINDINGS, FindingThresholds

# Severities in order, trend directions in order of priority, weights of motifs and of coupled states.
SEVERITIES = ("low", "medium", "high", "critical")
DIRECTIONS = ("worsening", "recovering", "increasing", "declining", "stable")
MOTIF_WEIGHTS = {"sprint_collapse_progression": 4, "persistent_cardiovascular_overload": 3, "fatigue_tactical_drift": 3, "acute_severity_escalation": 4}
COUPLED_WEIGHTS = {"critical": 1.0, "high": 0.6, "medium": 0.3, "low": 0.1}
PROGRESSION = ("locomotor_overload", "cardiovascular_overload", "recovery_degradation")


def _of(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def severity_rank(severity: Column) -> Column:
    return _of({s: i for i, s in enumerate(SEVERITIES)}, severity, -1)


def degraded_window(t: FindingThresholds = FINDINGS, hr_sensor: bool = False) -> Column:
    """Whether a window's features can't all be true: far too long a way while standing, no heart rate while moving (where
    sensors are worn), a negative distance, a heart rate while moving that nobody has."""
    speed, distance, hr = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("window_avg_speed_ms", "window_distance_m", "heart_rate_bpm"))
    stale = (speed <= 0.1) & (distance > (t.speed_low + 0.5) * 30)
    dropout = (hr == 0) & (speed > 0.5) if hr_sensor else F.lit(False)
    return stale | dropout | (distance < 0) | ((speed > 0.5) & (hr > 0) & ((hr < 30) | (hr > 220)))


def semantic_findings(rows: DataFrame, keys: tuple[str, ...], t: FindingThresholds = FINDINGS, hr_sensor: bool = False) -> DataFrame:
    """keys, finding, severity, confidence, features (that support it), trend, rank: up to six findings of a window, the
    most severe first. rows: features by name, attribution (map of feature to its share of the score) and
    persistence_windows. Degraded windows have none. Projections only: nothing is shuffled."""
    v = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    a = lambda c: F.coalesce(F.col("attribution")[c], F.lit(0.0))
    backs = lambda *cs: reduce(Column.__or__, [F.abs(a(c)) >= t.relevant for c in cs])
    p = F.coalesce("persistence_windows", F.lit(0))
    lasting = p >= t.persistence
    none = F.lit(None).cast("string")

    def found(name, when: Column, severity: Column, base: float, features: list[tuple[str, Column]]) -> Column:
        used = F.array_compact(F.array(*[F.when(on, F.lit(c)).otherwise(none) for c, on in features]))
        return F.when(when, F.struct((name if isinstance(name, Column) else F.lit(name)).alias("finding"), severity.alias("severity"), F.lit(base).alias("base"), used.alias("features")))

    yes = F.lit(True)
    hr, rec, speed, drop, fat = v("heart_rate_bpm"), v("hr_recovery_time_s"), v("window_avg_speed_ms"), v("speed_drop_pct"), v("fatigue_decay_residual")
    acwr, drift = v("acwr", 1.0), v("positional_drift_score")
    impaired = rec >= t.recovery_flat
    effort = (hr >= t.hr_high) & impaired & backs("heart_rate_bpm", "hr_recovery_time_s")
    rest = impaired & (speed <= t.speed_low) & (a("hr_recovery_time_s") >= t.strong)
    cardio = found(
        F.when(effort, "cardiovascular_overload").otherwise("elevated_cardiovascular_response"), effort | rest,
        F.when(effort, F.when((hr >= t.hr_critical) & lasting, "critical").when(hr >= t.hr_critical, "high").otherwise("medium")).otherwise(F.when(lasting, "high").otherwise("medium")),
        0.75, [("heart_rate_bpm", yes), ("hr_recovery_time_s", yes)],
    )
    zs = ("z_distance", "z_sprint_count", "z_top_speed", "z_high_speed_dist")
    raised = [(c, v(c) >= t.z_high) for c in zs]
    own = ("window_distance_m", "window_avg_speed_ms", "window_sprint_count")
    many = lambda conditions: reduce(Column.__add__, [on.cast("int") for _, on in conditions])
    overload = found("locomotor_overload", (many(raised) >= 2) & backs(*own, *zs), F.when(F.greatest(*[v(c) for c in zs]) >= t.z_very_high, "high").otherwise("medium"), 0.72, raised)
    marks = [("hr_recovery_time_s", impaired), ("speed_drop_pct", drop >= t.speed_drop), ("fatigue_decay_residual", fat >= t.fatigue_residual), ("acwr", acwr >= t.acwr_high)]
    backed = reduce(Column.__or__, [on & backs(c) for c, on in marks])
    recovery = found("recovery_degradation", (many(marks) >= 2) & backed, F.when(many(marks) >= 3, "high").otherwise("medium"), 0.68, marks)
    tactical = found("tactical_instability", (drift >= t.drift) & backs("positional_drift_score"), F.when(drift >= t.drift_high, "high").otherwise("low"), 0.65, [("positional_drift_score", yes)])
    tired = ("speed_drop_pct", "acwr", "fatigue_decay_residual", "window_avg_speed_ms", "window_sprint_count")
    fatigue = found("fatigue_accumulation", (drop >= t.speed_drop) & ((acwr >= t.acwr_high) | (fat >= t.fatigue_residual)) & backs(*tired), F.when(lasting, "high").otherwise("medium"), 0.70, [(c, backs(c) | (v(c) > 0)) for c in tired])
    pull = F.greatest(a("window_avg_speed_ms"), F.lit(0.0)) + F.greatest(a("window_distance_m"), F.lit(0.0))
    suppressed = found("locomotor_suppression", (speed <= t.speed_low) & (pull > 0) & (pull >= t.strong), F.when(lasting, "high").otherwise("medium"), 0.72, [("window_avg_speed_ms", yes), ("window_distance_m", yes)])
    rules = F.array_compact(F.array(cardio, overload, recovery, tactical, fatigue, suppressed))
    bonus = F.aggregate("f.features", F.lit(0.0), lambda s, c: s + F.least(F.abs(F.coalesce(F.col("attribution")[c], F.lit(0.0))) / t.strong, F.lit(1.0)) * 0.10)
    r = rows.filter(~degraded_window(t, hr_sensor)).withColumn("f", F.explode(rules))
    r = r.select(*keys, F.col("f.finding").alias("finding"), F.col("f.severity").alias("severity"), F.round(F.least(F.col("f.base") + bonus, F.lit(0.98)), 9).alias("confidence"), F.array_join("f.features", ",").alias("features"), F.when(lasting, "persistent").otherwise("stable").alias("trend"))
    w = W.partitionBy(*keys).orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), "finding")
    return r.withColumn("rank", F.row_number().over(w))


def recommendation(findings: Column, severities: Column, persistence: Column, recurrence: Column, escalation: Column, trend: Column, acwr: Column, t: FindingThresholds = FINDINGS) -> Column:
    """The first of six rules that holds; findings and severities are arrays of a window's."""
    has = lambda array, *names: F.arrays_overlap(array, F.array(*map(F.lit, names)))
    return (
        F.when((recurrence >= t.recurrence) & (persistence >= t.substitute_after) & escalation.isin("high", "critical"), "substitute")
        .when(has(findings, "recovery_degradation", "cardiovascular_overload", "elevated_cardiovascular_response") & has(severities, "high", "critical") & (persistence >= t.persistence), "recovery_intervention")
        .when((has(findings, "fatigue_accumulation") | (F.coalesce(acwr, F.lit(0.0)) >= t.acwr_high)) & (persistence >= t.restrict_after), "workload_restriction")
        .when(has(findings, "tactical_instability"), "tactical_adjustment")
        .when(has(findings, "locomotor_suppression", "locomotor_overload") & (trend == "worsening"), "performance_monitor")
        .otherwise("anomaly_flag")
    )


def priority_trend(directions: Column) -> Column:
    """The most pressing of several trend directions (an array), stable without any."""
    out = F.lit("stable")
    for d in reversed(DIRECTIONS):
        out = F.when(F.array_contains(directions, d), d).otherwise(out)
    return out


def policy_inputs(windows: DataFrame, closed: DataFrame, recurring: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """windows (player_id, match_id, findings, active) with in_match_recurrence, the recurring patterns of the match that
    name the active one, and cross_match_recurrence, the closed episodes of the player's other matches with the active
    finding. closed: player_id, match_id, finding; recurring: player_id, match_id, pattern. Equi-joins on counts."""
    own = closed.groupBy("player_id", F.col("finding").alias("active"), "match_id").agg(F.count("*").alias("here"))
    every = own.groupBy("player_id", "active").agg(F.sum("here").alias("all"))
    w = windows.join(every, ["player_id", "active"], "left").join(own, ["player_id", "active", "match_id"], "left")
    named = recurring.select("player_id", "match_id", F.explode(F.array_distinct(F.split("pattern", ">"))).alias("active")).groupBy("player_id", "match_id", "active").agg(F.count("*").alias("in_match_recurrence"))
    w = w.join(named, ["player_id", "match_id", "active"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return w.select(*keys, "active", zero("in_match_recurrence").alias("in_match_recurrence"), (zero("all") - zero("here")).alias("cross_match_recurrence"))


def recent_findings(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], last: int = 50) -> DataFrame:
    """fs: the last findings (finding, severity, confidence, minute) of each group, oldest first. A row number bounds them
    before anything is collected."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]))
    kept = findings.withColumn("_rn", rn).filter(F.col("_rn") <= last)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("o"), "finding", "severity", "confidence", "minute"))), lambda x: F.struct(x.finding.alias("finding"), x.severity.alias("severity"), x.confidence.alias("confidence"), x.minute.alias("minute"))).alias("fs"))


def motif_confidence(fs: Column) -> Column:
    """Half the mean confidence (older findings decay), a third of a tenth by their number, a fifth by compactness."""
    minutes = F.transform(fs, lambda f: f.minute)
    newest, oldest = F.array_max(minutes), F.array_min(minutes)
    weight = lambda f: F.exp(-0.15 * F.greatest(F.lit(0), newest - f.minute).cast("double"))
    total = lambda g: F.aggregate(fs, F.lit(0.0), lambda s, f: s + g(f))
    strength = total(lambda f: weight(f) * f.confidence) / total(weight)
    compact = F.greatest(F.lit(0.2), 1 - (newest - oldest) / 12.0)
    score = 0.5 * strength + 0.3 * F.least(F.lit(1.0), F.log10(F.size(fs) + 1.0)) + 0.2 * compact
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)


def _progression(fs: Column, pattern: tuple[str, ...], within: int) -> Column:
    """The findings from the earliest start at which the pattern's names follow in order, others between, within so many
    findings; null without. State of the fold over a start's window: how many names were met, and where it ended."""
    def end_from(start: Column) -> Column:
        part = F.slice(fs, start, F.lit(within))
        first = F.struct(F.lit(0).alias("met"), F.lit(0).alias("i"), F.lit(0).alias("end"))
        names = F.array(*map(F.lit, pattern))

        def step(s: Column, f: Column) -> Column:
            hit = (s.met < len(pattern)) & (f.finding == F.element_at(names, F.least(s.met + 1, F.lit(len(pattern)))))
            return F.struct((s.met + hit.cast("int")).alias("met"), (s.i + 1).alias("i"), F.when(hit, s.i + 1).otherwise(s.end).alias("end"))

        return F.aggregate(part, first, step, lambda s: F.when(s.met == len(pattern), F.slice(part, F.lit(1), s.end)))

    starts = F.when(F.size(fs) >= len(pattern), F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(fs) - len(pattern) + 1)))
    return F.get(F.filter(F.transform(starts, end_from), lambda x: x.isNotNull()), F.lit(0))


def motifs(recent: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, motif, severity, confidence: repeated patterns among each group's recent findings (fs, at most some fifty)."""
    fs = F.col("fs")
    of = lambda *names: F.filter(fs, lambda f: f.finding.isin(*names))
    r = recent.withColumn("prog", _progression(fs, PROGRESSION, 10))
    prog = F.col("prog").isNotNull()
    none = F.lit(None).cast("struct<motif:string,severity:string,fs:array<struct<finding:string,severity:string,confidence:double,minute:bigint>>>")
    m = lambda when, name, severity, part: F.when(when, F.struct((name if isinstance(name, Column) else F.lit(name)).alias("motif"), F.lit(severity).alias("severity"), part.alias("fs"))).otherwise(none)
    cv = of("cardiovascular_overload")
    three = F.slice(fs, F.greatest(F.lit(1), F.size(fs) - 2), F.lit(3))
    single = [
        m(prog, "sprint_collapse_progression", "high", F.col("prog")),
        m(~prog & (F.size(cv) >= 3), "persistent_cardiovascular_overload", "high", cv),
        m(~prog & (F.size(of("locomotor_overload")) >= 2) & (F.size(cv) >= 1) & (F.size(of("recovery_degradation")) >= 1), "sprint_collapse_motif", "high", of(*PROGRESSION)),
        m((F.size(of("fatigue_accumulation")) >= 1) & (F.size(of("tactical_instability")) >= 1), "fatigue_tactical_drift", "medium", of("fatigue_accumulation", "tactical_instability")),
        m((F.size(fs) >= 3) & F.forall(three, lambda f: f.severity.isin("high", "critical")), "acute_severity_escalation", "critical", three),
    ]
    flagged = F.when(prog, F.array(*map(F.lit, PROGRESSION))).when(F.size(cv) >= 3, F.array(F.lit("cardiovascular_overload"))).otherwise(F.array().cast("array<string>"))
    kinds = F.array_except(F.array_distinct(F.transform(fs, lambda f: f.finding)), flagged)
    lasting = F.transform(kinds, lambda k: F.struct(F.concat(F.lit("persistent_"), k).alias("motif"), F.lit("medium").alias("severity"), F.filter(fs, lambda f: f.finding == k).alias("fs")))
    lasting = F.filter(lasting, lambda x: F.size(x.fs) >= 3)
    out = r.select(*keys, F.explode(F.concat(F.array_compact(F.array(*single)), lasting)).alias("m"))
    return out.select(*keys, F.col("m.motif").alias("motif"), F.col("m.severity").alias("severity"), motif_confidence(F.col("m.fs")).alias("confidence"))


def coupled_states(trends: DataFrame, transitions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, state, severity, confidence: what the workload, recovery and anomaly trends say together. trends: per axis
    the columns {axis}_direction, {axis}_volatility, {axis}_slope, {axis}_curvature, and anomaly_acceleration;
    transitions: keys, source, target, n, of which a state's typical ones raise its confidence."""
    total = F.sum("n").over(W.partitionBy(*keys, "source"))
    p = transitions.withColumn("p", F.round(F.col("n") / total, 3)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "source", "target").alias("k"), "p"))).alias("ps"))
    r = trends.join(p, list(keys), "left")
    d = lambda x: F.coalesce(F.col(f"{x}_direction"), F.lit("stable"))
    down = lambda x: d(x).isin("worsening", "declining").cast("int")

    def confidence(axes: tuple[str, ...], pairs: tuple[str, ...]) -> Column:
        mean = lambda f: sum((f(x) for x in axes[1:]), f(axes[0])) / len(axes)
        slope = F.least(mean(lambda x: F.abs(F.coalesce(f"{x}_slope", F.lit(0.0)))) * 5, F.lit(1.0))
        curve = F.least(mean(lambda x: F.abs(F.coalesce(f"{x}_curvature", F.lit(0.0)))) * 20, F.lit(1.0))
        vols = F.array(*[F.col(f"{x}_volatility") for x in axes])
        penalty = F.when(F.array_contains(vols, "high"), 0.15).when(F.array_contains(vols, "medium"), 0.05).otherwise(0.0)
        base = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.45 + 0.30 * mean(down) + 0.15 * slope + 0.10 * curve - penalty)), 3)
        best = F.array_max(F.array(*[F.coalesce(F.col("ps")[x], F.lit(0.0)) for x in pairs]))
        return F.round(F.least(F.lit(1.0), base + 0.15 * best), 3)

    lo_cv, lo_rec, cv_rec, rec_cv = "locomotor_overload>cardiovascular_overload", "locomotor_overload>recovery_degradation", "cardiovascular_overload>recovery_degradation", "recovery_degradation>cardiovascular_overload"
    s = lambda when, name, severity, axes, *pairs: F.when(when, F.struct(F.lit(name).alias("state"), F.lit(severity).alias("severity"), confidence(axes, pairs).alias("confidence")))
    worse = lambda x: d(x) == "worsening"
    states = F.array_compact(F.array(
        s((d("workload") == "declining") & worse("recovery"), "fatigue_accumulation_under_load", "high", ("workload", "recovery"), lo_rec, cv_rec),
        s(worse("anomaly") & worse("recovery"), "systemic_instability", "critical", ("anomaly", "recovery"), cv_rec, lo_cv),
        s((F.col("recovery_volatility") == "high") & worse("recovery"), "unstable_recovery_response", "medium", ("recovery",), rec_cv),
        s(worse("anomaly") & (F.col("anomaly_acceleration") == "accelerating_deterioration"), "accelerating_instability", "high", ("anomaly",), lo_cv),
    ))
    return r.select(*keys, F.explode(states).alias("s")).select(*keys, "s.*")


def escalation(groups: DataFrame, motifs_: DataFrame, coupled: DataFrame, persistent: DataFrame, trends: DataFrame, transitions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, the five risks, total_risk and level of each group: a quarter motifs, a quarter coupled states, a fifth
    persistent findings, the rest trends that worsen and transitions along the usual chain. persistent: keys, severity."""
    k = list(keys)
    critical = lambda c: F.bool_or(c == "critical")
    m = motifs_.groupBy(*k).agg(F.sum(_of(MOTIF_WEIGHTS, F.col("motif"), 1)).alias("_m"), critical(F.col("severity")).alias("_mc"))
    c = coupled.groupBy(*k).agg(F.sum(_of(COUPLED_WEIGHTS, F.col("severity"), 0.1)).alias("_c"), critical(F.col("severity")).alias("_cc"))
    p = persistent.groupBy(*k).agg(F.count("*").alias("_p"), critical(F.col("severity")).alias("_pc"), F.count_if(F.col("severity").isin("high", "critical")).alias("_ph"))
    worse = sum((F.coalesce(F.col(f"{x}_direction").isin("worsening", "declining"), F.lit(False)).cast("int") for x in ("workload", "recovery", "anomaly")), F.lit(0))
    total = F.sum("n").over(W.partitionBy(*k, "source"))
    share = transitions.withColumn("_s", F.round(F.col("n") / total, 3))
    on = lambda a, b: F.max(F.when((F.col("source") == a) & (F.col("target") == b), F.col("_s")).otherwise(0.0))
    x = share.groupBy(*k).agg((on("locomotor_overload", "cardiovascular_overload") + on("cardiovascular_overload", "recovery_degradation")).alias("_x"))
    r = groups.select(*k).join(m, k, "left").join(c, k, "left").join(p, k, "left").join(trends.select(*k, worse.alias("_w")), k, "left").join(x, k, "left")
    capped = lambda col, by: F.least(F.lit(1.0), F.coalesce(F.col(col), F.lit(0)) / by)
    risks = {"motif_risk": capped("_m", 8.0), "coupled_risk": capped("_c", 2.0), "persistence_risk": capped("_p", 5.0), "instability_risk": capped("_w", 3.0), "transition_risk": capped("_x", 2.0)}
    r = r.withColumns(risks)
    score = 0.25 * F.col("motif_risk") + 0.25 * F.col("coupled_risk") + 0.20 * F.col("persistence_risk") + 0.15 * F.col("instability_risk") + 0.15 * F.col("transition_risk")
    yes = lambda col: F.coalesce(F.col(col), F.lit(False))
    level = F.when(yes("_mc") | yes("_cc") | yes("_pc"), "critical").when((F.coalesce("_ph", F.lit(0)) >= 2) | (F.round(score, 9) >= 0.45), "high").when(F.round(score, 9) >= 0.20, "elevated").otherwise("normal")
    return r.select(*k, *[F.round(c, 3).alias(c) for c in risks], F.round(score, 6).alias("total_risk"), level.alias("level"))


def relevant_episodes(episodes: DataFrame, current: DataFrame, keys: tuple[str, ...], n: int = 3) -> DataFrame:
    """The n episodes of a match most relevant to the current findings: 2 for the same finding, 1 for a worsening trend,
    by severity 1, 0.6, 0.3 or 0, and up to 1 by recency, ties to the newer. episodes: keys, episode, finding, trend,
    severity; current: keys, findings."""
    w = W.partitionBy(*keys)
    newest = F.row_number().over(w.orderBy("episode")) / F.count("*").over(w)
    e = episodes.join(current.select(*keys, "findings"), list(keys)).withColumn("_recency", newest)
    weight = _of({"critical": 1.0, "high": 0.6, "medium": 0.3}, F.col("severity"), 0.0)
    e = e.withColumn("relevance", F.round(2.0 * F.array_contains("findings", F.col("finding")).cast("int") + (F.col("trend") == "worsening").cast("int") + weight + F.col("_recency"), 6))
    rank = F.row_number().over(w.orderBy(F.col("relevance").desc(), F.col("episode").desc()))
    return e.withColumn("rank", rank).filter(F.col("rank") <= n).select(*keys, "rank", "episode", "finding", "relevance")
