"""Calibration, decisions, adaptation and published records of scored windows."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import dynamic_threshold, with_sums_above
from .scoring import regime_threshold, top_features
from .state import alert_states
from .walks import Walk, ordered_walk
from .windows import ema

# Which channel's attribution a coach's feature takes, and the coach's features.
CHANNELS = {"window_avg_speed_ms": "speed_ms", "heart_rate_bpm": "heart_rate_bpm", "window_sprint_count": "sprint_flag", "window_distance_m": "distance_delta_m", "hr_recovery_time_s": "hr_recovery_rate"}
COACH_FEATURES = (
    "window_sprint_count", "window_distance_m", "window_avg_speed_ms", "heart_rate_bpm", "hr_recovery_time_s", "z_distance", "z_sprint_count", "z_top_speed", "z_high_speed_dist",
    "acwr", "positional_drift_score", "fatigue_decay_residual", "speed_drop_pct", "coach_fatigue_severity", "coach_pre_match_status_encoded",
)


def calibration_losses(scored: DataFrame, player: str, order: tuple[str, ...], loss: str, share: float = 0.8, alpha: float = 0.25) -> DataFrame:
    """The last fifth of each player's windows in order, losses smoothed from the first of them on."""
    w = W.partitionBy(player)
    r = scored.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).filter(F.col("_rn") > F.floor(F.col("_n") * share))
    smoothed = ema(r, loss, (player,), order, alpha).select(player, *order, F.col("ema").alias("smoothed"))
    return r.drop("_rn", "_n").join(smoothed, [player, *order])


ALERTS = ("anomaly", "fatigue", "drift", "workload")


def score_decisions(scored: DataFrame, context: DataFrame, key: str, order: tuple[str, ...] = ("elapsed_s",), half_s: float = 1800.0, match_s: float = 3600.0) -> DataFrame:
    """scored (key, player_id, smoothed, threshold, confidence, speed_ms, sprint_flag, elapsed_s) with each window's alerts.
    context (player_id): distance_mean of the baseline, drift_score, drift_flagged, acwr.

    What is up: an anomaly where the smoothed loss exceeds the threshold (never without one); fatigue where an anomaly is
    late in the match with a speed under 0.55 of the baseline's or without a sprint; drift as flagged; workload at a ratio
    over 1.5 or under 0.8. Each goes through the alert machine of its player and kind, in the given order, and is an alert
    in WARNING or CRITICAL, so from the third window in a row on and until three quiet ones. signals: category, subtype,
    severity and confidence of each alert, by the window's own values; alert_level and persistence are the anomaly's."""
    r = scored.join(context, "player_id", "left")
    usual = F.when(F.col("distance_mean") > 0, F.col("distance_mean") / match_s).otherwise(3.5)
    slow = F.coalesce(F.col("speed_ms") / F.greatest(usual, F.lit(0.1)) < 0.55, F.lit(False))
    no_sprint, late = F.coalesce(F.col("sprint_flag") == 0, F.lit(False)), F.coalesce(F.col("elapsed_s") > half_s, F.lit(False))
    anomaly = F.coalesce((F.col("smoothed") > F.col("threshold")) & (F.col("threshold") < float("inf")), F.lit(False))
    acwr = F.coalesce("acwr", F.lit(1.0))
    up = (anomaly, anomaly & (slow | no_sprint) & late, F.coalesce("drift_flagged", F.lit(False)), (acwr > 1.5) | (acwr < 0.8))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("_kind"), u.alias("active")) for k, u in zip(ALERTS, up, strict=True)]))
    flat = r.select("player_id", *order, key, kinds.alias("_u")).select("player_id", *order, key, "_u._kind", "_u.active", F.lit(1.0).alias("confidence"))
    states = alert_states(flat, ("player_id", "_kind"), (*order, key))
    alert = lambda k: F.coalesce(F.bool_or((F.col("_kind") == k) & F.col("state").isin("WARNING", "CRITICAL")), F.lit(False)).alias(f"_{k}")
    of = lambda c: F.max(F.when(F.col("_kind") == "anomaly", F.col(c)))
    told = states.groupBy("player_id", *order, key).agg(*map(alert, ALERTS), of("state").alias("alert_level"), of("persistence").alias("persistence"))
    w, t = r.alias("w"), told.alias("t")
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("player_id", *order, key)]
    r = w.join(t, on).select("w.*", *[f"t._{k}" for k in ALERTS], "t.alert_level", "t.persistence")
    c = F.round(F.coalesce("confidence", F.lit(0.0)), 9)
    s = lambda when, category, subtype, severity, conf: F.when(when, F.struct(F.lit(category).alias("category"), subtype.alias("subtype"), severity.alias("severity"), conf.cast("double").alias("confidence")))
    signals = F.array_compact(F.array(
        s(F.col("_anomaly"), "anomaly", F.lit(None).cast("string"), F.when(c > 0.85, "high").otherwise("medium"), c),
        s(F.col("_fatigue"), "fatigue", F.when(slow & no_sprint, "speed_sprint_decline").when(slow, "speed_decline").otherwise("sprint_decline"), F.when(late, "high").otherwise("medium"), c),
        s(F.col("_drift"), "drift", F.lit("positional_zone_violation"), F.lit("medium"), F.coalesce("drift_score", F.lit(0.0))),
        s(F.col("_workload"), "workload", F.when(acwr > 1.5, "acwr_overload").otherwise("acwr_underload"), F.when((acwr > 1.8) | (acwr < 0.6), "high").otherwise("medium"), F.lit(1.0)),
    ))
    names = {"_anomaly": "is_anomaly", "_fatigue": "fatigue_flag", "_drift": "drift_flag", "_workload": "workload_flag"}
    return r.select(key, "player_id", *[F.col(a).alias(b) for a, b in names.items()], signals.alias("signals"), "alert_level", "persistence")


def fp_budget_threshold(scored: DataFrame, by: str | None = None, budget: float = 2.0, interval_s: float = 120.0, minutes: float = 90.0) -> DataFrame:
    """The lowest score such that calling all scores from it on keeps false alerts within the budget of a match; the
    highest score where none does. Counts by distinct score are range-partitioned; false positives above a score follow
    from partition totals and sums within partitions."""
    key = [] if by is None else [by]
    per = scored.groupBy(*key, "score").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count("*").alias("n"))
    per = with_sums_above(per, key, "score", ["neg"])
    total = scored.groupBy(*key).agg(F.count_if(F.col("label") == 0).alias("normals"), F.count("*").alias("all"), F.max("score").alias("highest"))
    j = per.join(total, key) if key else per.crossJoin(F.broadcast(total))  # one row
    per_match = minutes * 60 / max(interval_s, 1.0)
    limit = budget / F.greatest(per_match * F.col("normals") / F.col("all"), F.lit(1e-6))
    fits = F.col("neg_above") / F.greatest(F.col("normals"), F.lit(1)) <= limit
    return j.groupBy(*key).agg(F.coalesce(F.min(F.when(fits, F.col("score"))), F.max("highest")).alias("threshold"))


def evaluate_decisions(scored: DataFrame, calibration: DataFrame, order: tuple[str, ...], alpha: float = 0.25, newest: int = 5000, least: int = 20) -> DataFrame:
    """scored (player_id, regime, loss) smoothed per player and held against the larger of the regime's threshold and the
    99.9th percentile of the regime's calibration losses (at most its newest 5000) where there are 20 or more of them.
    calibration: player_id, regime, loss, and the order columns."""
    s = ema(scored, "loss", ("player_id",), order, alpha).select("player_id", *order, F.col("ema").alias("smoothed"))
    base = regime_threshold(calibration, "regime", "player_id", "loss").select("player_id", "regime", "threshold")
    whole = dynamic_threshold(calibration, "player_id", "loss").select("player_id", F.col("threshold").alias("_whole"))
    rn = F.row_number().over(W.partitionBy("player_id", "regime").orderBy(*[F.col(o).desc() for o in order]))
    kept = calibration.withColumn("_rn", rn).filter(F.col("_rn") <= newest)
    high = kept.groupBy("player_id", "regime").agg(F.count("*").alias("_n"), F.percentile("loss", F.lit(0.999)).alias("_p"))
    r = scored.join(s, ["player_id", *order]).join(base, ["player_id", "regime"], "left").join(high, ["player_id", "regime"], "left").join(whole, "player_id", "left")
    floor = F.coalesce("threshold", "_whole", F.lit(float("inf")))
    operational = F.when(F.col("_n") >= least, F.greatest(floor, F.col("_p"))).otherwise(floor)
    return r.select("player_id", "regime", *order, F.round("smoothed", 9).alias("smoothed"), F.when(operational < float("inf"), F.round(operational, 9)).alias("threshold"), (F.col("smoothed") > operational).alias("is_anomaly"))


ADAPTED = "player_id bigint, event_id bigint, version int, threshold double, adapted boolean"


def _threshold(values: np.ndarray) -> float:
    clean = values[values <= np.quantile(values, 0.95)]
    return float(np.quantile(clean, 0.995))


def _statistic(a: np.ndarray, b: np.ndarray) -> float:
    """Kolmogorov-Smirnov: the largest distance of two empirical distributions."""
    x = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)).max())


class _Adaptation(Walk):
    def __init__(self, quarantine: int, cooldown_us: int, drift: float, rise: float, fall: float, most_rises: int, cap: int, floor: float, ceiling: float):
        self.quarantine, self.cooldown_us, self.drift, self.rise, self.fall, self.most_rises, self.cap, self.floor, self.ceiling = quarantine, cooldown_us, drift, rise, fall, most_rises, cap, floor, ceiling
        self.window, self.waiting, self.rises, self.version, self.prior, self.last = np.zeros(0), [], 0, 0, None, None

    def _proposed(self, fit: np.ndarray) -> float | None:
        if not len(fit) or len(self.window) and _statistic(self.window, fit) > self.drift:
            return None
        t, p = max(self.floor, _threshold(np.concatenate([self.window, fit])[-self.cap :])), self.prior
        far = p is not None and p > 0 and not p * (1 - self.fall) <= t <= p * (1 + self.rise)
        return None if t > self.ceiling or far or (p is not None and t > p and self.rises >= self.most_rises) else t

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for event_id, t_us, loss, confidence in zip(rows["event_id"], rows["t_us"], rows["loss"], rows["confidence"], strict=True):
            if len(self.window) and loss > 5 * np.median(self.window):
                continue
            self.waiting.append((loss, confidence >= 0.7))
            if len(self.waiting) < self.quarantine or (self.last is not None and t_us - self.last < self.cooldown_us):
                continue
            fit = np.array([v for v, healthy in self.waiting if healthy])
            proposed = self._proposed(fit)
            self.waiting = []
            if proposed is not None:
                self.window = np.concatenate([self.window, fit])[-self.cap :]
                self.rises = self.rises + 1 if self.prior is not None and proposed > self.prior else 0
                self.prior, self.version, self.last = proposed, self.version + 1, int(t_us)
            out.append((int(event_id), self.version, None if self.prior is None else round(self.prior, 9), proposed is not None))
        return out


def adapt_thresholds(losses: DataFrame, quarantine: int = 20, cooldown_us: int = 3_600_000_000, drift: float = 0.15, rise: float = 0.2, fall: float = 0.5, most_rises: int = 3, cap: int = 500, floor: float = 0.0, ceiling: float = float("inf")) -> DataFrame:
    """Each player's threshold as it adapts to losses (player_id, event_id, t_us, loss, confidence), a row whenever the
    quarantine was full and the cooldown over.

    A loss over five times the window's median is left out. A full quarantine's healthy losses (confidence 0.7 or more)
    join the window of at most `cap` unless their distribution drifts (Kolmogorov-Smirnov) or the threshold they would
    give moves too far, or rises once too often; time is that of the events. The walk is sequential by nature; it holds
    the window, the quarantine and a few numbers, and a batch of a player's rows at a time."""
    make = partial(_Adaptation, quarantine, cooldown_us, drift, rise, fall, most_rises, cap, floor, ceiling)
    return ordered_walk(losses.select("player_id", "t_us", "event_id", "loss", "confidence"), ("player_id",), ("t_us", "event_id"), make, ADAPTED.split(", ", 1)[1])


def coach_attribution(attribution: Column, drift_score: Column) -> Column:
    """Attributions of a coach's features from those of the channels (a map): acceleration counts as speed, the two
    coordinates as one positional effect with their sum's sign, unless there is a drift score, which is then the effect."""
    a = lambda c: F.coalesce(attribution[c], F.lit(0.0))
    x, y = a("x_pitch"), a("y_pitch")
    effect = F.when(drift_score > 0, drift_score).otherwise(F.signum(x + y) * F.sqrt(x * x + y * y))
    value = lambda c: effect if c == "positional_drift_score" else a(CHANNELS[c]) + (a("acceleration_ms2") if c == "window_avg_speed_ms" else F.lit(0.0)) if c in CHANNELS else F.lit(0.0)
    return F.create_map(*[x for c in COACH_FEATURES for x in (F.lit(c), value(c))])


def magnitude_proxy(values: Column, total_effect: Column) -> Column:
    """The effect shared out among features (a map) in proportion to their magnitudes, with their signs; zeros without
    any magnitude."""
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda s, v: s + F.abs(F.coalesce(v, F.lit(0.0))))
    return F.transform_values(values, lambda _, v: F.when(total > 0, F.coalesce(v, F.lit(0.0)) / total * total_effect).otherwise(0.0))


def xai_features(scored: DataFrame, baselines: DataFrame, steps: int = 8) -> DataFrame:
    """The features that findings are made of, from a scored window's last tick: its displacement stands for all steps,
    the recovery is a change in beats, and z-scores are against the player's baseline (0 without)."""
    v = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    j = scored.join(baselines, "player_id", "left")
    distance = v("distance_delta_m") * steps
    z = lambda c, x: F.round(F.when(F.col(f"{c}_std") > 0, (x - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(0.0), 6)
    return j.select(
        *scored.columns, v("sprint_flag").alias("window_sprint_count"), F.round(distance, 6).alias("window_distance_m"), v("speed_ms").alias("window_avg_speed_ms"),
        F.round(F.abs(v("hr_recovery_rate")) * F.greatest(v("heart_rate_bpm", 150.0), F.lit(1.0)), 6).alias("hr_recovery_time_s"),
        z("distance", distance).alias("z_distance"), z("sprint_count", v("sprint_flag") * 10).alias("z_sprint_count"), z("top_speed", v("speed_ms")).alias("z_top_speed"), z("high_speed_dist", distance * 0.28).alias("z_high_speed_dist"),
    )


#: Measures of a record that are 0 where decided doesn't have them.
MEASURES = ("window_distance_m", "window_avg_speed_ms", "window_sprint_ticks", "baseline_distance_z", "baseline_speed_z", "baseline_sprint_z", "session_total_distance_m", "session_high_speed_distance_m")


def score_events(decided: DataFrame, attribution: str | None = None, measures: bool = False) -> DataFrame:
    """Published records of scored windows: the threshold is null where the player has none, and then nothing breaches.
    With measures, also those of the window, of the baseline and of the session."""
    t = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    breach = F.coalesce(F.col("loss") > t, F.lit(False))
    extra = [top_features(F.col(attribution), 5).alias("top_features")] if attribution else []
    if measures:
        kind = lambda c: "bigint" if c.endswith("ticks") else "double"
        extra += [(F.coalesce(F.col(c).cast(kind(c)), F.lit(0).cast(kind(c))) if c in decided.columns else F.lit(0).cast(kind(c))).alias(c) for c in MEASURES]
    return decided.select(
        F.lit("1").alias("schema_version"), "player_id", F.format_string("p%03d", F.col("player_id")).alias("external_id"), F.col("match_id").cast("string").alias("match_id"), "event_id", F.col("loss").alias("reconstruction_loss"),
        "confidence", t.alias("threshold"), breach.alias("raw_threshold_breach"), "regime", "tracker_source", *extra,
    )


def baseline_z(windows: DataFrame, baselines: DataFrame, measures: dict[str, str]) -> DataFrame:
    """windows with baseline_{name}_z for each measure (name: column): (value - mean) / deviation by the player's baseline
    (player_id, {name}_mean, {name}_std), 0 without one or where it doesn't vary."""
    b = baselines.select("player_id", *[F.col(f"{n}_{x}").alias(f"_{n}_{x}") for n in measures for x in ("mean", "std")])
    j = windows.join(b, "player_id", "left")
    z = lambda n, c: F.coalesce(F.when(F.col(f"_{n}_std") > 1e-9, (F.col(c) - F.col(f"_{n}_mean")) / F.col(f"_{n}_std")), F.lit(0.0))
    return j.select(*windows.columns, *[F.round(z(n, c), 6).alias(f"baseline_{n}_z") for n, c in measures.items()])


def feature_importance(attributed: DataFrame, column: str = "attribution") -> DataFrame:
    """Mean absolute attribution of each feature, the largest first."""
    x = attributed.select(F.explode(column).alias("feature", "value")).groupBy("feature").agg(F.round(F.avg(F.abs("value")), 9).alias("importance"), F.count("*").alias("n"))
    return x.withColumn("rank", F.row_number().over(W.orderBy(F.col("importance").desc(), "feature")))  # a row a feature


def compare_importance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two feature sets side by side, and how each feature's rank moved."""
    f = lambda d, s: d.select("feature", F.col("importance").alias(f"importance_{s}"), F.col("rank").alias(f"rank_{s}"))
    return f(a, "a").join(f(b, "b"), "feature", "full").withColumn("rank_change", F.col("rank_a") - F.col("rank_b"))


def inference_log(decided: DataFrame, context: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the log: critical where the escalation is, elevated where the pattern recurs over two matches or more."""
    r = decided.join(context, list(keys), "left")
    priority = F.when(F.col("escalation") == "critical", "critical").when(F.col("cross_match_recurrence") >= 2, "elevated").otherwise("normal")
    return r.select(*keys, "event_id", priority.alias("priority"), F.coalesce("escalation", F.lit("low")).alias("escalation"), F.col("active").alias("trajectory_state"), "confidence", "loss", "is_anomaly")


def alert_payload(gated: DataFrame, order: tuple[str, ...], attribution: str = "attribution") -> DataFrame:
    """The message of each alert that passed the gate: rounded scores, the five largest attributions, and how many of the
    player's alerts have passed up to it."""
    top = F.transform(top_features(F.col(attribution), 5), lambda x: F.struct(x.feature.alias("feature"), F.round(x.value, 10).alias("shap")))
    n = F.count("*").over(W.partitionBy("player_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    body = F.struct("player_id", F.format_string("p%03d", F.col("player_id")).alias("external_id"), "recommendation_type", F.round("confidence", 4).alias("confidence"), F.round("anomaly_score", 6).alias("anomaly_score"), top.alias("top_features"), "gate_windows")
    return gated.filter("passed").withColumn("gate_windows", n).select("event_id", "player_id", "gate_windows", F.to_json(body).alias("payload"))


def audit_report(audit: DataFrame) -> DataFrame:
    """A line a group of a fairness audit, biased ones first within an attribute, and a verdict a attribute."""
    line = F.format_string("%s=%s: rate %.3f over %d, difference %+.3f%s", F.col("attribute"), F.col("group"), F.col("rate"), F.col("n"), F.col("delta"), F.when(F.col("biased"), " BIASED").otherwise(""))
    w = W.partitionBy("attribute").orderBy(F.col("biased").desc(), F.abs("delta").desc(), "group")
    n = F.count_if("biased").over(W.partitionBy("attribute"))
    return audit.select("attribute", F.row_number().over(w).alias("line_no"), line.alias("line"), F.when(n > 0, "review").otherwise("pass").alias("verdict"))


