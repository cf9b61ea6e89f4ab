"""All thresholds of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Event types that count as physical effort, as attack, and as control of the ball.
PHYSICAL = ("sprint_event", "acceleration_event", "deceleration_event", "change_of_direction", "exertion_event", "impact_event", "jump_event")
ATTACK = ("pass", "shot")
CONTROL = ("possession", "shot", "turnover")
OUTCOME_SCORE = {"GOAL": 1.0, "SAVED": 0.7, "MISSED": 0.4}


@dataclass(frozen=True)
class TeamThresholds:
    full_confidence_events_per_min: float = 10.0
    attack_trend: float = 3.0
    load_trend: float = 8.0
    burden_trend: float = 1.0
    attack_insight: float = 9.0
    load_insight: float = 19.0
    pressure_insight: float = 0.25
    severity_high: float = 2.0
    severity_medium: float = 1.5
    confidence_base: float = 0.4
    confidence_slope: float = 0.2
    quality_high: float = 0.67
    trend_only_confidence: float = 0.5
    turnover_heavy: float = 0.5
    attack_floor: float = 8.0
    attack_ceiling: float = 2.0
    high_quality_possessions: int = 2
    pressure_worsening: float = 0.15
    pressure_improving: float = 0.15
    pressure_stable: float = 0.05


@dataclass(frozen=True)
class TelemetryThresholds:
    max_speed: float = 12.0
    max_accel: float = 25.0
    hr_low: float = 20.0
    hr_high: float = 250.0
    sprint: float = 5.5
    high_intensity: float = 4.17
    pitch_length: float = 40.0
    pitch_width: float = 20.0
    valid_speed: float = 13.5
    valid_accel: float = 12.0
    valid_hr_low: float = 30.0
    valid_hr_high: float = 220.0
    gap_us: int = 5_000_000
    gap_penalty: float = 0.3
    hr_absent_penalty: float = 0.2
    speed_penalty: float = 0.25
    degraded: float = 0.8


@dataclass(frozen=True)
class FindingThresholds:
    hr_high: float = 175.0
    hr_critical: float = 185.0
    recovery_flat: float = 0.02
    z_high: float = 1.5
    z_very_high: float = 2.5
    speed_low: float = 2.5
    acwr_high: float = 1.30
    fatigue_residual: float = 80.0
    speed_drop: float = 15.0
    drift: float = 1.2
    drift_high: float = 1.8
    relevant: float = 0.05
    strong: float = 0.15
    persistence: int = 3
    recurrence: int = 2
    substitute_after: int = 4
    restrict_after: int = 2


TEAM, TELEMETRY, FINDINGS = TeamThresholds(), TelemetryThresholds(), FindingThresholds()
