"""Literal cases of findings, decisions, adaptation, fusion and evaluation, and brute force where SQL has no say."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.operators import decisions, evaluation, findings, fusion, matchday, reports, scoring, state, windows
from pitchflow.sources import payloads, readers
from pitchflow.streaming import streams

FEATURES = "window bigint, window_avg_speed_ms double, window_distance_m double, window_sprint_count double, heart_rate_bpm double, hr_recovery_time_s double, z_distance double, z_sprint_count double, z_top_speed double, z_high_speed_dist double, speed_drop_pct double, fatigue_decay_residual double, acwr double, positional_drift_score double, persistence_windows int, attribution map<string,double>"


def window(spark, attribution, persistence=0, hr_sensor=False, **values):
    names = [c.split()[0] for c in FEATURES.split(", ")]
    row = [{"window": 1, "persistence_windows": persistence, "attribution": attribution, **values}.get(n) for n in names]
    out = findings.semantic_findings(spark.createDataFrame([row], FEATURES), ("window",), hr_sensor=hr_sensor)
    return [(r.finding, r.severity, r.confidence) for r in out.orderBy("rank").collect()]


def test_findings_by_rule(spark):
    assert window(spark, {"heart_rate_bpm": 0.3}, 3, heart_rate_bpm=190.0, hr_recovery_time_s=0.1, window_avg_speed_ms=5.0) == [("cardiovascular_overload", "critical", 0.85)]
    assert window(spark, {"hr_recovery_time_s": 0.15}, heart_rate_bpm=90.0, hr_recovery_time_s=0.1, window_avg_speed_ms=1.0) == [("elevated_cardiovascular_response", "medium", 0.85)]
    assert window(spark, {"hr_recovery_time_s": -0.5}, heart_rate_bpm=90.0, hr_recovery_time_s=0.1, window_avg_speed_ms=1.0) == []  # it pulls the score down
    assert window(spark, {"z_distance": 0.06}, z_distance=1.5, z_top_speed=2.6, window_avg_speed_ms=5.0) == [("locomotor_overload", "high", 0.76)]
    assert window(spark, {"acwr": 0.03}, acwr=1.4, speed_drop_pct=20.0, window_avg_speed_ms=5.0) == []  # nothing backs it
    assert window(spark, {"acwr": 0.06}, acwr=1.4, speed_drop_pct=20.0, window_avg_speed_ms=5.0) == [("fatigue_accumulation", "medium", 0.74), ("recovery_degradation", "medium", 0.72)]
    assert window(spark, {"positional_drift_score": 0.15}, positional_drift_score=1.8, window_avg_speed_ms=5.0) == [("tactical_instability", "high", 0.75)]
    assert window(spark, {"window_avg_speed_ms": 0.1, "window_distance_m": 0.05}, 3, window_avg_speed_ms=0.2, window_distance_m=10.0) == [("locomotor_suppression", "high", pytest.approx(0.72 + 0.2 / 3 + 0.1 / 3))]


def test_degraded_windows_have_no_findings(spark):
    shares, moving = {"positional_drift_score": 0.5}, {"positional_drift_score": 2.0, "window_avg_speed_ms": 3.0}
    assert window(spark, shares, **moving) and window(spark, shares, **moving, heart_rate_bpm=0.0)  # no sensor is worn
    assert window(spark, shares, hr_sensor=True, **moving, heart_rate_bpm=0.0) == []
    assert window(spark, shares, **moving, heart_rate_bpm=25.0) == [] and window(spark, shares, **moving, window_distance_m=-1.0) == []
    assert window(spark, shares, positional_drift_score=2.0, window_avg_speed_ms=0.0, window_distance_m=91.0) == []


def recommend(spark, fs, ss, persistence, recurrence=0, escalation="normal", trend="stable", acwr=1.0):
    row = spark.createDataFrame([(fs, ss, persistence, recurrence, escalation, trend, acwr)], "f array<string>, s array<string>, p int, r int, e string, t string, q double")
    return row.select(findings.recommendation(*[F.col(c) for c in ("f", "s", "p", "r", "e", "t", "q")])).first()[0]


def test_recommendations_in_order(spark):
    assert recommend(spark, ["recovery_degradation"], ["high"], 4, 2, "critical") == "substitute"
    assert recommend(spark, ["recovery_degradation"], ["high"], 3, 2, "critical") == "recovery_intervention"
    assert recommend(spark, ["recovery_degradation"], ["medium"], 3) == "anomaly_flag"
    assert recommend(spark, ["fatigue_accumulation"], ["medium"], 2) == "workload_restriction"
    assert recommend(spark, ["tactical_instability"], ["low"], 2, acwr=1.3) == "workload_restriction"
    assert recommend(spark, ["tactical_instability"], ["low"], 1, acwr=1.3) == "tactical_adjustment"
    assert recommend(spark, ["locomotor_overload"], ["low"], 1, trend="worsening") == "performance_monitor"
    assert recommend(spark, ["locomotor_overload"], ["low"], 1) == "anomaly_flag"


def alerts(spark, signals, **options):
    rows = [(1, i, i, on, c, safe) for i, (on, c, *rest) in enumerate(signals) for safe in [bool(rest and rest[0])]]
    out = state.alert_states(spark.createDataFrame(rows, "player_id bigint, t_us bigint, event_id bigint, active boolean, confidence double, safe boolean"), ("player_id",), ("t_us", "event_id"), **options)
    return [(r.state, r.persistence, r.episode) for r in out.orderBy("event_id").collect()]


def test_hold_begins_no_episode(spark):
    assert alerts(spark, [(False, 0.1), (True, 1.0)]) == [("HOLD", 0, 0), ("HOLD", 1, 0)]
    up, down, lost = (True, 1.0), (False, 1.0), (True, 0.2)
    assert [s for s, _, _ in alerts(spark, [up, up, lost, up, down, down, down, up, up, up])] == ["NONE", "NONE", "HOLD", "HOLD", "HOLD", "HOLD", "NONE", "NONE", "NONE", "WARNING"]
    assert [e for _, _, e in alerts(spark, [up] * 3 + [down] * 3 + [up] * 3)] == [0, 0, 1, 1, 1, 1, 1, 1, 2]
    assert alerts(spark, [up, up, (True, 1.0, True), up], safe_mode="safe") == [("NONE", 1, 0), ("NONE", 2, 0), ("SAFE_MODE", 2, 0), ("WARNING", 3, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_alert_states_equal_the_machine(spark, seed):
    rng = random.Random(seed)
    signals = [(rng.random() < 0.6, rng.choice([1.0, 1.0, 1.0, 0.9, 0.3])) for _ in range(300)]
    level, p, q, e, want = 0, 0, 0, 0, []
    for on, c in signals:
        if c < 0.4:
            level = 4
        elif on:
            p, q = p + 1, 0
            target = 3 if p >= 10 else 2 if p >= 3 else 0
            if target > level:
                e += level == 0
                level = target
        else:
            p, q = 0, q + 1
            level = 0 if q >= 3 else level
        want.append((state.STATES[level], p, e))
    assert alerts(spark, signals) == want


def test_gate_and_families(spark):
    rows = [(1, t, t, f) for t, f in ((0, "a"), (5, "a"), (25, "a"), (26, "b"), (27, "a"), (28, None), (29, "a"))]
    out = state.alert_gate(spark.createDataFrame(rows, "player_id bigint, t_us bigint, event_id bigint, family string"), ("player_id",), ("t_us", "event_id"), 20)
    assert [r.passed for r in out.orderBy("event_id").collect()] == [True, False, True, True, True, False, True]
    names = spark.createDataFrame([("workload_alert",), ("nothing",)], "n string")
    assert [r[0] for r in names.select(state.alert_family(F.col("n"))).collect()] == ["workload_instability", None]


def test_ema_over_a_long_history(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=1000).round(3).tolist()
    on = (rng.random(1000) < 0.7).tolist()
    df = spark.createDataFrame([(1, i, v, o) for i, (v, o) in enumerate(zip(values, on, strict=True))], "k int, i int, v double, o boolean")
    for held in (False, True):
        s, want = None, []
        for v, o in zip(values, on, strict=True):
            s = s if held and not o else v if s is None else 0.25 * v + 0.75 * s
            want.append(s)
        got = [r.ema for r in windows.ema(df, "v", ("k",), ("i",), update_if=F.col("o") if held else None).orderBy("i").collect()]
        assert [x if x is None else pytest.approx(x, abs=1e-12) for x in want] == got


def test_trend_signal_equals_polyfit(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 8) for _ in range(70)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    for i, r in enumerate(windows.trend_signal(df, "v", ("k",), ("i",)).orderBy("i").collect()):
        y = values[max(0, i - 49) : i + 1]
        assert r.slope == pytest.approx(np.polyfit(range(len(y)), y, 1)[0] if len(y) >= 4 else 0, abs=1e-8)
        assert r.curvature == pytest.approx(np.polyfit(range(len(y)), y, 2)[0] if len(y) >= 6 else 0, abs=1e-8)


def test_quantiles_and_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 3000).tolist() + rng.normal(10, 5, 2000).tolist() + [None] * 5
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.8, 0.995, 1.0)
    assert evaluation.quantiles(df, "x", shares).first().q == pytest.approx(np.quantile([v for v in values if v is not None], shares).tolist())
    labels = rng.integers(0, 2, 4000)
    scores = (labels * 0.3 + rng.normal(size=4000)).round(2)
    got = evaluation.auc(spark.createDataFrame([(float(s), int(l)) for s, l in zip(scores, labels, strict=True)], "score double, label int")).first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got.roc_auc == pytest.approx(want, abs=1e-8)


def brute_adaptation(rows, quarantine, cooldown, drift, cap, rise=0.2, fall=0.5, most=3):
    def ks(a, b):
        return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)

    def threshold(values):
        cut = np.quantile(values, 0.95)
        return float(np.quantile([v for v in values if v <= cut], 0.995))

    active, waiting, prior, last, ups, version, out = [], [], None, None, 0, 0, []
    for event, t, loss, confidence in rows:
        if active and loss > 5 * np.median(active):
            continue
        waiting.append((loss, confidence))
        if len(waiting) < quarantine or (last is not None and t - last < cooldown):
            continue
        healthy, accepted = [v for v, c in waiting if c >= 0.7], False
        waiting = []
        if healthy and (not active or ks(active, healthy) <= drift):
            new = threshold((active + healthy)[-cap:])
            if prior is None or (prior * (1 - fall) <= new <= prior * (1 + rise) and not (new > prior and ups >= most)):
                active = (active + healthy)[-cap:]
                ups = ups + 1 if prior is not None and new > prior else 0
                prior, version, last, accepted = new, version + 1, t, True
        out.append((event, version, None if prior is None else round(prior, 9), accepted))
    return out


def test_threshold_adaptation(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        loss = rng.lognormvariate(0, 0.4) * (1 + i / 600) * (9 if rng.random() < 0.02 else 1)
        rows.append((i, i * 10, round(loss, 6), rng.choice([0.9, 0.8, 0.5])))
    df = spark.createDataFrame([(1, *r) for r in rows], "player_id bigint, event_id bigint, t_us bigint, loss double, confidence double")
    out = decisions.adapt_thresholds(df, quarantine=20, cooldown_us=300, drift=0.3, cap=100).orderBy("event_id").collect()
    got = [(r.event_id, r.version, None if r.threshold is None or math.isnan(r.threshold) else r.threshold, r.adapted) for r in out]
    assert got == brute_adaptation(rows, 20, 300, 0.3, 100) and any(a for *_, a in got) and not all(a for *_, a in got)


def test_fusion_claims(spark):
    tracked = spark.createDataFrame([(1, 1, 100, "A", "shot", 7), (2, 1, 104, "A", "shot", 7), (3, 2, 101, "A", "shot", 7), (4, 1, 103, None, "shot", 7), (5, 1, 500, "B", "shot", 8)], "event_id bigint, match_id bigint, t_us bigint, team_id string, event_type string, player_id bigint")
    coach = spark.createDataFrame([(1, 1, 101, "A", "goal", 7), (2, 1, 101, "A", "goal", 7), (3, 1, 102, "A", "shot", 7), (4, 1, 498, "A", "save", 9), (5, 1, 100, "A", "timeout", None), (6, 3, 101, "A", "goal", 7)], "coach_event_id bigint, match_id bigint, t_us bigint, team_id string, event_type string, player_id bigint")
    out = fusion.fuse_events(tracked, coach, {"A": "B", "B": "A"}, 5).collect()
    assert {r.event_id: r.shot_outcome for r in out if r.source == "tracked"} == {1: "GOAL", 2: "GOAL", 3: None, 4: None, 5: "SAVED"}
    assert sorted((r.match_id, r.coach_event_id, r.shot_outcome) for r in out if r.source == "backend") == [(1, 3, "MISSED"), (3, 6, "GOAL")]
    no_opponent = fusion.fuse_events(tracked, coach, {}, 5).collect()
    assert {r.event_id: r.shot_outcome for r in no_opponent if r.event_id == 5} == {5: None}


def test_normaliser_fits_each_player(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 10.0), (2, 30.0), (3, 5.0), (3, 5.0), (4, None)], "player_id int, x double")
    fitted = evaluation.normaliser(df, ("x",), ("player_id",))
    z = sorted((r.player_id, r.x) for r in evaluation.normalised(df, fitted, ("x",), ("player_id",)).collect())
    assert z == [(1, -1.0), (1, 1.0), (2, -1.0), (2, 1.0), (3, 0.0), (3, 0.0), (4, 0.0)]


def test_kmeans_background_has_no_more_centres_than_rows(spark):
    rows = spark.createDataFrame([(float(i % 3), float(i % 3), 0.0) for i in range(9)], "mean_speed double, max_speed double, distance double")
    out = scoring.kmeans_background(rows, 5, ("mean_speed", "max_speed", "distance"))
    assert sorted(r.mean_speed for r in out.collect()) == [0.0, 1.0, 2.0]
    assert scoring.kmeans_background(rows.limit(1), 5, ("mean_speed", "max_speed", "distance")).count() == 1


def test_rosters_and_positions(spark, tmp_path):
    path = tmp_path / "statistics.csv"
    path.write_text("Player ID;Name;Position;Group name;Session ID;Description\n7;Ann;RM;Own;1;d\n8; ;XY;Other;1;d\n9;Ball;;Ball;1;d\nx;No;TW;Own;1;d\n", encoding="latin1")
    out = {r.player_id: (r.name, r.position, r.team) for r in readers.read_roster(spark, str(path), "Own").collect()}
    assert out == {7: ("Ann", "centre_back", "Own"), 8: (None, "xy", "Other")}


def test_timeline_shows_empty_segments(spark):
    rows = [(1, p, float(e), 1.0, 0.0, v, 0.0, v) for p, e, v in ((1, 0, 5.0), (2, 60, 7.0), (3, 899, 6.0), (4, 10, 0.0), (5, 30, 1.0), (1, 6000, 9.0))]
    out = {r.segment: r for r in matchday.match_timeline(spark.createDataFrame(rows, "match_id bigint, player_id bigint, elapsed_s double, acceleration_load double, deceleration_load double, sprint_load double, high_intensity_load double, distance_covered double")).collect()}
    assert len(out) == 6 and out["0-15"].n_players == 5 and out["0-15"].sprint_load == 19.0 and "sprint_load:2,3,1;" in out["0-15"].leaders
    assert out["75-90"].n_players == 0 and out["75-90"].sprint_load == 0.0


def test_payloads(spark):
    raw = spark.createDataFrame([('{"id": "m1", "timeline": [{"time": "2024-01-01T10:00:00", "type": "goal", "competitor": {"id": "7"}}, {"type": "foul", "competitor": {}}, {"time": "x", "type": "card", "competitor": {"id": "8"}}]}', "", "2024-02-02 00:00:00")], "value string, topic string, r string").withColumn("received", F.to_timestamp("r"))
    out = payloads.json_observations(raw, "timeline").orderBy("player_external_id").collect()
    assert [(r.player_external_id, r.match_id, r.event_type, r.ts.year, r.ts.month) for r in out] == [("7", "m1", "goal", 2024, 1), ("8", "m1", "card", 2024, 2)]
    ws = spark.createDataFrame([('{"player_id": "7", "ts": "2024-01-01T10:00:00Z", "speed_ms": 3.5, "heart_rate": 120}',), ("no json",), ('{"player_id": ""}',), ('{"player_id": "9", "speed_ms": -1}',), ('{"player_id": "9", "heart_rate": 300}',)], "value string").withColumn("received", F.current_timestamp())
    assert [(r.player_external_id, r.speed_ms, r.heart_rate_bpm) for r in payloads.json_observations(ws, "ws").collect()] == [("7", 3.5, 120)]
    sensor = spark.createDataFrame([("a/sensors/7/hr", '{"value": 99}'), ("a/sensors/7/accel", '{"value": 1.5}'), ("short", '{"value": 1}'), ("a/s/8/hr", "{")], "topic string, value string").withColumn("received", F.current_timestamp())
    assert sorted((r.player_external_id, r.heart_rate_bpm or 0, r.acceleration_ms2 or 0.0) for r in payloads.json_observations(sensor, "sensor").collect()) == [("7", 0, 1.5), ("7", 99, 0.0)]


def test_tables_of_a_folder(spark, tmp_path):
    for name in payloads.TABLES[:-1]:
        (tmp_path / f"{name}.csv").write_text("id,ts\n1,2024-01-01T00:00:00\n2,never\n")
    with pytest.raises(FileNotFoundError, match="ground_truth_labels"):
        payloads.load_tables(spark, str(tmp_path))
    (tmp_path / "ground_truth_labels.csv").write_text("session_id,label\n1,true\n")
    out = payloads.load_tables(spark, str(tmp_path))
    assert set(out) == set(payloads.TABLES) and [r.ts is None for r in out["events"].orderBy("id").collect()] == [False, True]


def test_metadata_and_issues(spark):
    names = ["file", "Session ID", "Group name", "Player ID", "Description", "Session begin (Local timezone)", "Session end (Local timezone)"]
    rows = [("f", "5", "Own", "1", '"Own vs. Guests"', "1/2/2024 3:04:05 PM", "1/2/2024 5:00:00 PM"), ("f", "5", "Guests", "2", None, None, None), ("f", "5", "Ball", "3", None, None, None), ("g", "5", "Own", "1", "Training", None, None), ("g", "6", "Own", "4", "Training", None, None)]
    out = {r.file: r for r in payloads.statistics_metadata(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)), "Own").collect()}
    assert (out["f"].session_id, out["f"].n_players, out["f"].n_own, out["f"].n_opponent, out["f"].team, out["f"].opponent, out["f"].begin.hour) == (5, 2, 1, 1, "Own", "Guests", 15)
    assert (out["g"].session_id, out["g"].team, out["g"].opponent, out["g"].roster) == (None, "Training", "", ["1", "4"])
    players = spark.createDataFrame([("m", 1, 5), ("m", 2, 6)], "match_id string, player_id int, session_id int")
    ticks = spark.createDataFrame([("m", 1, 10), ("m", 3, None), ("n", 1, 5)], "match_id string, player_id int, ts_ms long")
    events = spark.createDataFrame([("m", 1, 10, True)], "match_id string, player_id int, ts_ms long, malformed boolean")
    issues = payloads.match_issues(players, ticks, events)
    assert sorted((r.match_id, r.level, r.issue, r.n) for r in issues.collect()) == [("m", "warning", "malformed rows", 1), ("m", "warning", "not in roster", 1), ("m", "warning", "several session ids", 2), ("m", "warning", "unread tick times", 1), ("m", "warning", "without ticks", 1), ("n", "error", "no events", 1), ("n", "error", "no players", 1), ("n", "warning", "not in roster", 1)]
    reports = payloads.dataset_reports(spark.createDataFrame([("m", "d1"), ("n", "d2"), ("n", "d3"), ("o", "d4")], "match_id string, match_dir string"), issues)
    assert tuple(reports["summary"].first()) == (3, 1, 2, 1) and reports["quality"].count() == 2
    files = spark.createDataFrame([("m", "a", "a/x.csv", 1, 1), ("m", "b", "b/x.csv", 9, 9), ("n", "c", "c/x.csv", 2, 2)], "match_id string, match_dir string, path string, length long, modified long")
    first = payloads.changed_matches(files, spark.createDataFrame([], "match_id string, fingerprint string"))
    assert sorted((r.match_id, r.match_dir) for r in first.collect()) == [("m", "a"), ("n", "c")]
    assert [r.match_id for r in payloads.changed_matches(files.replace(1, 7, "length"), first).collect()] == ["m"]


def test_wire_rejects(spark):
    kinds = {"tick": "player_id int, speed double"}
    wire = readers.encode_records(spark.createDataFrame([(1, 2.5, "m")], "player_id int, speed double, match_id string"), "tick")
    bad = spark.createDataFrame([("2", "tick", "m", "{}"), ("1", "other", "m", "{}"), ("1", "tick", "m", "{no"), ("1", None, "m", "{}")], "schema_version string, type string, match_id string, payload string")
    assert sorted(r.reason for r in readers.rejected_records(wire.union(bad), kinds).collect()) == ["malformed payload", "unknown type", "unknown type", "unknown version"]
    assert [tuple(r) for r in readers.decode_records(wire.union(bad), "tick", kinds["tick"]).collect()] == [(1, 2.5)]


def test_replay_and_match_state(spark, tmp_path):
    e = spark.createDataFrame([(7, 2.0, "b", None), (7, 1.0, "a", 1.5), (8, 1.0, "a", 2.5), (9, 1.0, "a", 2.5), (7, 99.0, "z", 1.0)], "player_id int, elapsed_seconds double, ts string, speed double")
    readers.replay_export(e, str(tmp_path / "replay"), ["p007", "p008"], 50.0)
    lines = [line for f in sorted((tmp_path / "replay").glob("part*")) for line in f.read_text().splitlines()]
    assert ['"speed":null' in x for x in lines] == [False, False, True] and '"player_external_id":"p008"' in lines[1]
    for i in range(3):
        rows = [(1, i * 40 + k, float(k + i), k % 3 == 0, None if k % 2 else 100.0 + k, k % 2) for k in range(40)]
        spark.createDataFrame(rows, "player_id bigint, event_id bigint, score double, alert boolean, heart_rate double, sprints int").coalesce(1).write.mode("append").parquet(str(tmp_path / "scored"))
    out = str(tmp_path / "state")
    streams.match_state(readers.replay_source(spark, str(tmp_path / "scored"))).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    got = {r.event_id: r for r in spark.read.parquet(out).collect()}
    last = got[119]
    assert len(got) == 120 and (last.n_windows, last.n_alerts, last.peak_score, last.peak_hr, last.sprints, len(last.recent_scores)) == (120, 42, 41.0, 138.0, 60, 50)
    assert last.recent_scores[-1] == 41.0 and last.consecutive_alerts == 1 and last.mean_score == pytest.approx(20.5)


def test_publishing_by_topic(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        for q in streams.publish({"trends": readers.replay_source(spark, str(tmp_path / "in"), 9)}, str(tmp_path / "out"), str(tmp_path / "c"), {"trends": ["id"]}):
            q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/trends")).collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        streams.publish({"nothing": None}, "", "", {})


def test_signals_wait_for_the_alert_machine(spark):
    """An anomaly is a signal from the third window in a row on, and until three quiet ones; fatigue only late."""
    losses = [9, 9, 0, 9, 9, 9, 0, 0, 9, 0, 0, 0, 0]
    rows = [(f"w{k:02d}", 1, float(v), 5.0, 0.9, 1.0 if v else 9.0, 1, 1700 + 30 * k) for k, v in enumerate(losses)]
    scored = spark.createDataFrame(rows, "window string, player_id bigint, smoothed double, threshold double, confidence double, speed_ms double, sprint_flag int, elapsed_s bigint")
    context = spark.createDataFrame([(1, 18000.0, 0.0, False, 1.0)], "player_id bigint, distance_mean double, drift_score double, drift_flagged boolean, acwr double")
    out = {r.window: r for r in decisions.score_decisions(scored, context, "window").collect()}
    assert [k for k in range(13) if out[f"w{k:02d}"].is_anomaly] == [5, 6, 7, 8, 9, 10]
    assert [out[f"w{k:02d}"].persistence for k in range(7)] == [1, 2, 0, 1, 2, 3, 0]
    # seconds over 1800 begin with the fifth window: fatigue is up in 4 and 5 only, so never an alert
    assert not any(r.fatigue_flag or r.workload_flag for r in out.values())
    assert [(x.category, x.subtype, x.severity) for x in out["w06"].signals] == [("anomaly", None, "high")]


def test_salience_by_the_fixed_weights(spark):
    rows = [(1, 1, "x", 10, "worsening", "critical", "resolved"), (1, 2, "y", 20, "stable", "high", "persisted"), (1, 3, "x", 30, "stable", "low", "unknown"), (1, 4, "z", 40, "worsening", "medium", "escalated")]
    e = spark.createDataFrame(rows, "player_id int, episode int, finding string, end_minute int, trend string, severity string, response string")
    got = [(r.rank, r.episode, r.salience) for r in reports.salient_episodes(e, "x", 4, trend="worsening").orderBy("rank").collect()]
    assert got == [(1, 1, 13.0), (2, 3, 7.5), (3, 2, 4.75), (4, 4, 4.25)]


def test_alert_texts(spark):
    schema = "recommendation string, confidence double, player_name string, workload_status string, findings array<struct<finding_type:string,summary:string>>, contributions array<struct<label:string,value:string,effect:double>>"
    rows = [
        ("substitution", 0.876, "Kay", "high_risk", [("cardio_strain", "Heart rate stays high."), ("locomotor_overload", "x"), ("tactical_drift", "y"), ("z", "z")], None),
        ("unheard_of", 0.29, "Lou", "optimal", [("cardio_strain", "Heart rate stays high.")], None),
        ("workload_warning", 0.5, "Max", "low_readiness", None, [("Speed", "4.1 m/s", 0.2), ("Heart rate", "150", -0.1), ("Drift", "2", 0.1), ("a", "1", -1.0), ("b", "2", -1.0), ("late", "9", 5.0)]),
        (None, None, None, None, [], []),
    ]
    got = [r.summary for r in matchday.alert_summary(spark.createDataFrame(rows, schema)).collect()]
    end = "Analysis is based on this player's own historical data, not squad averages."
    assert got == [
        f"Consider substituting Kay (confidence: 87%). Heart rate stays high. Additional signals: locomotor overload, tactical drift. Acute workload significantly exceeds chronic baseline — elevated injury risk. {end}",
        f"Performance anomaly — Lou (confidence: 28%). Heart rate stays high. {end}",
        f"Workload warning for Max (confidence: 50%). Primary anomaly contributors: Speed (4.1 m/s); Drift (2). Anomaly-dampening signals: Heart rate (150); a (1). Recent load is below chronic baseline — reduced physical readiness. {end}",
        f"Performance anomaly —  (confidence: 0%). {end}",
    ]
