"""Small literal cases with values worked out by hand, and folds in plain Python against their relational forms."""

import random

import pytest
from pyspark.sql import functions as F

from pitchflow.functions.thresholds import TeamThresholds
from pitchflow.operators import evaluation, fusion, state, team, telemetry, windows, workload
from pitchflow.sources import readers
from pitchflow.streaming import streams

S = 1_000_000
EVENT = "match_id bigint, event_id bigint, player_id bigint, t_us bigint, team_id string, event_type string"


def events(spark, rows):
    return spark.createDataFrame([(1, i, i % 3, int(t * S), team_id, kind) for i, (t, team_id, kind) in enumerate(rows)], EVENT)


def spans(df):
    return [(r.team_id, r.start_us // S, r.end_us // S, r.outcome) for r in df.orderBy("seq").collect()]


def test_possession_span(spark):
    p = team.possessions(events(spark, [(0, "A", "possession"), (10, "A", "sprint_event"), (15, "A", "acceleration_event"), (20, "A", "jump_event"), (30, "A", "turnover")]))
    row = p.first()
    assert (row.outcome, row.transition_rate, row.physical_load) == ("turnover", 4.0, 6.0)


def test_shot_of_zero_length(spark):
    row = team.possessions(events(spark, [(0, "A", "possession"), (0, "A", "shot")])).first()
    assert (row.attack_activity, row.possession_quality) == (0.0, round(0.5 * 0.85, 4))


def test_other_teams_shot_discards_and_turnover_closes(spark):
    assert spans(team.possessions(events(spark, [(0, "A", "possession"), (5, "B", "shot")]))) == [("B", 5, 5, "shot")]
    assert spans(team.possessions(events(spark, [(0, "A", "possession"), (5, "B", "turnover")]))) == [("A", 0, 0, "neutral"), ("B", 5, 5, "turnover")]


def fold(rows):
    out, cur = [], None
    ordered = sorted(enumerate(rows), key=lambda r: (r[1][0], 0 if r[1][2] in ("shot", "turnover") else 1, r[0]))
    for _, (t, who, kind) in ordered:
        same = cur is not None and cur[0] == who
        if kind == "possession":
            if not same:
                if cur:
                    out.append((*cur, "neutral"))
                cur = [who, t, t]
            else:
                cur[2] = t
        elif kind == "shot":
            start = cur[1] if same else t
            out.append((who, start, t, "shot"))
            cur = None
        elif kind == "turnover":
            if cur and not same:
                out.append((*cur, "neutral"))
            out.append((who, cur[1] if same else t, t, "turnover"))
            cur = None
        elif same:
            cur[2] = t
    if cur:
        out.append((*cur, "neutral"))
    return out


def test_possessions_equal_the_fold(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(rng.randint(0, 60), rng.choice(["A", "B", None]), rng.choice(["possession", "shot", "turnover", "pass", "sprint_event"])) for _ in range(60)]
        assert spans(team.possessions(events(spark, rows))) == fold(rows)


def test_team_state_pressure_and_windows(spark):
    rows = [(1, "A", "turnover"), (2, "A", "possession"), (3, "A", "possession"), (4, "A", "possession"), *[(5 + i, "A", "pass") for i in range(5)], (61, "B", "possession")]
    short = {(r.team_id, r.tick_us // S): r for r in team.team_state(events(spark, rows), 60 * S).collect()}
    assert short["A", 61].possession_pressure == 0.25
    assert short["A", 61].attack_activity == 5.0
    assert ("B", 61) in short and short["B", 61].physical_load == 0


def test_trends_and_insights(spark):
    rows = [(float(i), "A", "pass") for i in range(60)] + [(60.0 + i, "A", "shot") for i in range(1, 61, 2)]
    trends = team.team_trend(team.team_state(events(spark, rows), 60 * S))
    assert trends.count() == 1 and trends.first().attack_trend == "decreasing"
    assert [r.category for r in team.coach_insights(trends, TeamThresholds()).collect()] == ["attack_activity_falling"]


def ticks(spark, rows):
    return spark.createDataFrame([(1, 7, i, int(t * S), v, None, h, x, 0.0) for i, (t, v, h, x) in enumerate(rows)], "match_id bigint, player_id bigint, event_id bigint, t_us bigint, speed_ms double, acceleration_ms2 double, heart_rate_bpm double, x_pitch double, y_pitch double")


def test_distance_skips_ticks_without_place(spark):
    d = telemetry.with_distance_delta(ticks(spark, [(0, 1.0, None, 0.0), (1, 1.0, None, 0.125), (2, 1.0, None, None), (3, 1.0, None, 0.25)])).orderBy("event_id").collect()
    assert [r.distance_delta for r in d] == [0.0, 0.125, 0.0, 0.125]


def test_clean_positions(spark):
    r = telemetry.clean_positions(ticks(spark, [(0, 33.7, 300.0, 1.0), (1, -1.0, 100.0, None)])).orderBy("event_id").collect()
    assert (r[0].speed_ms, r[0].heart_rate_bpm, r[0].issues) == (12.0, None, ["speed_artefact"])
    assert (r[1].speed_ms, r[1].issues, r[1].valid) == (None, ["missing_coordinates", "negative_speed"], False)


def test_accumulator_resets_on_gap(spark):
    w = windows.accumulate_windows(ticks(spark, [(t, 1.0, None, 0.0) for t in (0, 1, 2, 70, 71, 72, 73)]), 4, 4, 61 * S).collect()
    assert [(r.first_event_id, r.last_event_id) for r in w] == [(3, 6)]


@pytest.mark.parametrize("values,want", [([0.0, 0.0, 1.0, 1.0], "increasing"), ([1.0], "stable"), ([2.0, 2.0, 1.0, 1.0], "decreasing")])
def test_half_split(spark, values, want):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "p bigint, i bigint, v double")
    assert workload.half_split_trend(rows, "v", ("p",), ("i",)).orderBy(F.desc("i")).first().trend == want


def test_merged_episodes(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 1, 0, 1, 0, 0, 0, 1])], "p bigint, i bigint, f int")
    got = evaluation.merge_episodes(rows.withColumnRenamed("i", "k"), "f", "p", ("k",))
    assert sorted((r.start, r.end) for r in got.collect()) == [(1, 4), (8, 8)]


def test_few_losses_have_no_threshold(spark):
    rows = spark.createDataFrame([(1, float(i)) for i in range(29)], "p bigint, v double")
    assert evaluation.dynamic_threshold(rows, "p", "v").first().threshold == float("inf")


def test_squad_recalibration():
    assert evaluation.squad_recalibration(0.5, 9, 0.1) is None
    assert evaluation.squad_recalibration(0.5, 20, 0.18) == 0.2
    assert evaluation.squad_recalibration(0.01, 20, 0.03) == 0.01


def test_fusion_claims_each_event_once(spark):
    tracked = events(spark, [(100, "A", "shot"), (103, "A", "shot"), (500, "B", "shot")])
    coach = spark.createDataFrame([(1, 1, 1, 101 * S, "A", "goal"), (2, 1, 1, 101 * S, "A", "shot"), (3, 1, 1, 900 * S, "A", "goal"), (4, 1, 1, 501 * S, "A", "save")], "coach_event_id bigint, match_id bigint, player_id bigint, t_us bigint, team_id string, event_type string")
    rows = fusion.fuse_events(tracked, coach, {"A": "B", "B": "A"}).collect()
    assert sorted((r.t_us // S, r.source, r.shot_outcome) for r in rows) == [(100, "tracked", "GOAL"), (103, "tracked", "MISSED"), (500, "tracked", "SAVED"), (900, "backend", "GOAL")]


def signals(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(p, i, rng.random() < 0.6, rng.random()) for p in range(3) for i in range(40)], "player_id bigint, event_id bigint, active boolean, confidence double")


def streamed(spark, tmp_path, df, fn, parts=3):
    path = str(tmp_path / "in")
    for k in range(parts):
        df.filter(f"event_id div {max(1, 40 // parts + 1)} = {k}").coalesce(1).write.mode("append").parquet(path)
    out = []
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = fn(source).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return out


def test_alert_states_stream_equals_batch(spark, tmp_path):
    df = signals(spark)
    batch = state.alert_states(df, ("player_id",), ("event_id",)).collect()
    out = streamed(spark, tmp_path, df, streams.alert_states)
    key = lambda r: (r.player_id, r.event_id, r.state, r.persistence, r.episode)
    assert sorted(map(key, out)) == sorted(map(key, batch))


def test_accumulator_stream_equals_batch(spark, tmp_path):
    df = ticks(spark, [(t * (1 if t % 9 else 3), 1.0 * t, None, 0.0) for t in range(40)])
    batch = windows.accumulate_windows(df, 4, 2, 8 * S).collect()
    out = streamed(spark, tmp_path, df, lambda s: streams.accumulate_windows(s, 4, 2, 8 * S))
    key = lambda r: (r.first_event_id, r.last_event_id, r.mean_speed)
    assert batch and sorted(map(key, out)) == sorted(map(key, batch))


def test_publish_new_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    a = spark.createDataFrame([(1, "x"), (2, None)], "k bigint, t string")
    streams.publish_new(a, path, ["k", "t"])
    streams.publish_new(a.union(spark.createDataFrame([(3, "y")], a.schema)), path, ["k", "t"])
    assert spark.read.parquet(path).count() == 3
    by_match = spark.createDataFrame([(1, "x"), (2, "z")], "match_id bigint, t string")
    for df in (by_match, by_match.union(spark.createDataFrame([(2, "y")], by_match.schema))):
        streams.publish_new(df, path + "2", ["match_id", "t"], "match_id")
    assert spark.read.parquet(path + "2").count() == 3


def test_readers(spark, tmp_path):
    pos = tmp_path / "positions.csv"
    pos.write_text("ts in ms;mapped id;number;full name;group name;x in m;y in m;speed in m/s;acceleration in m/s2\n1000;1796;5;Ann;SCM;0;0;1;0\n1050;1796;5;Ann;SCM;0.125;0;33.7;0\n1100;1796;5;Ann;SCM;;;1;0\n1100;9;0;Ball;Ball;1;1;1;0\n1150;;1;No Id;SCM;1;1;1;0\n")
    t = readers.read_positions(spark, str(pos)).orderBy("t_us").collect()
    assert [(r.speed_ms, r.issues) for r in t] == [(1.0, []), (12.0, ["speed_artefact"]), (1.0, ["missing_coordinates"])]
    ev = tmp_path / "events.csv"
    ev.write_text("\n".join(["head"] * 13 + ["1000;x;1796;Ann;Pass;5.5;60;1;7;long", "1000;x;1796;Ann;Pass;5.5;60;1;7;long", "1001;x;9;The Ball;Pass;1", "1002;x;3;Bo;Nothing", "bad;x;3;Bo;Pass"]))
    raw = readers.raw_events(spark, str(ev))
    roster = spark.createDataFrame([(1796, "SCM")], "player_id int, team string")
    e = readers.read_tactical_events(raw, roster, "m1").collect()
    assert [(r.event_type, r.team_id, r.metadata["receiving_player_id"]) for r in e] == [("pass", "SCM", "7")] * 2
    assert len({r.event_key for r in e}) == 2
    assert {(r.status, r["count"]) for r in readers.tactical_event_stats(raw).collect()} == {("parsed", 2), ("ball", 1), ("unknown_label", 1), ("error", 1)}
    kinds = {r.file.rsplit("/", 1)[1]: r.kind for r in readers.classify_files(spark, str(tmp_path)).collect()}
    assert kinds == {"positions.csv": "positions", "events.csv": "unsupported"}


def test_telemetry_lines_and_wire(spark):
    lines = spark.createDataFrame([('{"player_external_id": "p1", "ts": "2024-01-01T00:00:00Z", "speed_ms": 3.5}',), ("{bad",), ('{"speed_ms": 1}',)], "value string")
    assert [(r.player_external_id, r.speed_ms) for r in readers.parse_telemetry(lines).collect()] == [("p1", 3.5)]
    df = spark.createDataFrame([(1, 2.5)], "match_id bigint, v double")
    wire = readers.encode_records(df, "state")
    assert readers.decode_records(wire, "state", "match_id bigint, v double").collect() == df.collect()
    assert readers.decode_records(wire, "other", "match_id bigint").count() == 0


def test_gps_fixes(spark):
    lines = spark.createDataFrame([("d", "$GPRMC,120000,A,5200.0000,N,01300.0000,E,10.0,0,010124,,"), ("d", "$GPRMC,120010,A,5200.0060,N,01300.0000,E,,0,010124,,"), ("d", "$GPRMC,120020,V,,,,,,,,,")], "source string, value string")
    a, b = readers.gps_fixes(lines).orderBy("t_s").collect()
    assert a.speed_ms == pytest.approx(5.14444) and b.speed_ms == pytest.approx(1.112, abs=0.01)


def test_upsert_replaces_matches(spark, tmp_path):
    path = str(tmp_path / "ds")
    readers.upsert_matches(spark.createDataFrame([(1, "a"), (2, "b")], "match_id bigint, v string"), path)
    readers.upsert_matches(spark.createDataFrame([(2, "c")], "match_id bigint, v string"), path)
    assert sorted((r.match_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
