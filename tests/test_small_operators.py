"""Literal cases of small operators."""

import json

from pyspark.sql import functions as F

from pitchflow.functions.thresholds import TELEMETRY
from pitchflow.operators import matchday, reports, scoring, telemetry, workload
from pitchflow.sources import payloads, readers
from pitchflow.streaming import streams

TICK = "match_id int, player_id int, event_id int, t_us bigint, speed_ms double"


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return tuple(df.select(*columns).first())


def test_metres_to_the_pitch(spark):
    x, y = telemetry.normalise_coords(F.col("x"), F.col("y"))
    assert one(spark, x, y, x=0.0, y=0.0) == (50.0, 50.0)
    assert one(spark, x, y, x=TELEMETRY.pitch_length / 2, y=-TELEMETRY.pitch_width) == (100.0, 0.0)
    df = spark.createDataFrame([(None, 3.0)], "x double, y double").select(x, y)
    assert tuple(df.first()) == (50.0, 50.0)


def test_fixes_to_the_pitch(spark):
    x, y = telemetry.gps_to_pitch(F.col("lat"), F.col("lon"), 52.0, 11.0, 100.0, 50.0)
    assert one(spark, x, y, lat=52.0, lon=11.0) == (0.0, 0.0)
    got = one(spark, x, y, lat=52.0 + 25 / 111_194.9266, lon=11.0 + 50 / (111_194.9266 * 0.615661475))
    assert abs(got[0] - 50) < 0.02 and abs(got[1] - 50) < 0.02
    assert one(spark, x, y, lat=60.0, lon=5.0) == (0.0, 100.0)


def test_ownership_and_confidence(spark):
    of = telemetry.classify_ownership(F.col("g"), "us")
    assert [one(spark, of, g=g)[0] for g in ("Ball", "us", "them")] == ["BALL", "OWN", "OPPONENT"]
    replay, live = telemetry.effective_confidence(F.col("c"), True), telemetry.effective_confidence(F.col("c"), False)
    assert one(spark, replay, live, c=0.5) == (0.8, 0.5) and one(spark, replay, live, c=0.9) == (0.9, 0.9)


def test_counterfactual_names_the_largest_effect(spark):
    m = F.create_map(F.lit("a"), F.lit(-2.0), F.lit("b"), F.lit(0.25))
    assert "b" in one(spark, scoring.counterfactual(m))[0] and "0.250" in one(spark, scoring.counterfactual(m))[0]
    assert one(spark, scoring.counterfactual(m, 0.5))[0] is None


def test_baselines_fall_back(spark):
    h = spark.createDataFrame([(1, 10.0, 7)], "player_id int, distance_mean double, n_sessions int")
    p = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 6)], "player_id int, distance_mean double, n_windows int")
    got = sorted((r.player_id, r.distance_mean, r.basis, r.n_sessions, r.n_windows) for r in workload.baseline_with_fallback(h, p).collect())
    assert got == [(1, 10.0, "historical", 7, None), (2, 2.0, "provisional", None, 6)]


def test_names_from_ticks(spark):
    roster = spark.createDataFrame([(1, None), (2, "B"), (3, None)], "player_id int, name string")
    ticks = spark.createDataFrame([(1, 9, "late", 4), (1, 5, "A", 7), (1, 1, None, 8), (2, 1, "x", 2)], "player_id int, t_us bigint, name string, jersey int")
    got = sorted((r.player_id, r.name, r.jersey) for r in readers.backfill_roster(roster, ticks).collect())
    assert got == [(1, "A", 7), (2, "B", 2), (3, None, None)]


def test_long_events(spark):
    raw = spark.createDataFrame([(3, 5, 1, "n", "Pass", ["5", "x", "1", "n", "Pass", "v1", "", "v3"])], "line int, ts_ms bigint, player_id int, name string, label string, slots array<string>")
    r = readers.events_long(raw).first()
    assert (r.line, r.label, r.value_1, r.value_2, r.value_3, r.value_4) == (3, "Pass", "v1", None, "v3", None)


def test_metadata_of_tracks(spark):
    rows = spark.createDataFrame([("f", 1000, 1), ("f", 3000, 2), ("f", None, 3), ("g", 5000, 1)], "file string, ts_ms bigint, player_id int")
    got = {r.file: ((r.end - r.begin).total_seconds(), r.n_players, r.roster) for r in payloads.track_metadata(rows).collect()}
    assert got == {"f": (2.0, 2, ["1", "2"]), "g": (0.0, 1, ["1"])}


def test_reports_are_written(spark, tmp_path):
    payloads.write_reports({"a": spark.range(3).select("id"), "b": spark.createDataFrame([("x",)], "name string")}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "a")).count() == 3 and spark.read.json(str(tmp_path / "b")).first().name == "x"


def test_faults_depend_on_the_tick_alone(spark):
    rows = [(1, p, k, k * 1_000_000, 1.0 + k % 7) for p in (1, 2) for k in range(400)]
    df = spark.createDataFrame(rows, TICK)
    a, b = ({(r.player_id, r.event_id): (r.fault, r.speed_ms) for r in telemetry.inject_faults(d, 4).collect()} for d in (df, df.repartition(7)))
    assert a == b and {f for f, _ in a.values()} == {None, "dropout", "freeze", "spike"}
    for (p, k), (fault, speed) in a.items():
        was = 1.0 + k % 7
        want = {None: was, "dropout": None, "spike": 3 * was, "freeze": 1.0 + (k - 1) % 7 if k else was}[fault]
        assert speed == want, (p, k)
    share = sum(f is not None for f, _ in a.values()) / len(a)
    assert 0.06 < share < 0.2


def test_lines_and_ids_as_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("not json\n" + json.dumps({"player_id": 1}) + "\n")
    stream = readers.read_telemetry_stream(spark, str(tmp_path / "in"))
    assert stream.isStreaming and stream.columns == readers.parse_telemetry(spark.read.text(str(tmp_path / "in"))).columns
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:06")]
    spark.createDataFrame(rows, "event_id int, t string").select("event_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema("event_id int, ts timestamp").parquet(str(tmp_path / "ev"))
    out = str(tmp_path / "out")
    streams.dedupe(source).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(out).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_hulls_of_teams(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (2.0, 1.0), (2.0, 0.0), (None, 1.0)]
    rows = [(1, 5, x, y) for x, y in square] + [(1, 6, float(k), 2.0 * k) for k in range(5)] + [(2, 5, x, y) for x, y in square[:3]] + [(None, 5, x, y) for x, y in square[:4]]
    df = spark.createDataFrame(rows, "team int, tick int, x_pitch double, y_pitch double")
    assert sorted((repr(r.team), r.tick, r.n_players, r.area) for r in reports.team_hulls(df, ("team", "tick")).collect()) == [("1", 5, 6, 12.0), ("None", 5, 4, 12.0)]
    rng = __import__("random").Random(1)
    points = {(rng.random(), rng.random()) for _ in range(40)}
    inside = lambda p, hull: all((b[0] - a[0]) * (p[1] - a[1]) >= (b[1] - a[1]) * (p[0] - a[0]) for a, b in hull)
    edges = [(a, b) for a in points for b in points if a != b and inside(a, [(a, b)]) and all(inside(p, [(a, b)]) for p in points)]
    assert abs(reports.hull_area(points) - sum(a[0] * b[1] - b[0] * a[1] for a, b in edges) / 2) < 1e-12
    assert reports.hull_area(set()) == reports.hull_area({(1.0, 1.0)}) == 0


def test_jitter_moves_places_a_little(spark):
    rows = [(1, p, k, k * 1_000_000, 1.0, 50.0, 99.9) for p in range(5) for k in range(200)]
    df = spark.createDataFrame(rows, TICK + ", x_pitch double, y_pitch double")
    out = telemetry.inject_faults(df, 4, jitter=0.3).collect()
    x = [r.x_pitch - 50 for r in out if r.fault != "dropout"]
    mean = sum(x) / len(x)
    assert abs(mean) < 0.04 and 0.26 < (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5 < 0.34
    assert all(r.x_pitch == 50.0 and r.y_pitch == 99.9 for r in out if r.fault == "dropout") and all(r.y_pitch <= 100 for r in out)
    assert {r.ts_jitter_s for r in out} == {-2, -1, 0, 1, 2}
    assert [r.fault for r in out] == [r.fault for r in telemetry.inject_faults(df, 4).collect()]


STATS = "match_id int, player_id int, description string, begin_us bigint, distance_m double, sprints double, accelerations double, decelerations double, distance_high_m double, distance_very_high_m double, time_on_field_s double, position string, team string, ownership string"
WHOLE = [(1, 1, "A vs. B", at, d, 1.0, 1.0, 1.0, d, None, d, pos, "A", "OWN") for at, d, pos in ((5, 9.0, "back"), (3, 7.0, "wing"), (3, 7.0, None), (4, 1.0, "keeper"))]
HALVES = [(1, 2, d, at, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, pos, "A", own) for d, at, pos, own in (("half 1", 5, "back", "OWN"), ("half 1", 3, "wing", "OPPONENT"), ("half 1", 3, "keeper", "OPPONENT"), ("half 0", 1, None, None), (None, 0, "none", None))]


def test_roster_of_repeated_sessions(spark):
    """Sessions and halves of equal descriptions: the earliest counts, then figures, whatever the order of the rows."""
    for rows in (WHOLE + HALVES, (WHOLE + HALVES)[::-1]):
        got = matchday.match_roster(spark.createDataFrame(rows, STATS)).select("player_id", "position", "time_on_field_s").orderBy("player_id").collect()
        assert list(map(tuple, got)) == [(1, None, 7.0), (2, "keeper", 10.0)]


def test_metrics_of_repeated_sessions(spark):
    loads = spark.createDataFrame([], "match_id int, player_id int, " + ", ".join(f"{c} double" for c in matchday.LOADS))
    for rows in (WHOLE + HALVES, (WHOLE + HALVES)[::-1]):
        got = matchday.player_match_metrics(spark.createDataFrame(rows, STATS), loads).select("player_id", "ownership", "distance_m").orderBy("player_id").collect()
        assert list(map(tuple, got)) == [(1, "OWN", 7.0), (2, "OPPONENT", 10.0)]


def test_half_split_change_of_exactly_the_band(spark):
    """2.1 after 2.0 is a change of 0.05, not of more, whatever the last bits of doubles say."""
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.1), (2, 1, 2.0), (2, 2, 2.100001)], "p int, i int, v double")
    got = workload.half_split_trend(rows, "v", ("p",), ("i",)).filter("i = 2").orderBy("p").collect()
    assert [r.trend for r in got] == ["stable", "increasing"]


def test_rolling_change_of_exactly_the_band(spark):
    """2.1 against 2.0 is a change of 0.05, not of more, whatever the last bits of doubles say; means are half up."""
    rows = spark.createDataFrame([(1, m, 2.1 if m else 1.5) for m in range(6)] + [(2, 1, 0.000001), (2, 2, 0.000002)], "player_id int, match_id int, v double")
    got = {r.player_id: r for r in workload.rolling_metrics(rows, ("v",)).withColumn("f", workload.figure("season")).collect()}
    assert got[1].trend == "stable" and got[2].f == 0.000002
