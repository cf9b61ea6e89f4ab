"""Streams in order of event time: late and repeated rows, idle keys, match state over restarts, ticked publishing."""

import random
import shutil
from collections import defaultdict

import pytest

from pitchflow.operators import state, windows
from pitchflow.streaming import ordered, ticked

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
S = 1_000_000


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def feed(spark, folder, schema, batches, run):
    """Runs `run` after each batch lands as one file: every call is a restart from the checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(schema).parquet(f"{folder}/in"))


def collect(spark, folder, schema, batches, keys, logic, **options):
    def run(source):
        q = ordered.in_order(source, keys, logic, **options).writeStream.option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
        q.awaitTermination(120)

    feed(spark, folder, schema, batches, run)
    return spark.read.parquet(f"{folder}/out").collect()


TICK = "player_id bigint, t_us bigint, event_id bigint, speed_ms double, session_id bigint"


def test_shuffled_ticks_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(120):
        t += rng.choice([1, 2, 3, 20]) * S
        rows.append((i % 2, t, i, float(rng.randrange(9)), 1))
    shuffled = [rows[a : a + 40] for a in (0, 40, 80)]
    held = [shuffled[0].pop(k) for k in (30, 31)]  # come 2 batches later: late
    for b in shuffled:
        rng.shuffle(b)
    again, other = shuffled[1][5], (*shuffled[1][6][:3], 99.0, 1)
    batches = [shuffled[0], [*shuffled[1], again, other], [*shuffled[2], *held], [(7, 10**12, 999, 0.0, 1)]]
    got = collect(spark, str(tmp_path), TICK, batches, ("player_id",), ordered.Windows(4, 2, 15 * S), delay="5 seconds", idle_ms=10_000)
    kinds = defaultdict(int)
    for r in got:
        kinds[r.kind] += 1
    assert kinds["late"] == 2 and kinds["repeat"] == 1 and kinds["conflict"] == 1
    assert sorted(r.event_id for r in got if r.kind == "late") == sorted(h[2] for h in held)
    df = spark.createDataFrame([(1, *r[:4]) for r in rows if r not in held], "match_id bigint, player_id bigint, t_us bigint, event_id bigint, speed_ms double")
    want = windows.accumulate_windows(df, 4, 2, 15 * S).collect()
    key = lambda r: (r.first_event_id, r.last_event_id, r.start_us, r.end_us, r.mean_speed)
    assert len(want) > 5 and sorted(key(r) for r in got if r.kind == "row") == sorted(map(key, want))


SIGNAL = "player_id bigint, alert_type string, t_us bigint, event_id bigint, active boolean, confidence double, safe_mode boolean"


def test_alerts_by_type_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 2, "ab"[i % 3 % 2], i * S, i, rng.random() < 0.7, rng.random(), rng.random() < 0.05) for i in range(120)]
    mixed = [rows[:60], rows[60:]]
    for b in mixed:
        rng.shuffle(b)
    got = collect(spark, str(tmp_path), SIGNAL, [*mixed, [(9, "z", 10**12, 999, False, 1.0, False)]], ("player_id", "alert_type"), ordered.Alerts(), delay="5 seconds")
    want = state.alert_states(spark.createDataFrame(rows, SIGNAL), ("player_id", "alert_type"), ("t_us", "event_id"), safe_mode="safe_mode").collect()
    key = lambda r: (r.event_id, r.state, r.persistence, r.episode)
    assert sorted(key(r) for r in got if r.kind == "row") == sorted(map(key, want))


SCORED = "player_id bigint, t_us bigint, event_id bigint, score double, telemetry_confidence double, speed_ms double, heart_rate double, hr_recovery double, alert string, episode bigint, finding string, severity string, confidence double"


def scored(n, seed):
    rng = random.Random(seed)
    return [
        (k % 3, k * 20 * S, k, round(rng.random(), 3), rng.choice([0.5, 0.9, 1.0]), rng.choice([3.0, 8.0]), rng.choice([None, 150.0, 160.0 + k]), 0.0, rng.choice([None, "fatigue_alert", "workload_alert", "anomaly_flag"]), rng.choice([None, 1, 2]), rng.choice([None, "x", "y"]), rng.choice(["low", "high", None]), rng.choice([None, 0.3, 0.6, 0.63, 0.9]))
        for k in range(n)
    ]


def fold(rows):
    """A player's state step by step, after each row."""
    out, scores, total, finds, moves, last_ep, last_alert, run, first, clean, risk, pattern, times = [], [], [], [], defaultdict(int), None, "", 0, None, 0, 0, "", 0
    counts, hr, sprints, trusted = defaultdict(int), 0.0, 0, 0
    for _, t, i, score, sure, speed, beat, _, alert, ep, kind, sev, conf in rows:
        if sure >= 0.8:
            trusted += 1
            total.append(score)
            scores = (scores + [score])[-50:]
            hr, sprints = max(hr, beat or 0.0), sprints + (speed >= 7)
        label = None
        if kind is not None:
            now = (kind, {"high": 2}.get(sev, 0), 0.5 if conf is None else conf, t // (60 * S))
            if finds and 0 <= now[3] - finds[-1][3] <= 3 and now[2] >= 0.55 and finds[-1][2] >= 0.55:
                moves[f"{finds[-1][0]}>{kind}"] += 1
            prev = [f for f in finds if f[0] == kind][-1:]
            label = "active"
            if prev and (now[1] > prev[0][1] or now[2] > prev[0][2] + 0.1):
                label = "escalating"
            elif prev and now[2] < prev[0][2] - 0.1:
                label = "resolving"
            elif prev and now[1] == prev[0][1] and abs(now[2] - prev[0][2]) < 0.05:
                label = "stabilizing"
            finds = (finds + [now])[-50:]
        if alert:
            counts[alert] += 1
            if ep is None or ep != last_ep:
                run, last_ep, last_alert, first = (run + 1 if alert == last_alert else 1), ep, alert, (t if first is None else first)
            clean, risk = 0, risk + 1
            if kind is not None:
                pattern, times = kind, (times + 1 if kind == pattern else 1)
        else:
            clean += 1
            if clean == 2:
                clean, risk, pattern, times = 0, 0, "", 0
        level = ["normal", "elevated", "high", "critical"][(risk >= 3) + (risk >= 5) + (risk >= 8)]
        out.append((i, trusted, sum(total) / trusted if trusted else 0.0, max(total, default=0.0), hr, sprints, counts["fatigue_alert"], counts["workload_alert"], counts["anomaly_flag"], run, first, label, len(finds), dict(moves), scores, risk, level, pattern, times))
    return out


def told(r):
    return (r.event_id, r.n_scored, pytest.approx(r.mean_score, abs=1e-8), r.peak_score, r.peak_hr, r.sprints, r.fatigue_alerts, r.workload_alerts, r.anomaly_alerts, r.consecutive_alerts, r.first_alert_us, r.finding_state, r.n_findings, r.transitions, r.recent_scores, r.risk_windows, r.risk_level, r.pattern, r.pattern_windows)


def test_match_state_over_restarts(spark, tmp_path):
    rows = scored(260, 3)
    parts = [rows[:90], rows[90:180], rows[180:]]
    rng = random.Random(4)
    for p in parts:
        rng.shuffle(p)
    got = collect(spark, str(tmp_path), SCORED, [*parts, [(9, 10**12, 9999, *rows[0][3:])]], ("player_id",), ordered.MatchState(), delay="30 seconds")
    for player in range(3):
        mine = [told(r) for r in got if r.player_id == player and r.kind == "row"]
        assert sorted(mine, key=lambda r: r[0]) == fold([r for r in rows if r[0] == player])
    ends = [r for r in got if r.kind == "end"]
    assert sorted(r.player_id for r in ends) == [0, 1, 2] and all(r.closed for r in ends)


def test_provider_is_asked_for(spark):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError):
        ordered.in_order(spark.createDataFrame([], TICK), ("player_id",), ordered.Windows())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def test_fingerprints_tell_content():
    a = {"event_id": 1, "t_us": 5, "x": None}
    assert ordered.fingerprint(a) == ordered.fingerprint({"x": None, "t_us": 5, "event_id": 1}) != ordered.fingerprint(a | {"t_us": 6})


EVENT = "match_id bigint, t_us bigint, event_id bigint, player_id bigint, team_id string, event_type string"
KINDS = ("possession", "pass", "pass", "sprint_event", "turnover", "possession", "pass", "shot")


def rallies(match, n, gap=25, begin=0, first_id=0):
    """n rallies of the teams in turn, `gap` seconds apart."""
    return [(match, (begin + r * gap + 2 * k) * S, first_id + r * 10 + k, 1 + k % 3, "AB"[r % 2], kind) for r in range(n) for k, kind in enumerate(KINDS[: 5 if r % 2 else 8])]


def run_chain(spark, folder, batches, every=30, **options):
    def run(source):
        w = ticked.ticked_chain(source, f"{folder}/store", f"{folder}/sink", f"{folder}/ck", every * S, delay="5 seconds", idle_ms=600_000, **options)
        q = w.trigger(availableNow=True).start()
        q.awaitTermination(300)

    feed(spark, folder, EVENT, batches, run)
    return f"{folder}/sink"


def versions(spark, sink, topic):
    df = spark.read.parquet(f"{sink}/{topic}").drop("batch")
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


OVER = [(99, 10**11, 10**6, 1, "Z", "pass")]


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    """The same two matches as one file and as several; then a far later event, which ends them."""
    rows = sorted(rallies(1, 7) + rallies(2, 4, 40, 13, 1000), key=lambda r: r[1])
    out = []
    for parts in (1, 3):
        folder = str(tmp_path_factory.mktemp("chain"))
        size = -(-len(rows) // parts)
        out.append(run_chain(spark, folder, [rows[a : a + size] for a in range(0, len(rows), size)] + [OVER], 50))
    return rows, out


def test_output_does_not_depend_on_files(spark, published):
    _, sinks = published
    for topic in ticked.TOPICS:
        first, second = (versions(spark, s, topic) for s in sinks)
        assert first and first == second


def test_final_rows_are_those_of_one_batch(spark, published):
    rows, sinks = published
    whole = ticked.team_outputs(spark.createDataFrame(rows, EVENT), True)
    for topic, spec in ticked.TOPICS.items():
        now = ticked.current(spark, sinks[1], topic).filter("match_id < 99")
        assert now.filter("NOT is_final").count() == 0
        cols = sorted(whole[topic].columns)
        key = lambda df: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)  # noqa: B023, E731
        assert key(now) == key(whole[topic])
        assert now.select("match_id", *spec.keys).distinct().count() == now.count()


def test_keys_appear_in_neighbouring_ticks_and_become_final_once(spark, published):
    _, sinks = published
    ticks = {m: [] for m in (1, 2)}
    for r in spark.read.parquet(f"{sinks[1]}/ticks").orderBy("tick").collect():
        ticks.get(r.match_id, []).append((r.tick, r.closed))
    assert all([t for t, _ in x] == list(range(1, len(x) + 1)) and [c for _, c in x] == [False] * (len(x) - 1) + [True] for x in ticks.values())
    for topic, spec in ticked.TOPICS.items():
        seen, final = defaultdict(list), defaultdict(int)
        for r in spark.read.parquet(f"{sinks[1]}/{topic}").filter("match_id < 99").collect():
            k = (r.match_id, *(r[c] for c in spec.keys))
            seen[k].append(r.tick)
            final[k] += r.is_final
        assert all(v <= 1 for v in final.values())
        if spec.at and topic in ("team_state", "trends"):
            assert all(sorted(v) == list(range(min(v), max(v) + 1)) for v in seen.values())
            assert {r.tick_us for r in spark.read.parquet(f"{sinks[1]}/{topic}").filter("match_id = 1 AND NOT is_final").collect()}  # times of events so far


def test_tail_is_provisional_and_the_last_possession_withheld(spark, tmp_path):
    rows = rallies(1, 2)
    sink = run_chain(spark, str(tmp_path), [rows, [(1, 60 * S, 500, 1, "A", "pass"), (2, 80 * S, 501, 1, "A", "pass")]], 30)
    found = spark.read.parquet(f"{sink}/possessions").collect()
    assert sorted((r.seq, r.is_final) for r in found) == [(1, True), (2, True)]
    tail = ticked.current(spark, sink, "team_state").filter("NOT is_final")
    assert tail.count() > 0 and tail.select("tick_us").distinct().count() <= 2
    again = f"{tmp_path}/copy"
    shutil.copytree(sink, again)  # an event of another match alone changes nothing of this one
    run_chain(spark, str(tmp_path), [[(2, 100 * S, 502, 1, "A", "pass")]], 30)
    assert versions(spark, again, "possessions") == versions(spark, sink, "possessions")
    run_chain(spark, str(tmp_path), [OVER], 30)
    assert sorted((r.seq, r.is_final) for r in spark.read.parquet(f"{sink}/possessions").filter("match_id = 1").collect())[-1] == (3, True)
    assert spark.read.parquet(f"{sink}/ticks").filter("match_id = 1 AND closed").count() == 1
