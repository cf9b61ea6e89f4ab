"""Episodes: literal cases, a step-by-step version, and ordered walks over small batches."""

import random

from pitchflow.operators import episodes as E
from pitchflow.operators.walks import Walk, ordered_walk

LEVEL = {"low": 0, "medium": 1, "high": 2, "critical": 3}
FINDING = "player string, pos int, finding string, minute int, severity string, confidence double, state string, score double"
KEYS, ORDER = ("player",), ("pos",)
COLUMNS = "player episode finding start_minute end_minute trend severity response n_windows peak_score peak_confidence".split()


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (repr(r[0]), r[1]))


def made(spark, by_player):
    rows = [(p, k, *f) for p, fs in by_player.items() for k, f in enumerate(fs)]
    return spark.createDataFrame(rows, FINDING)


def f(kind, severity, minute, score=0.6, confidence=0.8, state="active"):
    return kind, minute, severity, confidence, state, score


def test_one_type_is_one_open_episode(spark):
    df = made(spark, {"a": [f("locomotor_overload", "high", 22), f("locomotor_overload", "high", 23, 0.7), f("locomotor_overload", "critical", 24, 0.8)]})
    assert rows_of(E.segment_episodes(df, KEYS, ORDER)) == [("a", 1, "locomotor_overload", 22, None, "worsening", "critical", "persisted", 3, 0.8, 0.8)]


def test_another_type_opens_another(spark):
    df = made(spark, {"a": [f("locomotor_overload", "high", 22), f("locomotor_overload", "high", 23), f("cardiovascular_overload", "high", 30), f("cardiovascular_overload", "high", 31)]})
    got = rows_of(E.segment_episodes(df, KEYS, ORDER))
    assert [(r[2], r[3], r[4], r[7]) for r in got] == [("locomotor_overload", 22, 23, "resolved"), ("cardiovascular_overload", 30, None, "persisted")]


def test_gates_cooldown_and_merging(spark):
    low = [f("x", "low", m, confidence=0.6) for m in range(1, 6)]
    unsure = [f("y", "medium", m, confidence=0.5) for m in range(6, 11)]
    short = [f("z", "low", 11)]
    again = [f("x", "medium", m) for m in range(12, 18)]  # x closed just before: held back
    crisis = [f("y", "low", 18), f("x", "critical", 19, state="escalating"), f("q", "low", 20)]
    df = made(spark, {"a": low + unsure + short + again + crisis})
    steps = sorted((r.gate or "", r.finding, r.n_windows) for r in E.episode_steps(df, KEYS, ORDER).collect())
    assert steps == [("", "q", 1), ("", "x", 1), ("", "x", 5), ("confidence", "y", 5), ("cooldown", "x", 6), ("min_windows", "y", 1), ("min_windows", "z", 1)]
    got = rows_of(E.segment_episodes(df, KEYS, ORDER))
    assert [(r[2], r[3], r[4]) for r in got] == [("x", 1, 5), ("x", 19, 19), ("q", 20, None)]
    closer = made(spark, {"a": low + [f("y", "low", 6), f("x", "critical", 8, confidence=0.9), f("q", "low", 9)]})
    assert rows_of(E.segment_episodes(closer, KEYS, ORDER))[0] == ("a", 1, "x", 1, 8, "stable", "critical", "persisted", 6, 0.6, 0.9)


def brute(findings, existing=()):
    """Step by step: runs, then episodes, then merging."""
    if not findings:
        return [dict(e) for e in existing]
    kinds = [(x[0] or "unknown", x[1], LEVEL.get(x[2], 0), 0.5 if x[3] is None else x[3], x[4] or "active") for x in findings]
    scores = [x[5] for x in findings if x[5] is not None]
    runs = []
    for k, x in enumerate(kinds):
        if runs and kinds[k - 1][0] == x[0] and (kinds[k - 1][1] is None or x[1] is None or abs(x[1] - kinds[k - 1][1]) <= 2):
            runs[-1].append(k)
        else:
            runs.append([k])
    eps = [dict(e) for e in existing]
    number = max((e["episode"] for e in eps), default=0) + 1
    closed = {e["finding"]: e["episode"] for e in eps if e["end_minute"] is not None}
    for run in runs:
        kind, last = kinds[run[0]][0], run is runs[-1]
        minutes = [kinds[k][1] for k in run if kinds[k][1] is not None]
        sev, conf, states = [kinds[k][2] for k in run], [kinds[k][3] for k in run], [kinds[k][4] for k in run]
        mean, half = (lambda v: sum(v) / len(v)), len(run) // 2
        if half == 0:
            trend = "stable"
        elif "escalating" in states or "resolving" in states:
            trend = "worsening" if "escalating" in states else "recovering"
        elif mean(sev[half:]) != mean(sev[:half]):
            trend = "worsening" if mean(sev[half:]) > mean(sev[:half]) else "recovering"
        else:
            trend = "worsening" if mean(conf[half:]) > mean(conf[:half]) + 0.05 else "stable"
        after = kinds[run[-1] + 1 :]
        same = [x[4] for x in after if x[0] == kind]
        names = {"resolving": "resolved", "escalating": "escalated"}
        if same:
            response = names.get(same[-1], "persisted")
        elif after:
            response = "escalated" if states[-1] == "escalating" else "resolved"
        else:
            response = names.get(states[-1], "persisted" if states[-1] in ("stabilizing", "active") else "unknown")
        peak = max(scores[-len(run) :]) if len(scores) >= len(run) else 0.0
        level = max(sev)
        fails = lambda c: level < 2 and (len(run) < 5 or c < 0.55)  # noqa: B023, E731
        open_ = [e for e in eps if e["finding"] == kind and e["end_minute"] is None]
        if open_:
            e = open_[-1]
            e |= {"n_windows": len(run), "peak_score": max(e["peak_score"], peak), "peak_confidence": max(e["peak_confidence"], max(conf)), "trend": trend, "response": response, "severity": level}
            if e["start_minute"] is None and minutes:
                e["start_minute"] = minutes[0]
            if not last and not fails(e["peak_confidence"]):
                e["end_minute"] = minutes[-1] if minutes else None
                closed[kind] = e["episode"]
            continue
        if not last and level < 3 and kind in closed and number - closed[kind] < 2 or not last and fails(max(conf)):
            continue
        eps.append({"episode": number, "finding": kind, "start_minute": minutes[0] if minutes else None, "end_minute": minutes[-1] if minutes and not last else None, "trend": trend, "severity": level, "response": response, "n_windows": len(run), "peak_score": peak, "peak_confidence": max(conf)})
        if not last:
            closed[kind] = number
        number += 1
    out = eps[:1]
    for e in eps[1:]:
        p = out[-1]
        if p["finding"] == e["finding"] and None not in (p["end_minute"], e["end_minute"]) and (e["start_minute"] is None or e["start_minute"] - p["end_minute"] <= 3):
            p |= {"end_minute": e["end_minute"], "n_windows": p["n_windows"] + e["n_windows"], **{c: max(p[c], e[c]) for c in ("peak_score", "peak_confidence", "severity")}}
            p["trend"] = "worsening" if e["trend"] == "worsening" else p["trend"]
            p["response"] = e["response"] if e["response"] in ("escalated", "persisted") else p["response"]
        else:
            out.append(e)
    return out


def random_findings(seed, n):
    rng = random.Random(seed)
    minute, kind, out = 0, "a", []
    for _ in range(n):
        minute += rng.choice([0, 1, 1, 1, 2, 3, 6])
        kind = rng.choice([kind] * 8 + ["a", "b", "c", None])
        out.append((kind, rng.choice([minute] * 5 + [None]), rng.choice(["low"] * 5 + ["medium"] * 3 + ["high", "critical", None]), rng.choice([0.3, 0.5, 0.6, 0.9, None]), rng.choice(["active", "stabilizing", "active", None] * 4 + ["escalating", "resolving", "other"]), rng.choice([0.1, 0.5, 0.9, None])))
    return out


def test_episodes_equal_steps(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    players = {None if k == 0 else f"p{k}": random_findings(k, [0, 1, 4, 30, 90][k % 5]) for k in range(40)}
    players[None] = random_findings(99, 60)
    names = list(LEVEL)
    existing, want = [], []
    for p, fs in players.items():
        before = brute(fs[: len(fs) // 2])
        existing += [(p, *(names[e[c]] if c == "severity" else e[c] for c in COLUMNS[1:])) for e in before]
        want += [(p, *(names[e[c]] if c == "severity" else e[c] for c in COLUMNS[1:])) for e in brute(fs)]
    df = made(spark, players)
    assert rows_of(E.segment_episodes(df, KEYS, ORDER)) == sorted(want, key=lambda r: (repr(r[0]), r[1]))
    assert len({w[6] for w in want}) == 4 and len({w[7] for w in want}) == 4 and any(w[3] is None for w in want)
    # the second half on top of the episodes of the first
    later = {p: fs[len(fs) // 2 :] for p, fs in players.items() if fs[len(fs) // 2 :]}
    want = []
    for p, fs in later.items():
        kept = [dict(zip(COLUMNS[1:], e[1:], strict=True)) | {"severity": LEVEL[e[6]]} for e in existing if e[0] == p]
        want += [(p, *(names[e[c]] if c == "severity" else e[c] for c in COLUMNS[1:])) for e in brute(fs, kept)]
    schema = "player string, episode int, finding string, start_minute int, end_minute int, trend string, severity string, response string, n_windows int, peak_score double, peak_confidence double"
    got = E.segment_episodes(made(spark, later), KEYS, ORDER, spark.createDataFrame(existing, schema))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    assert rows_of(got) == sorted(want, key=lambda r: (repr(r[0]), r[1]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert E.segment_episodes(df.limit(0), KEYS, ORDER).count() == 0


def test_walk_hands_its_state_on(spark):
    class Sum(Walk):
        def __init__(self):
            self.total, self.most = 0, 0

        def step(self, rows):
            self.most = max(self.most, len(rows))
            out = []
            for v in rows["v"]:
                self.total += int(v)
                out.append((self.total, self.most))
            return out

        def end(self):
            return [(-self.total, self.most)]

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.createDataFrame([(None if k % 3 == 0 else k % 3, k, 1) for k in range(100)], "k int, at int, v int")
    got = ordered_walk(df, ("k",), ("at",), Sum, "total bigint, most int").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert max(r.most for r in got) <= 7
    assert sorted((repr(r.k), r.total) for r in got) == sorted((repr(k), t) for k, n in ((None, 34), (1, 33), (2, 33)) for t in [*range(1, n + 1), -n])


def test_closed_episodes_are_kept_once(spark):
    made_ = spark.createDataFrame([("a", 1, 9, 5), ("a", 2, 12, 1), ("a", 3, None, 7), (None, 1, 3, 2)], "player string, episode int, end_minute int, n_windows int")
    first = E.newly_closed(made_, None, KEYS)
    assert sorted((repr(r.player), r.episode) for r in first.collect()) == [("'a'", 1), ("None", 1)]
    later = made_.filter("episode <> 3").union(spark.createDataFrame([("a", 3, 20, 8)], made_.schema))
    assert [(r.player, r.episode) for r in E.newly_closed(later, first, KEYS).collect()] == [("a", 3)]


def test_narratives(spark):
    e = spark.createDataFrame([("a", 1, "locomotor_overload", 22, 30, "worsening"), ("a", 2, "cardio_strain", 40, None, "stable"), ("b", 1, "x_y", None, 9, "recovering")], "player string, episode int, finding string, start_minute int, end_minute int, trend string")
    level = spark.createDataFrame([("a", "high"), ("c", "normal")], "player string, level string")
    got = {r.player: r.narrative for r in E.trajectory_narrative(e, level, KEYS).collect()}
    assert got == {
        "a": "2 episode(s): locomotor overload (from min~22) → cardio strain (ongoing) — progressive deterioration. Escalation: high.",
        "b": "1 episode(s) of x y — improving trajectory from early match, to min~9. Escalation: normal.",
        "c": "No significant episodes detected yet.",
    }
