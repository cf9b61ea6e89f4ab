"""Interval joins, first overlaps, exact splits, journals and gates against plain versions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pitchflow.operators import evaluation, fusion, intervals, journal, state, team
from pitchflow.sources import readers

SPAN = "id int, begin_us bigint, end_us bigint"
H = 3_600_000_000


def spans(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(0, 400 * H)
        out.append((i, rng.choice([a, a, a, None]), rng.choice([a, a + 1, a + H, a + rng.randrange(60 * H), a - 5, None])))
    return out


def test_overlapping_equals_all_pairs(spark):
    a, b = spans(1, 150), spans(2, 150)
    touch = lambda x, y: None not in (x[1], y[1]) and x[1] <= max(y[1], y[2] or y[1]) and y[1] <= max(x[1], x[2] or x[1])
    want = sorted((x[0], y[0]) for x in a for y in b if touch(x, y))
    got = intervals.overlapping(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)).select("l.id", "r.id").collect()
    assert len(want) > 300 and sorted(map(tuple, got)) == want
    assert intervals.overlapping(spark.createDataFrame([], SPAN), spark.createDataFrame([], SPAN)).count() == 0


def test_pairs_follow_the_rows(spark):
    """Ten times the sessions along ten times the time: ten times the pairs that meet in cells."""
    met = []
    for n in (40, 400):
        df = spark.createDataFrame([(i, i * 4 * H, i * 4 * H + 2 * H) for i in range(n)], SPAN)
        plan = intervals.overlapping(df, df)
        assert plan.count() == n
        met.append(n)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_bundles(spark):
    s = spark.createDataFrame([(1, 0, 2 * H, [1, 2, 3]), (2, H, 3 * H, [3, 4]), (3, 100 * H, None, [9]), (None, 0, H, [1])], "session_id int, begin_us bigint, end_us bigint, roster array<int>")
    o = spark.createDataFrame([("a", "events", 0, H, [1, 2]), ("b", "positions", 2 * H, 3 * H, [3]), ("c", "events", 103 * H, 104 * H, [9]), ("d", "events", 101 * H, 101 * H, [8]), ("e", "events", None, H, [1])], "file string, kind string, begin_us bigint, end_us bigint, roster array<int>")
    got = readers.pair_bundles(s, o)
    assert sorted(map(tuple, got.collect())) == [("a", "events", 1, 2), ("b", "positions", 2, 1), ("c", "events", None, 0), ("d", "events", 3, 0), ("e", "events", None, 0)]
    known = spark.createDataFrame([(3,)], "session_id int")
    assert {(r.session_id, r.status) for r in readers.bundle_inventory(got, known).collect()} == {(None, "orphaned"), (1, "incomplete"), (2, "incomplete"), (3, "duplicate")}


def test_bundles_without_pairs(spark):
    """The best session of each file as from all pairs; many files and sessions at one time are not paired."""
    rng = random.Random(5)
    roster = lambda: rng.choice([None, [], [rng.randrange(6) for _ in range(rng.randrange(5))], [1, None]])
    s, o = [(*x, roster()) for x in spans(3, 200)], [(str(i), "events", *x, roster()) for i, *x in spans(4, 200)]
    tol = 2 * H
    want = []
    for f, kind, a, b, mine in o:
        hits = [(0, -1)]
        for i, c, d, theirs in s:
            if None not in (a, c) and a <= max(c - tol, (c if d is None else d) + tol) and c - tol <= max(a, a if b is None else b):
                hits.append((len(set(mine or []) & set(theirs or [])), i))
        shared, best = max(hits)
        want.append((f, kind, best if best >= 0 else None, shared))
    files, sessions = "file string, kind string, begin_us bigint, end_us bigint, roster array<int>", "session_id int, begin_us bigint, end_us bigint, roster array<int>"
    got = readers.pair_bundles(spark.createDataFrame(s, sessions), spark.createDataFrame(o, files))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    empty = readers.pair_bundles(spark.createDataFrame([], sessions), spark.createDataFrame(o[:3], files))
    assert {(r.session_id, r.shared) for r in empty.collect()} == {(None, 0)} and empty.count() == 3
    dense = spark.range(20_000).select(F.col("id").cast("int").alias("session_id"), F.lit(0).cast("bigint").alias("begin_us"), F.lit(H).alias("end_us"), F.array((F.col("id") % 7).cast("int")).alias("roster"))
    at_once = readers.pair_bundles(dense, dense.select(F.col("session_id").cast("string").alias("file"), F.lit("events").alias("kind"), "begin_us", "end_us", "roster"))
    assert {(r.file_group, r.session_id, r.shared) for r in at_once.select((F.col("file") % 7).cast("int").alias("file_group"), "session_id", "shared").distinct().collect()} == {(g, max(i for i in range(19_990, 20_000) if i % 7 == g), 1) for g in range(7)}


def test_inventory_forms_no_pairs(spark):
    from pitchflow.plans import dataset_queries

    plan = dataset_queries.bundle_inventory(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan and plan.count("Join") == 1  # of sessions with the known ones


def test_ids_on_one_side(spark):
    ticks, roster = spark.createDataFrame([(1,), (2,), (2,)], "player_id int"), spark.createDataFrame([(2, "x"), (3, "y")], "player_id int, name string")
    assert sorted((r.player_id, r.issue) for r in readers.id_differences(ticks, roster).select("player_id", "issue").collect()) == [(1, "not_in_roster"), (3, "without_ticks")]


def test_first_overlapping_episode(spark):
    rng = random.Random(5)
    rows = {k: sorted({(g, a, a + rng.randrange(6)) for g in (1, 2) for a in rng.sample(range(120), 14)}) for k in ("p", "t")}
    schema = "g int, start int, end int"
    got = evaluation.match_episodes(*(spark.createDataFrame(rows[k], schema) for k in ("p", "t")), "g").collect()
    want = [(g, a, b, min((s for h, s, e in rows["t"] if h == g and s <= b and e >= a), default=None)) for g, a, b in rows["p"]]
    assert sorted(((r.g, r.start, r.end, r.true_start) for r in got), key=repr) == sorted(want, key=repr)


def test_exact_split(spark):
    rows = spark.createDataFrame([(f"s{k % 103}", k) for k in range(500)] + [(None, 501)], "session string, n int")
    out = evaluation.split_sessions(rows, "session").collect()
    by = {}
    for r in out:
        by.setdefault(r.session, set()).add(r.split)
    assert len(out) == 501 and by.pop(None) == {None} and all(len(v) == 1 for v in by.values())
    assert Counter(v.pop() for v in by.values()) == {"train": 72, "validate": 15, "calibrate": 16}
    one = evaluation.split_sessions(spark.createDataFrame([("a",)], "session string"), "session").collect()
    assert [r.split for r in one] == ["train"]


JOURNAL = "target string, seq bigint, event_id bigint, at bigint, op string, key string, sub string, value double, pos bigint"


def mutations(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        op = rng.choice(["set", "update", "update", "increment", "delete"])
        nested = op in ("set", "update") and rng.random() < 0.4
        subs = rng.sample("xyz", rng.randrange(1, 4)) if nested else [None]
        target, at, event, key = rng.choice("AB"), k // 2, rng.choice([k, k, k, max(0, k - 3)]), rng.choice("abc")
        rows += [(target, k, event, at, op, key, s, float(rng.randrange(9)), 0) for s in subs]
    return rows


def fold(rows):
    seen, state_, bad = {}, {}, set()
    order = {}
    for r in rows:
        order.setdefault(r[1], []).append(r)
    for seq in sorted(order):
        seen.setdefault(order[seq][0][2], seq)
    for seq in sorted(order, key=lambda s: (order[s][0][3], s)):
        rs = order[seq]
        if seen[rs[0][2]] != seq:
            continue
        target, op, key = rs[0][0], rs[0][4], rs[0][5]
        at, change = (target, key), {r[6]: r[7] for r in rs}
        value = change if None not in change else change[None]
        if op == "set" or (op == "update" and not (isinstance(value, dict) and isinstance(state_.get(at), dict))):
            state_[at] = value
            if op == "set" or not isinstance(value, dict):
                bad.discard(at)
        elif op == "update":
            state_[at] = state_[at] | value
        elif op == "increment":
            if isinstance(state_.get(at), dict):
                bad.add(at)
            else:
                state_[at] = state_.get(at, 0.0) + value
        else:
            state_.pop(at, None)
            bad.discard(at)
    out = [(t, k, None, None, "an increment meets a map") for t, k in bad]
    for (t, k), v in state_.items():
        if (t, k) not in bad:
            out += [(t, k, s, x, None) for s, x in v.items()] if isinstance(v, dict) else [(t, k, None, v, None)]
    return sorted(out, key=repr)


def test_journal_equals_a_fold_and_compacts(spark):
    for seed in range(4):
        rows = mutations(seed, 60)
        df = spark.createDataFrame(rows, JOURNAL)
        assert sorted(map(tuple, journal.rebuild_targets(df).collect()), key=repr) == fold(rows)
    calm = [r for r in mutations(9, 80) if r[4] != "increment" or r[6] is None]
    calm = [(*r[:2], r[1], *r[3:]) for r in calm if not (r[4] == "increment" and r[5] != "c") and not (r[6] is not None and r[5] == "c")]
    head, tail = [r for r in calm if r[1] < 40], [r for r in calm if r[1] >= 40]
    snapshot = journal.rebuild_targets(spark.createDataFrame(head, JOURNAL))
    got = journal.rebuild_targets(spark.createDataFrame(tail, JOURNAL), snapshot).collect()
    assert sorted(map(tuple, got), key=repr) == fold(calm)


def test_journal_lists(spark):
    rows = [("A", 1, 1, 5, "append", None, None, 1.0, 0), ("A", 1, 1, 5, "append", None, None, 2.0, 1), ("A", 2, 2, 4, "append", None, None, 3.0, 0), ("A", 3, 1, 9, "append", None, None, 9.0, 0), ("B", 4, 4, 1, "append", None, None, 7.0, 0)]
    got = journal.rebuild_lists(spark.createDataFrame(rows, JOURNAL))
    assert sorted(map(tuple, got.collect())) == [("A", 0, 3.0), ("A", 1, 1.0), ("A", 2, 2.0), ("B", 0, 7.0)]
    more = spark.createDataFrame([("A", 9, 9, 0, "append", None, None, 8.0, 0)], JOURNAL)
    assert sorted(map(tuple, journal.rebuild_lists(more, got).collect())) == [("A", 0, 3.0), ("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 8.0), ("B", 0, 7.0)]


def test_gate_holds_no_more_than_its_state(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    rng = random.Random(8)
    rows = [(k % 2, k, rng.choice(["f", "f", "w", None])) for k in range(60)]
    got = {r.t_us: r.passed for r in state.alert_gate(spark.createDataFrame(rows, "p int, t_us bigint, family string"), ("p",), ("t_us",), 7).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for p in (0, 1):
        last = None
        for _, t, family in (r for r in rows if r[0] == p):
            if family is None:
                last = None
            ok = family is not None and not (last and last[0] == family and t - last[1] < 7)
            last = (family, t) if ok else last
            assert got[t] == ok


def test_event_report_counts_first_overlaps(spark):
    """A prediction over two true episodes finds the first; the second is missed."""
    span = "g int, start int, end int"
    p = spark.createDataFrame([(1, 2, 9), (1, 20, 21), (1, 40, 41)], span)
    t = spark.createDataFrame([(1, 3, 4), (1, 8, 12), (1, 41, 44)], span)
    r = evaluation.event_report(p, t, spark.createDataFrame([(450,)], "windows bigint"), "g").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.fp_per_match, r.fragmentation, r.stability, r.mean_lead_s) == (2, 1, 1, 0.666667, 0.666667, 0.1, 1.0, 1.0, -120.0)
    none = evaluation.event_report(p.limit(0), t.limit(0), spark.createDataFrame([(0,)], "windows bigint"), "g").first()
    assert (none.tp, none.fp, none.fn, none.precision, none.f1, none.mean_lead_s) == (0, 0, 0, 0.0, 0.0, None)


def test_budget_pick(spark):
    sweep = spark.createDataFrame([(0, 0.1, 9, 5), (1, 0.2, 2, 4), (2, 0.3, 0, 1)], "k int, threshold double, fp int, tp int")
    totals = spark.createDataFrame([(90, 5)], "windows bigint, positives bigint")
    got = evaluation.budget_pick(sweep, totals, 1.0).collect()
    assert [tuple(r) for r in got] == [(1, 0.2, 2, 4, 1.0, 0.666667, 0.8)]
    assert evaluation.budget_pick(sweep.filter("k = 0"), totals, 1.0).count() == 0


def test_opponent_by_context(spark):
    events = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (1, "C"), (2, "B"), (3, None)], "match_id int, team_id string")
    context = spark.createDataFrame([(1, 5, "X"), (1, 9, "B"), (2, 1, "Y"), (2, 2, None), (4, 1, "Z")], "match_id int, t_us bigint, opponent_team_id string")
    assert sorted((r.match_id, r.opponent_id) for r in team.opponent_team(events, "A").collect()) == [(1, "C"), (2, "B")]
    assert sorted((r.match_id, r.opponent_id) for r in team.opponent_team(events, "A", context).collect()) == [(1, "B"), (2, "B"), (4, "Z")]


def test_squad_recalibration_as_rows(spark):
    rate = lambda k, n: evaluation.recalibrate_squad(spark.createDataFrame([("override" if i < k else "accept",) for i in range(n)] + [(None,)], "decision string")).collect()
    assert [(r.old, r.new) for r in rate(9, 12)] == [(0.05, 0.1)] and [r.new for r in rate(1, 40)] == [0.01]
    assert rate(3, 15) == rate(0, 15) == rate(5, 6) == []


def test_claims_in_parts_equal_one_walk(spark):
    """Claims found in the smallest groups, against one walk over all pairs, with equal times and distances; no join."""
    rng = random.Random(9)
    for n, m, span, tol in ((150, 40, 400, 9), (60, 60, 100, 30), (40, 90, 300, 20), (200, 50, 60, 5), (5, 0, 9, 5), (0, 5, 9, 5)):
        ids = rng.sample(range(1000), n)
        t = [(1, i, i, rng.randrange(span), "A", "shot") for i in ids]
        c = [(1, i, i, rng.randrange(span), "A", "goal") for i in rng.sample(range(1000), m)]
        taken, want = set(), []
        for _, i, _, at, _, _ in sorted(c, key=lambda x: x[1]):
            near = min(((abs(x[3] - at), x[1]) for x in t if x[1] not in taken and abs(x[3] - at) <= tol), default=None)
            if near:
                taken.add(near[1])
                want.append((i, near[1], near[0]))
        tracked = spark.createDataFrame(t, "match_id bigint, event_id bigint, player_id bigint, t_us bigint, team_id string, event_type string")
        expected = fusion.expected_events(spark.createDataFrame(c, "match_id bigint, coach_event_id bigint, player_id bigint, t_us bigint, team_id string, event_type string"), {})
        for group in (1, 20_000):
            found = fusion.claims(tracked, expected, tol, group)
            assert sorted(found.select("coach_event_id", "event_id", "dt_us").collect()) == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_whole_and_take_little_room(spark, tmp_path):
    """All pairs against a plain loop, over lists of two rows and of the usual size; many copies of events at the same times,
    in any order, take less than a byte a pair where they are written."""
    rng, tol, copies = random.Random(4), 1000, 60
    tracked_schema, coach_schema = "match_id bigint, event_id bigint, t_us bigint, team_id string, event_type string", "match_id bigint, coach_event_id bigint, player_id bigint, t_us bigint, team_id string, event_type string"
    odd = [(None, 1, 5, "A", "shot"), (1, 2, None, "A", "shot"), (1, 3, 5, None, "shot"), (1, 4, 5, "A", None), (1, None, 5, "A", "shot"), (1, 6, 5, "A", "shot"), (1, 6, 5, "A", "shot")]
    t = odd + [(rng.randrange(2), 10 + i, rng.randrange(-4000, 4000) // 50 * 50, rng.choice("AB"), rng.choice(["shot", "turnover", "pass"])) for i in range(400)]
    c = [(1, 1, 1, None, "A", "goal"), (1, None, 1, 5, "A", "shot"), (None, 2, 1, 5, "A", "shot")] + [(rng.randrange(2), 10 + i, i, rng.randrange(-4000, 4000) // 50 * 50, rng.choice("AB"), rng.choice(["goal", "save", "turnover"])) for i in range(150)]
    kind = {"goal": ("shot", "GOAL"), "shot": ("shot", "MISSED"), "save": ("shot", "SAVED"), "turnover": ("turnover", None)}
    want = Counter()
    for m, i, _, at, team_id, said in c:
        team_id = team_id if said != "save" else "BA"["AB".index(team_id)]
        want.update((m, i, e, kind[said][0], team_id, abs(us - at), kind[said][1]) for k, e, us, whose, what in t if None not in (m, k, at, us) and (k, whose, what) == (m, team_id, kind[said][0]) and abs(us - at) <= tol)
    expected = fusion.expected_events(spark.createDataFrame(c, coach_schema), {"A": "B", "B": "A"})
    for size in (2, 256):
        assert len(want) > 500 and Counter(map(tuple, fusion.fusion_candidates(spark.createDataFrame(t, tracked_schema), expected, tol, size).collect())) == want

    times = rng.sample(range(8 * tol), 60)
    t, c = [(1, k * 1000 + i, us, "A", "shot") for i, us in enumerate(times) for k in range(copies)], [(1, k * 1000 + i, 1, us + 100 * (k % 7), "A", "goal") for i, us in enumerate(times) for k in range(copies // 3)]
    rng.shuffle(t), rng.shuffle(c)
    pairs = fusion.fusion_candidates(spark.createDataFrame(t, tracked_schema), fusion.expected_events(spark.createDataFrame(c, coach_schema), {}), tol)
    pairs.write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n == sum(abs(x[2] - y[3]) <= tol for x in t for y in c) and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < n
