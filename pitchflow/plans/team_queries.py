"""Registered queries of the team chain and their SQL. A match is a week of events, a window a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import team
from .views import oracle, view

DAY = 86_400_000_000


def _tactical(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "tactical")


def team_state(spark, d):
    return team.team_state(_tactical(spark, d), DAY)


def team_state_sliding(spark, d):
    return team.team_state(_tactical(spark, d), 2 * DAY, DAY // 2)


def team_trend(spark, d):
    return team.team_trend(team_state(spark, d))


#: Rates on a day's window are small, so the queries use thresholds of their scale.
SCALED = team.TeamThresholds(attack_trend=0.003, load_trend=0.003, burden_trend=0.0005, attack_insight=0.005, load_insight=0.005, pressure_insight=0.1, attack_floor=0.02, attack_ceiling=0.015)


def _scaled_trend(spark, d):
    return team.team_trend(team_state(spark, d), SCALED)


def coach_insights(spark, d):
    return team.coach_insights(_scaled_trend(spark, d), SCALED).drop("message")


def possessions(spark, d):
    return team.possessions(_tactical(spark, d))


def possession_summary(spark, d):
    p = possessions(spark, d)
    return p.groupBy("team_id", "outcome").agg(F.count("*").alias("n"), F.round(F.avg("possession_quality"), 4).alias("mean_quality"), F.sum("n_events").alias("n_events"))


def possessions_at(spark, d):
    return team.possessions_at(possessions(spark, d), _scaled_trend(spark, d))


def coach_situations(spark, d):
    trends = _scaled_trend(spark, d)
    return team.coach_situations(possessions(spark, d), team_state(spark, d), trends, team.coach_insights(trends, SCALED), SCALED)


def final_trends(spark, d):
    return team.final_rows(team_trend(spark, d))


def opponent_team(spark, d):
    return team.opponent_team(_tactical(spark, d), "A")


def _state(window: int, step: int) -> str:
    s = window / 1e6
    return f"""ev AS ({oracle("tactical")}), bounds AS (SELECT match_id, min(t_us) t0, max(t_us) t_end FROM ev GROUP BY 1),
nr AS (SELECT *, (greatest(t_end - t0 - {window}, 0) + {step - 1}) // {step} AS nreg FROM bounds),
ticks AS (SELECT match_id, t0, t_end, nreg, k, CASE WHEN k = nreg THEN t_end ELSE t0 + {window} + k * {step} END AS tick_us FROM nr, LATERAL (SELECT unnest(range(0, nreg + 1)) AS k)),
grid AS (SELECT t.*, team_id FROM ticks t JOIN (SELECT DISTINCT match_id, team_id FROM ev) x USING (match_id)),
st AS (SELECT g.match_id, g.team_id, g.tick_us, count(*) FILTER (event_type = 'turnover') tu, count(*) FILTER (event_type = 'possession') po, count(*) FILTER (event_type IN ('pass', 'shot')) atk,
  count(*) FILTER (event_type = 'sprint_event') ph, count(DISTINCT player_id) pl, count(event_id) n
  FROM grid g LEFT JOIN ev ON ev.match_id = g.match_id AND ev.team_id IS NOT DISTINCT FROM g.team_id AND t_us <= tick_us AND (t_us > tick_us - {window} OR (k = 0 AND t_us = tick_us - {window})) GROUP BY ALL),
state AS (SELECT match_id, team_id, CAST({window} AS BIGINT) window_us, tick_us, round(CASE WHEN tu + po > 0 THEN tu / (tu + po) ELSE 0 END, 4) possession_pressure, round(atk * 60.0::DOUBLE / {s}::DOUBLE, 4) attack_activity,
  round(ph * 60.0::DOUBLE / {s}::DOUBLE, 4) physical_load, round(CASE WHEN pl > 0 THEN ph * 60.0::DOUBLE / {s}::DOUBLE / pl ELSE 0 END, 4) fatigue_burden, round(least(1.0::DOUBLE, n / (10.0::DOUBLE * {s}::DOUBLE / 60)), 4) confidence FROM st)"""


def _trend(t=team.TEAM) -> str:
    label = lambda c, x: f"CASE WHEN {c} >= {x} THEN 'increasing' WHEN {c} <= -{x} THEN 'decreasing' ELSE 'stable' END"
    return f"""dl AS (SELECT *, possession_pressure - lag(possession_pressure) OVER w dp, attack_activity - lag(attack_activity) OVER w da, physical_load - lag(physical_load) OVER w dl, fatigue_burden - lag(fatigue_burden) OVER w df
  FROM state WINDOW w AS (PARTITION BY match_id, team_id, window_us ORDER BY tick_us)),
trend AS (SELECT match_id, team_id, window_us, tick_us, round(dp, 4) possession_pressure_delta, round(da, 4) attack_activity_delta, round(dl, 4) physical_load_delta, round(df, 4) fatigue_burden_delta,
  {label("da", t.attack_trend)} attack_trend, {label("dl", t.load_trend)} load_trend, {label("df", t.burden_trend)} fatigue_trend FROM dl WHERE da IS NOT NULL)"""


def _insights(t=SCALED) -> str:
    conf = lambda r: f"least(1.0::DOUBLE, round(0.4::DOUBLE + 0.2::DOUBLE * ({r} - 1), 3))"
    rank = lambda r: f"CASE WHEN {r} >= 2.0 THEN 2 WHEN {r} >= 1.5 THEN 1 ELSE 0 END"
    a, load, p = f"(abs(attack_activity_delta) / {t.attack_insight}::DOUBLE)", f"(abs(physical_load_delta) / {t.load_insight}::DOUBLE)", f"(abs(possession_pressure_delta) / {t.pressure_insight}::DOUBLE)"
    up, down = f"attack_trend = 'increasing' AND attack_activity_delta >= {t.attack_insight}", f"attack_trend = 'decreasing' AND attack_activity_delta <= -{t.attack_insight}"
    spike, drop = f"load_trend = 'increasing' AND physical_load_delta >= {t.load_insight}", f"load_trend = 'decreasing' AND physical_load_delta <= -{t.load_insight}"
    rows = [
        (up, "attack_activity_rising", "attack_activity_delta", t.attack_insight, a), (down, "attack_activity_falling", "attack_activity_delta", -t.attack_insight, a),
        (spike, "workload_spike", "physical_load_delta", t.load_insight, load), (drop, "workload_drop", "physical_load_delta", -t.load_insight, load),
        (f"possession_pressure_delta >= {t.pressure_insight}", "possession_pressure_increasing", "possession_pressure_delta", t.pressure_insight, p),
        (f"possession_pressure_delta <= -{t.pressure_insight}", "possession_pressure_decreasing", "possession_pressure_delta", -t.pressure_insight, p),
    ]
    one = [f"SELECT match_id, team_id, window_us, tick_us, '{c}' category, {rank(r)} rk, {conf(r)} confidence, {v} AS value, {x}::DOUBLE threshold FROM trend WHERE {w}" for w, c, v, x, r in rows]
    two = [f"SELECT match_id, team_id, window_us, tick_us, '{c}' category, greatest({rank(a)}, {rank(load)}) rk, least({conf(a)}, {conf(load)}) confidence, physical_load_delta AS value, {t.load_insight}::DOUBLE threshold FROM trend WHERE {w} AND {spike}" for w, c in ((up, "high_attack_high_load"), (down, "low_attack_high_load"))]
    return f"ins AS (SELECT * REPLACE (value::DOUBLE AS value), ['low', 'medium', 'high'][rk + 1] severity FROM ({' UNION ALL '.join(one + two)}) u)"


def _fold() -> str:
    """Possessions by walking through each match's events one after another: the state machine itself."""
    return """pe AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t_us, CASE WHEN event_type IN ('shot', 'turnover') THEN 0 ELSE 1 END, event_id) rn FROM ev),
ctl AS (SELECT *, event_type IN ('possession', 'shot', 'turnover') c FROM pe),
prev AS (SELECT e.*, (SELECT max(p.rn) FROM ctl p WHERE p.match_id = e.match_id AND p.rn < e.rn AND p.c) prn FROM ctl e),
own AS (SELECT e.*, p.event_type = 'possession' AND p.team_id IS NOT DISTINCT FROM e.team_id AS mine FROM prev e LEFT JOIN ctl p ON p.match_id = e.match_id AND p.rn = e.prn),
att AS (SELECT *, sum(CASE WHEN c AND NOT coalesce(mine, false) THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY rn) span FROM own),
sp AS (SELECT match_id, span, arg_min(coalesce(team_id, '-'), rn) tm, min(t_us) start_us, max(t_us) end_us, count(*) FILTER (event_type = 'shot') sh, count(*) FILTER (event_type = 'turnover') tu, count(*) FILTER (event_type IN ('pass', 'shot')) atk,
  count(*) FILTER (event_type = 'sprint_event') ph, count(*) n FROM att WHERE c OR coalesce(mine, false) GROUP BY 1, 2),
nx AS (SELECT *, lead(sh) OVER w nsh, lead(n) OVER w nn FROM sp WINDOW w AS (PARTITION BY match_id ORDER BY span)),
kept AS (SELECT *, CASE WHEN sh > 0 THEN 'shot' WHEN tu > 0 THEN 'turnover' ELSE 'neutral' END outcome, CASE WHEN end_us > start_us THEN 60 / ((end_us - start_us) / 1000000) ELSE 0 END f FROM nx WHERE NOT (sh = 0 AND tu = 0 AND coalesce(nsh, 0) = 1 AND nn = 1)),
poss AS (SELECT match_id, nullif(tm, '-') team_id, start_us, end_us, outcome, CAST(row_number() OVER (PARTITION BY match_id ORDER BY span) AS INT) seq, n n_events, round(atk * f, 4) attack_activity, round(ph * f, 4) physical_load, round(ph * f, 4) transition_rate,
  round(0.5::DOUBLE * CASE outcome WHEN 'shot' THEN 0.85::DOUBLE WHEN 'turnover' THEN 0 ELSE 0.5::DOUBLE END + 0.5::DOUBLE * least(1.0::DOUBLE, atk * f / 15), 4) possession_quality FROM kept)"""


AGG = """agg AS (SELECT t.match_id, t.team_id, t.window_us, t.tick_us, count(*) n_possessions, round(count(*) FILTER (outcome = 'turnover') / count(*), 4) turnover_rate, count(*) FILTER (possession_quality >= 0.67) n_high_quality,
  round(avg(possession_quality), 4) mean_quality FROM trend t JOIN poss p ON p.match_id = t.match_id AND p.team_id IS NOT DISTINCT FROM t.team_id AND end_us > tick_us - window_us AND end_us <= tick_us GROUP BY ALL)"""


def _situations(t=SCALED) -> str:
    cases = f"""CASE WHEN list_contains(cats, 'high_attack_high_load') AND n > 0 AND turn >= 0.5 THEN 'ATTACKING_SURGE_WITH_RISK'
 WHEN attack_trend = 'increasing' AND level >= {t.attack_floor} AND n > 0 AND quality >= 0.67 AND load_trend = 'increasing' THEN 'HIGH_TEMPO_ATTACK' WHEN list_contains(cats, 'low_attack_high_load') THEN 'INEFFICIENT_HIGH_EFFORT'
 WHEN n > 0 AND turn >= 0.5 AND possession_pressure_delta >= 0.15 THEN 'POSSESSION_INSTABILITY' WHEN high >= 2 AND attack_trend <> 'decreasing' AND level >= {t.attack_floor} AND possession_pressure_delta <= -0.15 THEN 'SUSTAINED_PRESSURE'
 WHEN fatigue_trend = 'increasing' AND load_trend <> 'decreasing' AND attack_trend <> 'increasing' THEN 'FATIGUE_ONSET'
 WHEN attack_trend <> 'increasing' AND level <= {t.attack_ceiling} AND load_trend = 'decreasing' AND possession_pressure_delta <= -0.15 THEN 'DEFENSIVE_RECOVERY_PHASE'
 WHEN fatigue_trend = 'decreasing' AND load_trend <> 'increasing' AND possession_pressure_delta <= 0 THEN 'RECOVERY_CONSOLIDATION' WHEN attack_trend = 'increasing' AND load_trend = 'decreasing' THEN 'EFFICIENT_TRANSITION'
 WHEN attack_trend = 'stable' AND load_trend = 'stable' AND fatigue_trend = 'stable' AND abs(possession_pressure_delta) < 0.05 THEN 'CONTROLLED_TEMPO' END"""
    support = " UNION ALL ".join(f"SELECT '{k}' s, [{', '.join(repr(c) for c in v)}]::VARCHAR[] rel" for k, v in team.SUPPORT.items())
    return f"""il AS (SELECT match_id, team_id, window_us, tick_us, list(category) cats, map(list(category), list(confidence)) conf FROM ins GROUP BY ALL),
al AS (SELECT t.*, s.attack_activity level, coalesce(cats, []) cats, conf, coalesce(n_possessions, 0) n, coalesce(turnover_rate, 0) turn, coalesce(n_high_quality, 0) high, coalesce(mean_quality, 0) quality FROM trend t
 LEFT JOIN state s ON s.match_id = t.match_id AND s.team_id IS NOT DISTINCT FROM t.team_id AND s.tick_us = t.tick_us LEFT JOIN il i ON i.match_id = t.match_id AND i.team_id IS NOT DISTINCT FROM t.team_id AND i.tick_us = t.tick_us
 LEFT JOIN agg a ON a.match_id = t.match_id AND a.team_id IS NOT DISTINCT FROM t.team_id AND a.tick_us = t.tick_us),
sit AS (SELECT al.*, {cases} situation_type FROM al), sup AS ({support}),
pr AS (SELECT sit.*, list_sort(list_intersect(rel, cats)) present FROM sit JOIN sup ON s = situation_type)
SELECT match_id, team_id, window_us, tick_us, situation_type, CASE WHEN len(present) >= 2 THEN 'high' WHEN len(present) = 1 THEN 'medium' ELSE 'low' END severity,
 CASE WHEN len(present) > 0 THEN list_min(list_transform(present, lambda c: conf[c])) ELSE 0.5::DOUBLE END confidence, array_to_string(present, ',') source_insights, n n_possessions, turn::DOUBLE turnover_rate FROM pr"""


def queries() -> dict:
    return {f.__name__: f for f in (team_state, team_state_sliding, team_trend, coach_insights, possessions, possession_summary, possessions_at, coach_situations, final_trends, opponent_team)}


def oracle_sql() -> dict[str, str]:
    state, ev = _state(DAY, DAY), f"ev AS ({oracle('tactical')})"
    return {
        "team_state": f"WITH {state} SELECT * FROM state",
        "team_state_sliding": f"WITH {_state(2 * DAY, DAY // 2)} SELECT * FROM state",
        "team_trend": f"WITH {state}, {_trend()} SELECT * FROM trend",
        "coach_insights": f"WITH {state}, {_trend(SCALED)}, {_insights()} SELECT * EXCLUDE (rk) FROM ins",
        "possessions": f"WITH {ev}, {_fold()} SELECT * FROM poss",
        "possession_summary": f"WITH {ev}, {_fold()} SELECT team_id, outcome, count(*) n, round(avg(possession_quality), 4) mean_quality, CAST(sum(n_events) AS BIGINT) n_events FROM poss GROUP BY 1, 2",
        "possessions_at": f"WITH {state}, {_trend(SCALED)}, {_fold()}, {AGG} SELECT * FROM agg",
        "coach_situations": f"WITH {state}, {_trend(SCALED)}, {_insights()}, {_fold()}, {AGG}, {_situations()}",
        "final_trends": f"WITH {state}, {_trend()} SELECT * FROM trend t WHERE tick_us < (SELECT max(tick_us) FROM trend x WHERE x.match_id = t.match_id)",
        "opponent_team": f"WITH {ev}, n AS (SELECT match_id, team_id, count(*) n FROM ev WHERE team_id <> 'A' GROUP BY 1, 2) SELECT match_id, team_id opponent_id, n n_events FROM n QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY n DESC, team_id) = 1",
    }
