"""Views that give the driver's tables the shape of tracking data: one SQL text for Spark and for the oracle engine."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

WEEK = "CAST(floor({T_US} / CAST(604800000000 AS DOUBLE)) AS BIGINT) AS match_id"
VIEWS = {
    "telemetry": f"""SELECT event_id, user_id AS player_id, {{T_US}} AS t_us, {WEEK}, value / CAST(10 AS DOUBLE) AS speed_ms,
       CAST((event_id * 13) % 31 - 15 AS DOUBLE) AS acceleration_ms2, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 60 + (event_id * 7) % 170 END AS heart_rate_bpm,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS x_pitch, CAST((event_id * 37) % 101 AS DOUBLE) AS y_pitch FROM events""",
    "tactical": f"""SELECT event_id, user_id AS player_id, {{T_US}} AS t_us, {WEEK},
       CASE WHEN user_id % 10 = 9 THEN NULL WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team_id,
       CASE event_type WHEN 'signup' THEN 'possession' WHEN 'error' THEN 'turnover' WHEN 'purchase' THEN 'shot' WHEN 'click' THEN 'pass' ELSE 'sprint_event' END AS event_type
       FROM events""",
    "coach": f"""SELECT event_id AS coach_event_id, {WEEK}, user_id AS player_id, {{T_US}} + ((event_id % 7) - 3) * 1200000000 AS t_us, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team_id,
       CASE event_id % 4 WHEN 0 THEN 'goal' WHEN 1 THEN 'shot' WHEN 2 THEN 'save' ELSE 'timeout' END AS event_type FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0""",
    "scored": """SELECT event_id, user_id AS player_id, {T_US} AS t_us, value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CASE WHEN value > 100 THEN 1 ELSE 0 END AS pred FROM events""",
    "loads": """SELECT o.o_custkey AS player_id, o.o_orderkey AS match_id, sum(l.l_quantity) AS acceleration_load, sum(l.l_discount) * 100 AS deceleration_load,
       sum(l.l_tax) * 100 AS sprint_load, sum(l.l_extendedprice) AS distance_covered FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, o.o_orderkey""",
    "sessions": """SELECT o.o_custkey AS player_id, o.o_orderkey AS session_id, CAST(o.o_orderdate AS DATE) AS started_on, max(o.o_totalprice) / 100 AS total_distance_m, count(*) AS sprint_count,
       max(l.l_quantity) / 5 AS max_speed_ms, sum(CASE WHEN l.l_quantity >= 25 THEN l.l_quantity ELSE 0 END) AS high_speed_distance_m
       FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, o.o_orderkey, CAST(o.o_orderdate AS DATE)""",
    "inferences": """SELECT o.o_orderkey AS inference_id, o.o_custkey AS player_id, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_anomaly, c.c_mktsegment AS position, c.c_nationkey AS nationality
       FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
}
_P = "(PARTITION BY player_id)"
_O = "(PARTITION BY player_id ORDER BY bucket)"
_Z = lambda c: f"round(({c} - avg({c}) OVER {_P}) / nullif(stddev_pop({c}) OVER {_P}, 0), 6)"
#: Half-day windows of a player with the features and attributions that findings are made of.
VIEWS["features"] = f"""SELECT w.*, distance_z / 10 AS a_distance, (6 - window_avg_speed_ms) / 20 AS a_speed, (heart_rate_bpm - 140) / 500 AS a_hr, hr_recovery_time_s / 3 AS a_recovery,
       speed_drop_pct / 400 AS a_drop, (acwr - 1) / 4 AS a_acwr, (positional_drift_score - 1) / 5 AS a_drift FROM (
 SELECT player_id, match_id, bucket, row_number() OVER {_O} AS seq, round(spd, 6) AS window_avg_speed_ms, round(dist, 6) AS window_distance_m, spr AS window_sprint_count, round(hr, 6) AS heart_rate_bpm,
       round((hr - lag(hr) OVER {_O}) / greatest(lag(hr) OVER {_O}, 1), 6) AS hr_recovery_time_s, {_Z("dist")} AS distance_z, {_Z("spr")} AS sprint_z, {_Z("top")} AS speed_z, {_Z("hsd")} AS high_speed_z,
       round(100 * (first_value(spd) OVER {_O} - spd) / nullif(first_value(spd) OVER {_O}, 0), 6) AS speed_drop_pct, round((dist - avg(dist) OVER {_P}) * 5, 6) AS fatigue_decay_residual,
       round(dist / nullif(avg(dist) OVER (PARTITION BY player_id ORDER BY bucket ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0), 6) AS acwr,
       round(abs(x - avg(x) OVER {_P}) / nullif(stddev_pop(x) OVER {_P}, 0), 6) AS positional_drift_score, (row_number() OVER {_O}) % 8 AS persistence_windows
 FROM (SELECT player_id, match_id, CAST(floor(t_us / CAST(43200000000 AS DOUBLE)) AS BIGINT) AS bucket, avg(speed_ms) AS spd, max(speed_ms) AS top, sum(speed_ms) * 3 AS dist, CAST(sum(CASE WHEN speed_ms >= 5.5 THEN 1 ELSE 0 END) AS BIGINT) AS spr,
       sum(CASE WHEN speed_ms >= 4.17 THEN speed_ms ELSE 0 END) AS hsd, avg(heart_rate_bpm) AS hr, avg(x_pitch) AS x FROM ({VIEWS["telemetry"]}) GROUP BY 1, 2, 3)) w"""
#: Quarter-day buckets of a player in a match, told as if each took ten minutes, with what loads are made of.
VIEWS["buckets"] = f"""SELECT match_id, player_id, bucket, bucket * 600 AS elapsed_s, CAST(count(*) AS BIGINT) AS n_ticks, round(avg(speed_ms), 6) AS mean_speed, max(speed_ms) AS max_speed, round(sum(speed_ms), 6) AS distance,
       CAST(sum(CASE WHEN acceleration_ms2 > 5 THEN 1 ELSE 0 END) AS DOUBLE) AS n_accel, avg(CASE WHEN acceleration_ms2 > 5 THEN acceleration_ms2 END) AS mean_accel, CAST(sum(CASE WHEN acceleration_ms2 < -5 THEN 1 ELSE 0 END) AS DOUBLE) AS n_decel,
       avg(CASE WHEN acceleration_ms2 < -5 THEN acceleration_ms2 END) AS mean_decel, round(sum(CASE WHEN speed_ms >= 5.5 THEN speed_ms ELSE 0 END), 6) AS sprint_distance
 FROM (SELECT *, CAST(floor((t_us - min(t_us) OVER (PARTITION BY match_id, player_id)) / CAST(21600000000 AS DOUBLE)) AS BIGINT) AS bucket FROM ({VIEWS["telemetry"]})) GROUP BY 1, 2, 3"""
#: Statistics of players by match, in whole sessions ("A vs. B") or halves.
VIEWS["stats"] = """SELECT CAST(floor(o.o_orderkey / CAST(256 AS DOUBLE)) AS BIGINT) AS match_id, CASE WHEN o.o_custkey % 37 = 0 THEN NULL ELSE o.o_custkey % 20 END AS player_id,
       CASE WHEN l.l_linenumber = 1 AND o.o_custkey % 3 = 0 THEN concat('A vs. B ', CAST(o.o_orderkey AS VARCHAR(20))) WHEN l.l_linenumber = 7 THEN NULL ELSE concat('half ', CAST(l.l_linenumber AS VARCHAR(20)), ' of ', CAST(o.o_orderkey AS VARCHAR(20))) END AS description,
       o.o_orderkey * CAST(1000000000000 AS BIGINT) + l.l_linenumber * CAST(100000000000 AS BIGINT) + l.l_partkey * CAST(100000 AS BIGINT) + l.l_suppkey AS begin_us, CASE WHEN l.l_linenumber = 5 THEN NULL ELSE CAST(l.l_quantity * 10 AS DOUBLE) END AS distance_m, CAST(l.l_linenumber AS DOUBLE) AS sprints, CAST(l.l_suppkey % 9 AS DOUBLE) AS accelerations,
       CAST(l.l_partkey % 7 AS DOUBLE) AS decelerations, CAST(l.l_quantity AS DOUBLE) AS distance_high_m, CASE WHEN l.l_quantity > 40 THEN NULL ELSE CAST(l.l_quantity / 4 AS DOUBLE) END AS distance_very_high_m, CAST(l.l_partkey % 3600 AS DOUBLE) AS time_on_field_s,
       CASE WHEN l.l_suppkey % 5 = 0 THEN NULL ELSE concat('pos', CAST(o.o_custkey % 4 AS VARCHAR(20))) END AS position, CASE WHEN o.o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS team, CASE WHEN o.o_custkey % 2 = 0 THEN 'OWN' ELSE 'OPPONENT' END AS ownership
       FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey"""
#: Matches of the tracking data; some dates can't be read where the player is odd.
VIEWS["matches"] = f"""SELECT match_id, concat('dir', CAST(match_id % 3 AS VARCHAR(20))) AS match_dir, CAST(date_add(DATE '2024-01-01', CAST(match_id % 50 AS INT)) AS VARCHAR(30)) AS date, CAST(count(*) AS BIGINT) AS n_events FROM ({VIEWS["telemetry"]}) GROUP BY 1, 2, 3"""
VIEWS["matches"] = VIEWS["matches"].replace("date_add(DATE '2024-01-01', CAST(match_id % 50 AS INT))", "{DAY_OF_MATCH}")
#: Tracked events with the labels and text slots of an export; some slots lack, some hold no number.
VIEWS["labelled"] = f"""SELECT event_id, user_id AS player_id, {{T_US}} AS t_us, {WEEK}, CASE event_id % 9 WHEN 0 THEN 'Acceleration' WHEN 1 THEN 'Deceleration' WHEN 2 THEN 'Sprint' WHEN 3 THEN 'Jump' WHEN 4 THEN 'Change of Direction' WHEN 5 THEN 'Ball Possession' WHEN 6 THEN 'Pass' WHEN 7 THEN 'Shots' ELSE 'Exertion' END AS label,
       CAST((event_id * 7) % 50 - 10 AS VARCHAR(20)) AS value_1, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 11) % 60 AS VARCHAR(20)) END AS value_2, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE CAST((event_id * 3) % 35 AS VARCHAR(20)) END AS value_3,
       CAST((event_id * 13) % 17 - 8 AS VARCHAR(20)) AS value_4, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 5) % 9 - 4 AS VARCHAR(20)) END AS value_5 FROM events"""
#: A player's findings in order: stretches of one type with others between them, jumps of the clock, some missing minutes.
VIEWS["symptoms"] = """SELECT event_id, player_id, t_us, score, CASE (CAST(floor(rn / CAST(8 AS DOUBLE)) AS BIGINT) * 2 + CASE WHEN event_id % 12 = 0 THEN 1 ELSE 0 END + CASE WHEN rn > 40 THEN rn % 3 ELSE 0 END) % 3 WHEN 0 THEN 'cardiovascular_overload' WHEN 1 THEN 'locomotor_overload' ELSE 'recovery_degradation' END AS finding,
       CASE WHEN event_id % 17 = 0 AND event_id % 23 > 0 AND event_id % 29 > 0 THEN NULL ELSE rn + 4 * CAST(floor(rn / CAST(21 AS DOUBLE)) AS BIGINT) END AS minute, CASE WHEN event_id % 29 = 0 THEN 'critical' WHEN event_id % 23 = 0 THEN 'high' WHEN event_id % 2 = 0 THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN event_id % 31 = 0 THEN 'escalating' WHEN event_id % 37 = 0 THEN 'resolving' WHEN event_id % 3 = 0 THEN 'stabilizing' ELSE 'active' END AS state, (event_id % 7) / CAST(10 AS DOUBLE) AS confidence
 FROM (SELECT event_id, user_id AS player_id, {T_US} AS t_us, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY {T_US}, event_id) AS rn FROM events)"""
TABLES = {"symptoms": "events", "labelled": "events", "buckets": "events", "stats": "orders lineitem", "matches": "events", "features": "events", "telemetry": "events", "tactical": "events", "coach": "events", "scored": "events", "loads": "orders lineitem", "sessions": "orders lineitem", "inferences": "orders customer"}


def importable(spark: SparkSession) -> None:
    """Lets Python workers that start from now on find this package where the driver found it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables in sf_dir; timestamps without a zone are read as UTC."""
    importable(spark)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name].split()}
    sql = VIEWS[name].replace("{T_US}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{DAY_OF_MATCH}", "date_add(DATE '2024-01-01', CAST(match_id % 50 AS INT))")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **tables)


def oracle(name: str) -> str:
    return VIEWS[name].replace("{T_US}", "epoch_us(ts)").replace("{DAY_OF_MATCH}", "DATE '2024-01-01' + CAST(match_id % 50 AS INT)")
