"""Registered queries over datasets, splits and journals, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, journal
from ..sources import readers
from .views import importable, oracle, view

HOUR = 3_600_000_000


def _tables(spark, d, *names):
    importable(spark)
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def _sessions(spark, d):
    """Sessions of up to four hours, and files that begin within days of them."""
    orders, lines = _tables(spark, d, "orders", "lineitem")
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long") * 24 * HOUR
    begin = day("o_orderdate") + F.col("o_orderkey") % 24 * HOUR
    roster = F.array(*[(F.col("o_custkey") + k) % 20 for k in (0, 1, 5)])
    s = orders.select(F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderkey")).alias("session_id"), begin.alias("begin_us"), F.when(F.col("o_orderkey") % 7 > 0, begin + F.col("o_custkey") % 5 * HOUR).alias("end_us"), roster.alias("roster"))
    start = day("l_shipdate") + F.col("l_partkey") % 24 * HOUR
    o = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("file"), F.when(F.col("l_linenumber") % 2 == 0, "events").otherwise("positions").alias("kind"), F.when(F.col("l_suppkey") % 9 > 0, start).alias("begin_us"), (start + F.col("l_linenumber") * HOUR).alias("end_us"), F.array(F.col("l_suppkey") % 20, F.col("l_partkey") % 20).alias("roster"))
    return s, o


def pair_bundles(spark, d):
    return readers.pair_bundles(*_sessions(spark, d))


def bundle_inventory(spark, d):
    bundles = readers.pair_bundles(*_sessions(spark, d))
    return readers.bundle_inventory(bundles, _tables(spark, d, "orders")[0].filter("o_custkey % 11 = 0").select(F.col("o_orderkey").alias("session_id")))


def split_sessions(spark, d):
    return evaluation.split_sessions(view(spark, d, "telemetry").select("event_id", "match_id", "player_id").withColumn("session", F.concat_ws("-", "match_id", "player_id")), "session")


def _journal(spark, d):
    """A mutation an event: of a player's state, by keys of which some hold maps."""
    e = view(spark, d, "telemetry")
    op = F.element_at(F.array(*map(F.lit, ("set", "update", "increment", "delete", "increment", "update", "set", "increment"))), (F.col("event_id") % 8 + 1).cast("int"))
    key = F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))
    sub = F.when(op.isin("set", "update") & (F.col("event_id") % 3 == 0), F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")))
    repeated = F.when(F.col("event_id") % 10 == 9, F.col("event_id") - 5).otherwise(F.col("event_id"))
    return e.select(F.col("player_id").alias("target"), F.col("event_id").alias("seq"), repeated.alias("event_id"), F.col("t_us").alias("at"), op.alias("op"), key.alias("key"), sub.alias("sub"), F.col("speed_ms").alias("value"), F.lit(0).cast("bigint").alias("pos"))


def journal_state(spark, d):
    return journal.rebuild_targets(_journal(spark, d)).select("target", "key", "sub", F.round("value", 6).alias("value"), "error")


def journal_lists(spark, d):
    j = _journal(spark, d).withColumn("op", F.when(F.col("seq") % 2 == 0, "append").otherwise(F.col("op")))
    return journal.rebuild_lists(j)


def queries() -> dict:
    return {f.__name__: f for f in (pair_bundles, bundle_inventory, split_sessions, journal_state, journal_lists)}


def oracle_sql() -> dict[str, str]:
    begin = "epoch_us(CAST(CAST({0} AS DATE) AS TIMESTAMP)) + {1} % 24 * 3600000000"
    o, s = begin.format("l_shipdate", "l_partkey"), begin.format("o_orderdate", "o_orderkey")
    pairs = f"""WITH s AS (SELECT o_orderkey AS session_id, {s} - 7200000000 AS b, CASE WHEN o_orderkey % 7 > 0 THEN {s} + o_custkey % 5 * 3600000000 ELSE {s} END + 7200000000 AS e, [(o_custkey + k) % 20 FOR k IN [0, 1, 5]] AS roster FROM orders WHERE o_orderkey % 50 > 0),
f AS (SELECT l_orderkey || '-' || l_linenumber AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'events' ELSE 'positions' END AS kind, CASE WHEN l_suppkey % 9 > 0 THEN {o} END AS b, {o} + l_linenumber * 3600000000 AS e, list_distinct([l_suppkey % 20, l_partkey % 20]) AS roster FROM lineitem),
j AS (SELECT f.file, f.kind, s.session_id, len(list_filter(f.roster, lambda x: list_contains(s.roster, x))) AS shared FROM f JOIN s ON f.b <= s.e AND f.e >= s.b),
p AS (SELECT d.file, d.kind, session_id, CAST(coalesce(shared, 0) AS INT) AS shared FROM (SELECT DISTINCT file, kind FROM f) d LEFT JOIN (FROM j QUALIFY row_number() OVER (PARTITION BY file, kind ORDER BY shared DESC, session_id DESC) = 1) b ON b.file = d.file AND b.kind = d.kind)"""
    rows = f"""WITH e AS ({oracle("telemetry")}), j AS (SELECT player_id AS target, event_id AS seq, CASE WHEN event_id % 10 = 9 THEN event_id - 5 ELSE event_id END AS event_id, t_us AS tm, ['set', 'update', 'increment', 'delete', 'increment', 'update', 'set', 'increment'][event_id % 8 + 1] AS op,
 'k' || event_id % 3 AS key, CASE WHEN event_id % 8 NOT IN (2, 3, 4, 7) AND event_id % 3 = 0 THEN 's' || event_id % 5 END AS sub, speed_ms AS value FROM e),
c AS (SELECT * FROM j QUALIFY seq = min(seq) OVER (PARTITION BY event_id))"""
    return {
        "pair_bundles": f"{pairs} SELECT * FROM p",
        "bundle_inventory": f"""{pairs}, g AS (SELECT session_id, list_sort(list(DISTINCT kind)) AS kinds, count(*) AS n_files FROM p GROUP BY 1)
SELECT session_id, n_files, CASE WHEN session_id IS NULL THEN 'orphaned' WHEN session_id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 11 = 0) THEN 'duplicate' WHEN len(kinds) = 2 THEN 'ready' ELSE 'incomplete' END AS status FROM g""",
        "split_sessions": f"""WITH e AS (SELECT event_id, match_id, player_id, match_id || '-' || player_id AS session FROM ({oracle("telemetry")})),
r AS (SELECT session, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || session), 1, 13) AS BIGINT), session) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM e))
SELECT event_id, match_id, player_id, session, CASE WHEN rank < greatest(floor(n * 0.7), 1) THEN 'train' WHEN rank < greatest(floor(n * 0.7), 1) + greatest(floor(n * 0.15), 1) THEN 'validate' ELSE 'calibrate' END AS split FROM e JOIN r USING (session)""",
        # each key's mutations are folded one by one: v is the plain value, m the map as text, x whether it failed
        "journal_state": f"""{rows.replace("WITH e", "WITH RECURSIVE e", 1)}, q AS (SELECT *, row_number() OVER (PARTITION BY target, key ORDER BY tm, seq) AS rn FROM c),
f AS (SELECT target, key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DOUBLE) AS v, MAP {{}}::MAP(VARCHAR, DOUBLE) AS m, false AS x FROM (SELECT DISTINCT target, key FROM q)
 UNION ALL SELECT q.target, q.key, q.rn, CASE WHEN q.op = 'delete' OR q.sub IS NOT NULL THEN NULL WHEN q.op = 'increment' THEN CASE WHEN cardinality(f.m) > 0 THEN NULL ELSE coalesce(f.v, 0) + q.value END ELSE q.value END,
  CASE WHEN q.op = 'delete' OR (q.sub IS NULL AND q.op <> 'increment') THEN MAP {{}}::MAP(VARCHAR, DOUBLE) WHEN q.op = 'increment' THEN f.m WHEN q.op = 'set' THEN MAP {{q.sub: q.value}} ELSE map_concat(f.m, MAP {{q.sub: q.value}}) END,
  CASE WHEN q.op IN ('set', 'delete') OR (q.op = 'update' AND q.sub IS NULL) THEN false ELSE f.x OR (q.op = 'increment' AND cardinality(f.m) > 0) END
 FROM f JOIN q ON q.target = f.target AND q.key = f.key AND q.rn = f.rn + 1),
z AS (SELECT * FROM f QUALIFY rn = max(rn) OVER (PARTITION BY target, key))
SELECT target, key, CAST(NULL AS VARCHAR) AS sub, CASE WHEN NOT x THEN round(v, 6) END AS value, CASE WHEN x THEN 'an increment meets a map' END AS error FROM z WHERE x OR v IS NOT NULL
UNION ALL SELECT target, key, u.key, round(u.value, 6), NULL FROM (SELECT target, key, unnest(map_entries(m)) AS u FROM z WHERE NOT x)""",
        "journal_lists": f"""{rows} SELECT target, row_number() OVER (PARTITION BY target ORDER BY tm, seq) - 1 AS index, value FROM c WHERE seq % 2 = 0""",
    }
