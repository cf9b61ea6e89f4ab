"""Message payloads, table folders, and metadata and reports of match datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a folder and their columns of times.
TABLES = ("players", "sessions", "events", "annotations", "ground_truth_labels")
TIMES = ("ts", "started_at", "ended_at", "annotated_at")
#: A session's begin and end as exports write them.
CLOCK = "M/d/yyyy h:mm:ss a"


def _observation(**given: Column) -> list[Column]:
    kinds = {"source": "string", "player_external_id": "string", "ts": "timestamp", "match_id": "string", "event_type": "string", "latitude": "double", "longitude": "double", "speed_ms": "double", "heart_rate_bpm": "int", "acceleration_ms2": "double"}
    return [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]


def is_valid() -> Column:
    """Coordinates on the globe, no negative speed, a heart rate that someone may have; null passes."""
    fine = lambda c: F.coalesce(c, F.lit(True))
    return F.col("ts").isNotNull() & fine(F.col("latitude").between(-90, 90)) & fine(F.col("longitude").between(-180, 180)) & fine(F.col("speed_ms") >= 0) & fine(F.col("heart_rate_bpm").between(20, 250))


def json_observations(raw: DataFrame, kind: str) -> DataFrame:
    """Valid observations of payloads of a kind (timeline, ws, sensor); see observations()."""
    return observations(raw, kind).filter(is_valid())


def observations(raw: DataFrame, kind: str) -> DataFrame:
    """Observations of payloads: raw (value, and topic for sensors, received). kind timeline: an array of a match's events;
    ws: one object a message; sensor: a value whose player and sensor the topic names. What is no JSON, or has no player,
    is dropped; where a time can't be read, the time of receipt stands in. Works on streams, too."""
    when = lambda c: F.coalesce(F.try_to_timestamp(c), F.col("received"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    if kind == "timeline":
        doc = F.from_json("value", "id string, timeline array<struct<time string, type string, competitor struct<id string>>>")
        e = raw.select("received", doc.alias("d")).select("received", F.col("d.id").alias("match"), F.explode("d.timeline").alias("e"))
        return e.filter(has(F.col("e.competitor.id"))).select(*_observation(source=F.lit("api"), player_external_id=F.col("e.competitor.id"), ts=when(F.col("e.time")), match_id=F.col("match"), event_type=F.col("e.type")))
    if kind == "ws":
        m = raw.select("received", F.from_json("value", "player_id string, ts string, lat double, lon double, speed_ms double, heart_rate int, type string, match_id string").alias("m"))
        return m.filter(has(F.col("m.player_id"))).select(*_observation(source=F.lit("ws"), player_external_id=F.col("m.player_id"), ts=when(F.col("m.ts")), match_id=F.col("m.match_id"), event_type=F.col("m.type"), latitude=F.col("m.lat"), longitude=F.col("m.lon"), speed_ms=F.col("m.speed_ms"), heart_rate_bpm=F.col("m.heart_rate")))
    if kind == "sensor":
        parts = F.split("topic", "/")
        s = raw.select("received", F.get(parts, F.lit(2)).alias("p"), F.get(parts, F.lit(3)).alias("s"), F.from_json("value", "value double, ts string").alias("m"))
        s = s.filter(has(F.col("p")) & F.col("s").isNotNull() & F.col("m.value").isNotNull())
        return s.select(*_observation(source=F.lit("mqtt"), player_external_id=F.col("p"), ts=when(F.col("m.ts")), heart_rate_bpm=F.when(F.col("s") == "hr", F.col("m.value")), acceleration_ms2=F.when(F.col("s") == "accel", F.col("m.value"))))
    raise ValueError(f"no payloads of kind {kind}")


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of a folder; an error names those that are missing. Times that can't be read are null."""
    out, missing = {}, []
    for name in TABLES:
        try:
            df = spark.read.csv(f"{path}/{name}.csv", header=True, inferSchema=True)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            missing.append(name)
            continue
        out[name] = df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in TIMES if c in df.columns})
    if missing:
        raise FileNotFoundError(f"required tables are missing in {path}: {', '.join(missing)}")
    return out


def team_names(description: Column) -> tuple[Column, Column]:
    """(team, opponent) of "A vs. B"; anything else is a team's name without an opponent."""
    text = F.trim(F.regexp_replace(description, '^"|"$', ""))
    pattern = "(?i)^(.*?)\\s+vs\\.?\\s+(.*)$"
    both = text.rlike(pattern)
    return F.when(both, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text), F.when(both, F.trim(F.regexp_extract(text, pattern, 2))).otherwise("")


def statistics_metadata(rows: DataFrame, own_team: str) -> DataFrame:
    """Per file of statistics rows (file and the export's columns): the session id where there is one alone, its begin and
    end, players in all and by side, the teams of the description, and the roster."""
    real = F.coalesce("Group name", F.lit("Ball")) != "Ball"
    clock = lambda c: F.expr(f"try_to_timestamp(`{c}`, '{CLOCK}')")
    pid = F.when(real & (F.coalesce("Player ID", F.lit("")) != ""), F.col("Player ID"))
    own = F.col("Group name") == own_team
    g = rows.groupBy("file").agg(
        F.count_distinct("Session ID").alias("_n"), F.max("Session ID").alias("_s"), F.min(clock("Session begin (Local timezone)")).alias("begin"), F.max(clock("Session end (Local timezone)")).alias("end"), F.min("Description").alias("_d"),
        F.count_distinct(pid).alias("n_players"), F.count_distinct(F.when(own, pid)).alias("n_own"), F.count_distinct(F.when(~own, pid)).alias("n_opponent"), F.array_sort(F.collect_set(pid)).alias("roster"),
    )
    team, opponent = team_names(F.col("_d"))
    return g.select("file", F.when(F.col("_n") == 1, F.expr("try_cast(_s AS bigint)")).alias("session_id"), "begin", "end", "n_players", "n_own", "n_opponent", team.alias("team"), opponent.alias("opponent"), "roster")


def track_metadata(rows: DataFrame) -> DataFrame:
    """Per file of ticks or events (file, ts_ms, player_id): first and last time, players and roster; these files name no
    session or teams."""
    at = lambda c: F.timestamp_millis(c)
    return rows.filter("ts_ms IS NOT NULL").groupBy("file").agg(at(F.min("ts_ms")).alias("begin"), at(F.max("ts_ms")).alias("end"), F.count_distinct("player_id").alias("n_players"), F.array_sort(F.collect_set(F.col("player_id").cast("string"))).alias("roster"))


def match_issues(players: DataFrame, ticks: DataFrame, events: DataFrame) -> DataFrame:
    """match_id, level, issue, n: what is wrong with a match. Errors: a match without players, ticks or events. Warnings:
    times that can't be read, ids without a roster entry and roster entries without ticks, several session ids,
    malformed rows. players: match_id, player_id, session_id; ticks, events: match_id, player_id, ts_ms (null if unread),
    events also malformed."""
    matches = players.select("match_id").union(ticks.select("match_id")).union(events.select("match_id")).distinct()
    parts = [matches.join(t.select("match_id").distinct(), "match_id", "left_anti").select("match_id", F.lit("error").alias("level"), F.lit(f"no {n}").alias("issue"), F.lit(1).cast("long").alias("n")) for t, n in ((players, "players"), (ticks, "ticks"), (events, "events"))]
    warn = lambda df, name: df.groupBy("match_id").agg(F.count("*").alias("n")).select("match_id", F.lit("warning").alias("level"), F.lit(name).alias("issue"), "n")
    roster, seen = players.select("match_id", "player_id").distinct(), ticks.filter("player_id IS NOT NULL").select("match_id", "player_id").distinct()
    sessions = players.groupBy("match_id").agg(F.count_distinct("session_id").alias("n")).filter("n > 1")
    parts += [
        warn(ticks.filter("ts_ms IS NULL"), "unread tick times"), warn(events.filter("ts_ms IS NULL"), "unread event times"), warn(events.filter("malformed"), "malformed rows"),
        warn(seen.join(roster, ["match_id", "player_id"], "left_anti"), "not in roster"), warn(roster.join(seen, ["match_id", "player_id"], "left_anti"), "without ticks"),
        sessions.select("match_id", F.lit("warning").alias("level"), F.lit("several session ids").alias("issue"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_reports(matches: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """summary (one row), quality (issues by match) and inventory of a dataset's matches."""
    per = issues.groupBy("match_id").agg(F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings"), F.array_sort(F.collect_set(F.concat_ws(": ", "level", "issue"))).alias("issues"))
    all_ = matches.join(per, "match_id", "left").fillna(0, ["n_errors", "n_warnings"])
    repeated = matches.groupBy("match_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicate_match_ids"))
    summary = all_.agg(F.count_distinct("match_id").alias("matches_total"), F.count_distinct(F.when(F.col("n_errors") > 0, F.col("match_id"))).alias("matches_failed"), F.count_distinct(F.when(F.col("n_warnings") > 0, F.col("match_id"))).alias("matches_with_warnings"))
    return {"summary": summary.crossJoin(F.broadcast(repeated)), "quality": per.filter("n_errors + n_warnings > 0"), "inventory": matches}  # one row each


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def changed_matches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """match_id, match_dir, fingerprint of matches to be processed: the first directory of an id, where its files' names,
    sizes and times differ from those of the last run. files: match_id, match_dir, path, length, modified (as binaryFile
    tells); manifest: match_id, fingerprint."""
    one = F.concat_ws("|", F.regexp_extract("path", "[^/]*$", 0), F.col("length").cast("string"), F.col("modified").cast("string"))
    per = files.groupBy("match_id", "match_dir").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("fingerprint"))
    first = per.groupBy("match_id").agg(F.min_by(F.struct("match_dir", "fingerprint"), "match_dir").alias("r")).select("match_id", "r.*")
    return first.join(manifest.select("match_id", "fingerprint"), ["match_id", "fingerprint"], "left_anti")
