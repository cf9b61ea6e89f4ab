"""Readers of exported match files and telemetry, and the datasets made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.thresholds import TELEMETRY, TelemetryThresholds
from ..operators.intervals import best_overlaps
from ..operators.telemetry import clean_positions

# Position codes, event labels and their canonical types, the columns by which files are told.
POSITIONS = {"TW": "goalkeeper", "KR": "pivot", "RM": "centre_back", "RR": "right_back", "RL": "left_back", "RA": "right_wing", "LA": "left_wing"}
LABELS = {
    "Acceleration": "acceleration_event", "Deceleration": "deceleration_event", "Ball Possession": "possession", "Ball Possession Recovery": "possession", "Ball Possession Lost": "turnover", "Change of Direction": "change_of_direction",
    "Exertion": "exertion_event", "Impact": "impact_event", "Jump": "jump_event", "Pass": "pass", "Shots": "shot", "Sprint": "sprint_event",
}
SLOTS = {
    "Acceleration": ("duration_s", "distance_m", "max_speed_kmh", "max_ms2", "avg_ms2", "speed_change_kmh", "category"), "Deceleration": ("duration_s", "distance_m", "max_speed_kmh", "max_ms2", "avg_ms2", "speed_change_kmh", "category"),
    "Ball Possession": ("duration_s",), "Ball Possession Recovery": ("opponent_id",), "Ball Possession Lost": ("opponent_id",), "Change of Direction": ("magnitude_deg", "max_decel", "max_accel", "direction"),
    "Exertion": ("duration_s", "load_avg", "load_max", "distance_m", "max_speed_kmh", "level"), "Impact": ("magnitude_g", "speed_kmh"), "Jump": ("airtime_s", "height_m", "distance_m", "jump_ratio_max", "category"),
    "Pass": ("distance_m", "ball_speed_kmh", "outplayed", "receiving_player_id", "pass_type"), "Shots": ("distance_m", "ball_speed_kmh"), "Sprint": ("duration_s", "distance_m", "max_speed_kmh", "avg_speed_kmh", "category"),
}
HEADERS = {"positions": ("ts in ms", "mapped id", "x in m"), "statistics": ("Player ID", "Session ID", "Position"), "events": ("Timestamp (ms)", "Event type")}
HEADER_LINES = 13


def _lookup(col: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


def read_positions(spark: SparkSession, path: str, t: TelemetryThresholds = TELEMETRY) -> DataFrame:
    """Ticks of a positions export: the ball and rows without an integer id or time are dropped, implausible values flagged
    as clean_positions() does. Coordinates stay in metres."""
    raw = spark.read.csv(path, sep=";", header=True)
    num = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    t_ms, pid = F.expr("try_cast(`ts in ms` AS bigint)"), F.expr("try_cast(`mapped id` AS int)")
    kept = raw.filter((F.coalesce("group name", F.lit("")) != "Ball") & t_ms.isNotNull() & pid.isNotNull())
    hr = num("heart rate in bpm") if "heart rate in bpm" in raw.columns else F.lit(None).cast("double")
    ticks = kept.select((t_ms * 1000).alias("t_us"), pid.alias("player_id"), F.col("full name").alias("name"), F.expr("try_cast(`number` AS int)").alias("jersey"), F.col("group name").alias("team"), num("x in m").alias("x_pitch"), num("y in m").alias("y_pitch"), num("speed in m/s").alias("speed_ms"), num("acceleration in m/s2").alias("acceleration_ms2"), hr.alias("heart_rate_bpm"))
    return clean_positions(ticks, t).withColumnsRenamed({"x_pitch": "x_m", "y_pitch": "y_m"})


def read_roster(spark: SparkSession, path: str, own_team: str) -> DataFrame:
    """Players of a statistics export, the ball dropped, with their position's name and whose team they are in."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="iso-8859-1")
    pid = F.expr("try_cast(`Player ID` AS int)")
    rows = raw.filter(pid.isNotNull() & (F.coalesce("Group name", F.lit("")) != "Ball"))
    return rows.select(pid.alias("player_id"), F.nullif(F.trim("Name"), F.lit("")).alias("name"), F.coalesce(_lookup(F.col("Position"), POSITIONS), F.lower("Position")).alias("position"), F.col("Group name").alias("team"), F.when(F.col("Group name") == own_team, "OWN").otherwise("OPPONENT").alias("ownership"), F.expr("try_cast(`Session ID` AS bigint)").alias("session_id"), F.col("Description").alias("description"))


def backfill_roster(roster: DataFrame, ticks: DataFrame) -> DataFrame:
    """Names that the roster lacks, from each player's first tick that has one."""
    first = ticks.filter("name IS NOT NULL").groupBy("player_id").agg(F.min_by("name", "t_us").alias("_name"), F.min_by("jersey", "t_us").alias("jersey"))
    return roster.join(first, "player_id", "left").withColumn("name", F.coalesce("name", "_name")).drop("_name")


def raw_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an events export after its header, split, with file order: the line's number in its file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    body = lines.filter((F.col("line") >= HEADER_LINES) & (F.trim("value") != ""))
    s = F.split("value", ";")
    return body.select("line", s.alias("slots"), F.expr("try_cast(get(split(value, ';'), 0) AS bigint)").alias("ts_ms"), F.expr("try_cast(get(split(value, ';'), 2) AS int)").alias("player_id"), F.trim(F.get(s, F.lit(3))).alias("name"), F.trim(F.get(s, F.lit(4))).alias("label"))


def events_long(raw: DataFrame) -> DataFrame:
    return raw.select("line", "ts_ms", "player_id", "name", "label", *[F.nullif(F.get("slots", F.lit(4 + i)), F.lit("")).alias(f"value_{i}") for i in range(1, 8)])


def read_tactical_events(raw: DataFrame, roster: DataFrame, match_id: str, source: str = "tracking") -> DataFrame:
    """Events with canonical types, a map of their label's slots, the player's team and a reproducible id."""
    meta = F.lit(None).cast("map<string,string>")
    for label, names in SLOTS.items():
        pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.nullif(F.get("slots", F.lit(5 + i)), F.lit("")) for i in range(len(names))]))
        meta = F.when(F.col("label") == label, F.map_filter(pairs, lambda _, v: v.isNotNull())).otherwise(meta)
    known = raw.filter(~F.coalesce(F.col("name").endswith(" Ball"), F.lit(False)) & F.col("ts_ms").isNotNull() & F.col("player_id").isNotNull())
    e = known.withColumn("event_type", _lookup(F.col("label"), LABELS)).filter("event_type IS NOT NULL").withColumn("metadata", meta)
    e = e.join(roster.select("player_id", F.col("team").alias("team_id")), "player_id", "left")
    return with_event_id(e.withColumns({"match_id": F.lit(match_id), "source": F.lit(source)}), "line").drop("slots")


def with_event_id(events: DataFrame, order: str) -> DataFrame:
    """event_key: a hash of match, source, time, player and type, and which repeat of these the row is in file order."""
    parts = ["match_id", "source", "ts_ms", "player_id", "event_type"]
    occurrence = F.row_number().over(W.partitionBy(*parts).orderBy(order)) - 1
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in parts], occurrence.cast("string"))
    return events.withColumn("event_key", F.sha2(text, 256))


def tactical_event_stats(raw: DataFrame) -> DataFrame:
    status = F.when(F.coalesce(F.col("name").endswith(" Ball"), F.lit(False)), "ball").when(F.col("ts_ms").isNull() | F.col("player_id").isNull(), "error").when(_lookup(F.col("label"), LABELS).isNull(), "unknown_label").otherwise("parsed")
    return raw.groupBy(status.alias("status"), "label").count()


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file's kind by the columns of its first line."""
    first = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").withColumn("_n", F.monotonically_increasing_id())
    head = first.groupBy("file").agg(F.min_by("value", "_n").alias("header")).withColumn("columns", F.transform(F.split("header", ";"), lambda c: F.trim(c)))
    kind = F.lit("unsupported")
    for name, needed in HEADERS.items():
        kind = F.when(F.size(F.array_intersect("columns", F.array(*map(F.lit, needed)))) == len(needed), name).otherwise(kind)
    return head.select("file", kind.alias("kind"))


def pair_bundles(statistics: DataFrame, others: DataFrame, tolerance_us: int = 7_200_000_000) -> DataFrame:
    """Files (file, kind, begin_us, end_us, roster) with the session (session_id, begin_us, end_us, roster) whose time
    overlaps within the tolerance, best by shared players, then the larger session id; else orphaned. Sessions without an
    id are skipped. No pairs are formed (intervals.best_overlaps)."""
    wide = statistics.filter("session_id IS NOT NULL").select("session_id", "roster", (F.col("begin_us") - tolerance_us).alias("begin_us"), (F.coalesce("end_us", "begin_us") + tolerance_us).alias("end_us"))
    return best_overlaps(others, wide, ("file", "kind"), "session_id", "roster").withColumnRenamed("id", "session_id")


def bundle_inventory(bundles: DataFrame, existing: DataFrame) -> DataFrame:
    """ready, duplicate, incomplete or orphaned per session."""
    kinds = bundles.groupBy("session_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n_files"))
    e = existing.select("session_id", F.lit(True).alias("_known"))
    status = F.when(F.col("session_id").isNull(), "orphaned").when(F.col("_known"), "duplicate").when(F.size(F.array_intersect("kinds", F.array(F.lit("events"), F.lit("positions")))) == 2, "ready").otherwise("incomplete")
    return kinds.join(e, "session_id", "left").select("session_id", "n_files", status.alias("status"))


def id_differences(ticks: DataFrame, roster: DataFrame) -> DataFrame:
    a = ticks.select("player_id").distinct().join(roster, "player_id", "left_anti").withColumn("issue", F.lit("not_in_roster"))
    return a.unionByName(roster.select("player_id").distinct().join(ticks, "player_id", "left_anti").withColumn("issue", F.lit("without_ticks")))


def upsert_matches(new: DataFrame, path: str) -> None:
    """Replaces the partitions of the matches that new holds; others stay as they are."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(path)


TELEMETRY_SCHEMA = "player_external_id string, ts string, match_id string, session_id string, speed_ms double, heart_rate_bpm int, x_pitch double, y_pitch double, distance_delta_m double, is_sprint boolean, elapsed_seconds double"


def parse_telemetry(lines: DataFrame) -> DataFrame:
    """Rows of newline-delimited JSON (value); bad JSON and rows without a player are skipped. Works on streams, too."""
    parsed = lines.select(F.from_json("value", TELEMETRY_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).filter("r IS NOT NULL").select("r.*")
    return parsed.filter("player_external_id IS NOT NULL").withColumn("ts", F.try_to_timestamp("ts"))


def read_telemetry_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the telemetry lines that land in a folder."""
    return parse_telemetry(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def replay_source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A recorded match as a stream, a file after the other in order of their times; how fast is up to the trigger."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").parquet(path)


def encode_records(df: DataFrame, kind: str, version: str = "1") -> DataFrame:
    """schema_version, type, match_id, payload: the wire form of a table's rows."""
    return df.select(F.lit(version).alias("schema_version"), F.lit(kind).alias("type"), F.col("match_id").cast("string").alias("match_id"), F.to_json(F.struct(*df.columns)).alias("payload"))


def rejected_records(wire: DataFrame, kinds: dict[str, str], version: str = "1") -> DataFrame:
    """wire rows that no reader takes, and why: an unknown version or type, or a payload that is no JSON of its type."""
    known = F.col("type").isin(*kinds)
    broken = F.lit(False)
    for kind, schema in kinds.items():
        read = F.from_json("payload", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        broken = F.when(F.col("type") == kind, read.isNull() | read["_corrupt"].isNotNull()).otherwise(broken)
    reason = F.when(~F.coalesce(F.col("schema_version") == version, F.lit(False)), "unknown version").when(~F.coalesce(known, F.lit(False)), "unknown type").when(broken, "malformed payload")
    return wire.withColumn("reason", reason).filter("reason IS NOT NULL")


def decode_records(wire: DataFrame, kind: str, schema: str, version: str = "1") -> DataFrame:
    """Rows of one type; what rejected_records() names is left out."""
    read = F.from_json("payload", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    fine = wire.filter((F.col("schema_version") == version) & (F.col("type") == kind)).select(read.alias("r")).filter("r IS NOT NULL AND r._corrupt IS NULL")
    return fine.select("r.*").drop("_corrupt")


def replay_export(events: DataFrame, path: str, players: list[str] | None = None, max_elapsed: float | None = None) -> None:
    """Newline-delimited JSON in global order (elapsed, time, player), nulls kept: of some players, up to a time, or all.
    Without a column of external ids they follow from player_id (p007)."""
    missing = {"ts", "elapsed_seconds"} - set(events.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    e = events if "player_external_id" in events.columns else events.withColumn("player_external_id", F.format_string("p%03d", F.col("player_id").cast("int")))
    if players is not None:
        e = e.filter(F.col("player_external_id").isin(*players))
    if max_elapsed is not None:
        e = e.filter(F.col("elapsed_seconds") <= max_elapsed)
    e.orderBy("elapsed_seconds", "ts", "player_external_id").write.option("ignoreNullFields", "false").json(path)


def gps_fixes(lines: DataFrame) -> DataFrame:
    """Recommended-minimum sentences (source, value) to lat, lon, speed: knots if given, else the distance from the fix
    before over the time."""
    s = F.split("value", ",")
    degrees = lambda i, n: F.expr(f"try_cast(substring(get(split(value, ','), {i}), 1, {n}) AS double) + try_cast(substring(get(split(value, ','), {i}), {n + 1}, 20) AS double) / 60")
    fixes = lines.filter(F.get(s, F.lit(0)).endswith("RMC") & (F.get(s, F.lit(2)) == "A"))
    clock = F.expr("try_cast(substring(get(split(value, ','), 1), 1, 2) AS double) * 3600 + try_cast(substring(get(split(value, ','), 1), 3, 2) AS double) * 60 + try_cast(substring(get(split(value, ','), 1), 5, 10) AS double)")
    f = fixes.select("source", clock.alias("t_s"), F.when(F.get(s, F.lit(4)) == "S", -degrees(3, 2)).otherwise(degrees(3, 2)).alias("lat"), F.when(F.get(s, F.lit(6)) == "W", -degrees(5, 3)).otherwise(degrees(5, 3)).alias("lon"), F.expr("try_cast(get(split(value, ','), 7) AS double)").alias("knots"))
    w = W.partitionBy("source").orderBy("t_s")
    a = F.pow(F.sin(F.radians(F.col("lat") - F.lag("lat").over(w)) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians(F.lag("lat").over(w))) * F.pow(F.sin(F.radians(F.col("lon") - F.lag("lon").over(w)) / 2), 2)
    metres = 2 * 6_371_000 * F.asin(F.sqrt(a))
    return f.withColumn("speed_ms", F.coalesce(F.col("knots") * 0.514444, metres / (F.col("t_s") - F.lag("t_s").over(w)))).drop("knots")
