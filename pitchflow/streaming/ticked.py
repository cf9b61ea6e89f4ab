"""The team chain recomputed at ticks of match time, its rows published in versions by match (G6, J16)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import team
from .ordered import Ticks, in_order


@dataclass(frozen=True)
class Topic:
    """keys tell a match's rows apart. Rows at the schedule's last time are provisional: `at` is the time and `schedule` the
    topic whose last time per match and `window` it is (insights and situations may be silent at it). Without `at` the
    match's last row by `number` is withheld until the match is over."""

    keys: tuple[str, ...]
    at: str | None = None
    window: str | None = None
    schedule: str | None = None
    number: str | None = None


TOPICS = {
    "possessions": Topic(("seq",), number="seq"),
    "team_state": Topic(("team_id", "window_us", "tick_us"), "tick_us", "window_us"),
    "trends": Topic(("team_id", "window_us", "tick_us"), "tick_us", "window_us"),
    "insights": Topic(("team_id", "window_us", "tick_us", "category"), "tick_us", "window_us", "trends"),
    "situations": Topic(("team_id", "window_us", "tick_us", "situation_type"), "tick_us", "window_us", "trends"),
}
EVENT = (("player_id", "bigint"), ("team_id", "string"), ("event_type", "string"))
Chain = Callable[[DataFrame, bool], dict[str, DataFrame]]


def team_outputs(events: DataFrame, over: bool, short_us: int = 60_000_000, long_us: int = 300_000_000) -> dict[str, DataFrame]:
    """All topics of the given events. Until a match is over, its last possession may still grow: situations don't count
    it."""
    possessions, states = team.possessions(events), team.team_state_dual(events, short_us, long_us)
    trends = team.team_trend(states)
    insights = team.coach_insights(trends)
    counted = possessions
    if not over:
        counted = possessions.withColumn("_last", F.max("seq").over(W.partitionBy("match_id"))).filter("seq < _last").drop("_last")
    return {"possessions": possessions, "team_state": states, "trends": trends, "insights": insights, "situations": team.coach_situations(counted, states, trends, insights)}


def marked(outputs: dict[str, DataFrame], topic: str, spec: Topic, over: bool) -> DataFrame:
    """The topic's rows that may be published, with is_final."""
    rows = outputs[topic]
    if over:
        return rows.withColumn("is_final", F.lit(True))
    if spec.at is None:
        return rows.withColumn("_last", F.max(spec.number).over(W.partitionBy("match_id"))).filter(F.col(spec.number) < F.col("_last")).drop("_last").withColumn("is_final", F.lit(True))
    groups = ["match_id", *([spec.window] if spec.window else [])]
    tails = outputs[spec.schedule or topic].groupBy(*groups).agg(F.max(spec.at).alias("_tail"))
    return rows.join(tails, groups, "left").withColumn("is_final", F.coalesce(F.col(spec.at) < F.col("_tail"), F.lit(False))).drop("_tail").select(*rows.columns, "is_final")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _write(rows: DataFrame, path: str, by: tuple[str, ...] = ("match_id", "batch")) -> None:
    """Replaces the partitions that rows have, so that a micro-batch that is run again leaves one copy."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _equal(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def publish_ticks(landed: DataFrame, ticks: DataFrame, batch_id: int, sink: str, chain: Chain, topics: dict[str, Topic]) -> None:
    """Computes the chain at each of the ticks (match_id, tick, seq, closed) over the match's events up to it and appends
    to each topic's folder the rows that became final and the provisional ones, by match and batch.

    Each tick is a match of its own to the chain, so all of a micro-batch's ticks are one plan. Of what was published
    before, only the folders of these matches are read. A final row's first tick publishes it."""
    spark = landed.sparkSession
    kind = landed.schema["match_id"].dataType.simpleString()
    t = F.broadcast(ticks.select("match_id", "tick", F.col("seq").alias("_upto"), "closed"))  # the ticks of one micro-batch
    seen = landed.join(t, "match_id").filter("seq <= _upto").withColumn("match_id", F.concat_ws("|", F.col("match_id").cast("string"), F.col("tick").cast("string")))
    columns = ("match_id", "t_us", "event_id", *(n for n, _ in EVENT))
    kinds = [r["closed"] for r in ticks.select("closed").distinct().collect()]  # two values at most
    parts = {over: chain(seen.filter(F.col("closed") == over).select(*columns), over) for over in kinds}
    matches = ticks.select("match_id").distinct()
    for topic, spec in topics.items():
        rows = reduce(DataFrame.unionByName, [marked(part, topic, spec, over) for over, part in parts.items()])
        halves = F.split("match_id", "\\|")
        rows = rows.withColumns({"tick": F.element_at(halves, -1).cast("bigint"), "match_id": F.array_join(F.slice(halves, F.lit(1), F.size(halves) - 1), "|").cast(kind)})
        key = ("match_id", *spec.keys)
        first = W.partitionBy(*key, "is_final").orderBy("tick")
        rows = rows.withColumn("_first", F.row_number().over(first)).filter("NOT is_final OR _first = 1").drop("_first")
        before = _read(spark, f"{sink}/{topic}")
        if before is not None:
            before = before.filter(F.col("is_final") & (F.col("batch") < batch_id)).join(F.broadcast(matches), "match_id", "left_semi").select(*key)
            rows = rows.join(before, _equal(rows, before, key), "left_anti")
        _write(rows.withColumn("batch", F.lit(batch_id).cast("bigint")), f"{sink}/{topic}")


def ticked_chain(events: DataFrame, store: str, sink: str, checkpoint: str, every_us: int = 10_000_000, chain: Chain = team_outputs, topics: dict[str, Topic] | None = None, delay: str = "1 minute", idle_ms: int = 3_600_000):
    """A stream writer: events (match_id, t_us, event_id, player_id, team_id, event_type) in any order are numbered in order
    of time per match and land in the store; where every_us of match time passed since the last tick, the chain is
    recomputed over the match's events so far and published. A match without events for idle_ms of event time is over:
    all its rows become final. When a tick is due is told by the events' times alone, not by how they come in batches.

    Late, repeated and conflicting rows land in store/aside. Folders are replaced by batch, so that a micro-batch that is
    run again leaves the same rows."""
    topics = topics or TOPICS

    class Numbered(Ticks):
        out = ", ".join([*(f"{n} {t}" for n, t in EVENT), Ticks.out])

        def row(self, state: dict, row: dict) -> list[tuple]:
            return [(*(row[n] for n, _ in EVENT), *x) for x in super().row(state, row)]

        def end(self, state: dict) -> list[tuple]:
            return [(*(None for _ in EVENT), *x) for x in super().end(state)]

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch", F.lit(batch_id).cast("bigint")).persist()
        try:
            told = batch.filter("kind IN ('row', 'end')").drop("payload")
            if batch.isEmpty():
                return
            _write(batch.filter("kind NOT IN ('row', 'end')").select("kind", "match_id", "t_us", "event_id", "payload", "batch"), f"{store}/aside", ("batch",))
            _write(told, f"{store}/events")
            due = told.filter("tick > 0").select("match_id", "tick", "seq", "closed", "t_us", "batch")
            if due.isEmpty():
                return
            landed = _read(batch.sparkSession, f"{store}/events").filter(F.col("event_id").isNotNull() & (F.col("batch") <= batch_id))
            publish_ticks(landed.select("match_id", "t_us", "event_id", *(n for n, _ in EVENT), "seq"), due.drop("batch", "t_us"), batch_id, sink, chain, topics)
            _write(due, f"{sink}/ticks")
        finally:
            batch.unpersist()

    narrow = events.select("match_id", "t_us", "event_id", *(n for n, _ in EVENT))
    return in_order(narrow, ("match_id",), Numbered(every_us), delay, idle_ms=idle_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, sink: str, topic: str) -> DataFrame:
    """A topic's rows as of each match's last tick: the final ones, and the provisional ones of that tick."""
    rows, ticks = _read(spark, f"{sink}/{topic}"), _read(spark, f"{sink}/ticks")
    last = ticks.groupBy("match_id").agg(F.max("tick").alias("_last"))
    return rows.join(last, "match_id").filter("is_final OR tick = _last").drop("_last", "batch")
