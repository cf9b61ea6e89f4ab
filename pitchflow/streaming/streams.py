"""Structured Streaming forms of the stateful operators for rows that arrive in order; see ordered.py for those that don't,
and ticked.py for the team chain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = "player_id bigint, first_event_id bigint, last_event_id bigint, start_us bigint, end_us bigint, mean_speed double"
ALERT = "player_id bigint, event_id bigint, state string, persistence int, episode int"


def dedupe(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each id once, ids forgotten after the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def accumulate_windows(ticks: DataFrame, steps: int = 8, stride: int = 8, gap_us: int = 60_000_000) -> DataFrame:
    """The batch accumulate_windows() on a stream: a player's buffer of fewer than `steps` ticks is its state. Order in a
    micro-batch is arbitrary, so rows are put in order of arrival (event_id) first."""
    drop = min(stride, steps)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for event_id, t_us, speed in zip(rows["event_id"], rows["t_us"], rows["speed_ms"], strict=True):
            if buffer and not 0 <= t_us - buffer[-1][1] <= gap_us:
                buffer = []
            buffer.append((int(event_id), int(t_us), float(speed)))
            if len(buffer) == steps:
                out.append((key[0], buffer[0][0], buffer[-1][0], buffer[0][1], buffer[-1][1], round(pd.Series([b[2] for b in buffer]).mean(), 9)))
                buffer = buffer[drop:]
        state.update(tuple(list(c) for c in zip(*buffer, strict=True)) if buffer else ([], [], []))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW.split(", ")])

    narrow = ticks.select("player_id", "event_id", "t_us", "speed_ms")
    return narrow.groupBy("player_id").applyInPandasWithState(step, WINDOW, "ids array<bigint>, times array<bigint>, speeds array<double>", "append", GroupStateTimeout.NoTimeout)


def alert_states(signals: DataFrame, warn: int = 3, critical: int = 10, recover: int = 3, hold_below: float = 0.4) -> DataFrame:
    """The batch alert_states() on a stream of (player_id, event_id, active, confidence): four counters are the state."""
    names = ("NONE", "WATCH", "WARNING", "CRITICAL", "HOLD")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, p, q, e = state.get if state.exists else (0, 0, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("event_id").itertuples(index=False):
            before = s
            if r.confidence < hold_below:
                s = 4
            elif r.active:
                p, q = p + 1, 0
                s = max(s, 3 if p >= critical else 2 if p >= warn else s)
            else:
                p, q = 0, q + 1
                s = 0 if q >= recover else s
            e += before == 0 and 0 < s < 4  # a signal lifted NONE; HOLD begins no episode
            out.append((key[0], r.event_id, names[s], p, int(e)))
        state.update((s, p, q, int(e)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])

    return signals.select("player_id", "event_id", "active", "confidence").groupBy("player_id").applyInPandasWithState(step, ALERT, "s int, p int, q int, e int", "append", GroupStateTimeout.NoTimeout)


MATCH_STATE = "player_id bigint, event_id bigint, n_windows bigint, n_alerts bigint, consecutive_alerts bigint, mean_score double, peak_score double, peak_hr double, sprints bigint, recent_scores array<double>"
RECENT = 50


def match_state(scored: DataFrame) -> DataFrame:
    """A player's running state after each scored window (player_id, event_id, score, alert, heart_rate, sprints): counts,
    peaks and the last 50 scores. The state is a few numbers and one bounded list; checkpoints keep it over restarts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, alerts, run, total, peak, hr, sprints, recent = state.get if state.exists else (0, 0, 0, 0.0, 0.0, 0.0, 0, [])
        recent, out = list(recent), []
        for r in pd.concat(list(batches)).sort_values("event_id").itertuples(index=False):
            n, total, peak = n + 1, total + float(r.score), max(peak, float(r.score))
            alerts, run = (alerts + 1, run + 1) if r.alert else (alerts, 0)
            hr = hr if r.heart_rate is None or pd.isna(r.heart_rate) else max(hr, float(r.heart_rate))
            sprints += int(r.sprints)
            recent = [*recent, float(r.score)][-RECENT:]
            out.append((key[0], int(r.event_id), n, alerts, run, round(total / n, 9), peak, hr, sprints, list(recent)))
        state.update((n, alerts, run, total, peak, hr, sprints, recent))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MATCH_STATE.split(", ")])

    kept = "n bigint, alerts bigint, run bigint, total double, peak double, hr double, sprints bigint, recent array<double>"
    narrow = scored.select("player_id", "event_id", "score", "alert", "heart_rate", "sprints")
    return narrow.groupBy("player_id").applyInPandasWithState(step, MATCH_STATE, kept, "append", GroupStateTimeout.NoTimeout)


TOPICS = ("possessions", "team_state", "trends", "insights", "situations", "players", "workload")


def publish(outputs: dict[str, DataFrame], path: str, checkpoint: str, keys: dict[str, list[str]]) -> list:
    """A query a topic: each streaming output's rows go to a folder of their own, once by their keys."""
    unknown = set(outputs) - set(TOPICS)
    if unknown:
        raise ValueError(f"no topics: {', '.join(sorted(unknown))}")

    def sink(topic: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, _: publish_new(batch.dropDuplicates(keys[topic]), f"{path}/{topic}", keys[topic], "match_id" if "match_id" in keys[topic] else None)

    return [df.writeStream.foreachBatch(sink(t)).option("checkpointLocation", f"{checkpoint}/{t}").trigger(availableNow=True).start() for t, df in outputs.items()]


def publish_new(batch: DataFrame, path: str, keys: list[str], by: str | None = None) -> None:
    """Appends the rows whose keys the sink lacks: a final row is published once. With `by`, one of the keys, the sink lies
    in a folder for each of its values, and only those of the batch's values are read."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = batch.limit(0)
    if by:
        known = known.join(F.broadcast(batch.select(by).distinct()), by, "left_semi")  # values of one micro-batch
    b, k = batch.alias("b"), known.select(*keys).alias("k")
    on = [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys]
    writer = b.join(k, on, "left_anti").write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)
