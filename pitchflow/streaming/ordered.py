"""Stateful streams in order of event time, under one policy for late, repeated and out-of-order rows.

A key's rows wait until the watermark has passed their time and then go, in order of (t_us, event_id), through a Logic
whose state is handed on. A row that comes after the watermark passed its time is put out as `late`; a row whose id is
waiting or was passed within the watermark's delay is put out as `repeat` if its content is the same (told by a
fingerprint) and as `conflict` if not. A timer in event time releases waiting rows; a key without rows for `idle` longer
is closed: its Logic ends and its state goes. No row vanishes, and what a Logic sees doesn't depend on how rows arrive as
long as they are not late.

The streams need spark.sql.streaming.stateStore.providerClass to name the RocksDB state store."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.walks import _plain

KINDS = ("row", "late", "repeat", "conflict", "end")


class Logic:
    """What is computed along a key's rows. A state holds what JSON can: numbers, texts, lists and maps by text."""

    #: Names and types of the result's columns.
    out = ""

    def start(self) -> dict:
        return {}

    def row(self, state: dict, row: dict) -> list[tuple]:
        """Rows of the result for one row; changes the state."""
        raise NotImplementedError

    def end(self, state: dict) -> list[tuple]:
        """Rows of the result when the key is closed."""
        return []


def fingerprint(row: dict) -> str:
    """SHA-256 of the row's id and its content, whatever the order of its columns."""
    content = {k: v for k, v in row.items() if k != "event_id"}
    return hashlib.sha256(f"{row['event_id']}:{json.dumps(content, sort_keys=True, default=str)}".encode()).hexdigest()


class _InOrder(StatefulProcessor):
    def __init__(self, logic: Logic, fields: list[tuple[str, str]], kept_ms: int, idle_ms: int, names: list[str]):
        self.logic, self.fields, self.kept_ms, self.idle_ms, self.names = logic, fields, kept_ms, idle_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"`{n}` {t}" for n, t in self.fields))
        self.ids = handle.getMapState("ids", "event_id bigint", "t_ms bigint, print string")
        self.at = handle.getValueState("at", "last_ms bigint, timer_ms bigint, logic string")

    def _get(self) -> tuple[int, int, dict]:
        if not self.at.exists():
            return -1, -1, self.logic.start()
        last, timer, logic = self.at.get()
        return last, timer, json.loads(logic)

    def _arm(self, timer: int, at: int) -> int:
        """Moves the key's one timer."""
        if timer != at:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        return at

    def _frame(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=self.names, dtype=object)

    def _aside(self, kind: str, key: tuple, row: dict) -> tuple:
        return (kind, *key, row["t_us"], row["event_id"], json.dumps(row, sort_keys=True, default=str), *[None] * (len(self.names) - 4 - len(key)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        found: list[tuple] = []
        last, timer, state = self._get()
        names = [n for n, _ in self.fields]
        first = None
        for batch in rows:
            fresh = []
            for values in batch[names].itertuples(index=False, name=None):
                row = {n: int(v) if t == "bigint" and v is not None else v for (n, t), v in zip(self.fields, map(_plain, values), strict=True)}
                ms = row["t_us"] // 1000
                if ms < passed:
                    found.append(self._aside("late", key, row))
                    continue
                print_ = fingerprint(row)
                if self.ids.containsKey((row["event_id"],)):
                    found.append(self._aside("repeat" if self.ids.getValue((row["event_id"],))[1] == print_ else "conflict", key, row))
                    continue
                self.ids.updateValue((row["event_id"],), (ms, print_))
                fresh.append(tuple(row[n] for n in names))
                first, last = ms if first is None else min(first, ms), max(last, ms)
            if fresh:
                self.waiting.appendList(fresh)
        if first is not None:
            # a timer in use is that of an earlier waiting row, or the one that closes the key
            held = timer if 0 <= timer <= first + 1 else first + 1
            self.at.update((last, self._arm(timer, held), json.dumps(state)))
        yield self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        last, _, state = self._get()
        names = [n for n, _ in self.fields]
        waiting = [dict(zip(names, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in waiting if r["t_us"] // 1000 < passed), key=lambda r: (r["t_us"], r["event_id"]))
        found = [("row", *key, r["t_us"], r["event_id"], None, *x) for r in due for x in self.logic.row(state, r)]
        left = [r for r in waiting if r["t_us"] // 1000 >= passed]
        if not left and last + self.idle_ms < passed:
            found += [("end", *key, None, None, None, *x) for x in self.logic.end(state)]
            self.waiting.clear()
            self.ids.clear()
            self.at.clear()
        else:
            if due and left:
                self.waiting.put([tuple(r[n] for n in names) for r in left])
            elif due:
                self.waiting.clear()
            for (i,), (ms, _) in [x for x in self.ids.iterator() if x[1][0] + self.kept_ms < passed]:
                self.ids.removeKey((i,))
            at = min(r["t_us"] // 1000 for r in left) + 1 if left else last + self.idle_ms + 1
            self.handle.registerTimer(at)
            self.at.update((last, at, json.dumps(state)))
        yield self._frame(found)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: tuple[str, ...], logic: Logic, delay: str = "10 minutes", kept_ms: int = 600_000, idle_ms: int = 3_600_000) -> DataFrame:
    """kind (one of KINDS), the keys, t_us, event_id, payload (JSON of a row that was put aside), and the Logic's columns.

    rows: a stream with the keys, t_us (microseconds), event_id and any plain columns. `delay` is the watermark's, kept_ms
    how long ids of rows that passed are told from new ones, idle_ms when a key is closed. State per key: the rows of the
    delay, their ids, and the Logic's."""
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("spark.sql.streaming.stateStore.providerClass must be the RocksDB state store's")
    fields = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["kind string", *(f"`{k}` {kinds[k]}" for k in keys), "t_us bigint", "event_id bigint", "payload string", logic.out])
    names = ["kind", *keys, "t_us", "event_id", "payload", *(c.split(" ")[0] for c in logic.out.split(", "))]
    # the column that carries the watermark is left out: with it, Spark would drop late rows before they are seen
    timed = rows.withColumn("_time", F.timestamp_micros("t_us")).withWatermark("_time", delay).select(*rows.columns)
    return timed.groupBy(*keys).transformWithStateInPandas(_InOrder(logic, fields, kept_ms, idle_ms, names), schema, "Append", "EventTime")


class Windows(Logic):
    """Full windows of `steps` ticks, `stride` apart; a gap of more than gap_us or another session starts anew (J1)."""

    out = "first_event_id bigint, last_event_id bigint, start_us bigint, end_us bigint, mean_speed double"

    def __init__(self, steps: int = 8, stride: int = 8, gap_us: int = 60_000_000):
        self.steps, self.drop, self.gap_us = steps, min(stride, steps), gap_us

    def start(self) -> dict:
        return {"ticks": [], "session": None}

    def row(self, state: dict, row: dict) -> list[tuple]:
        ticks = state["ticks"]
        if ticks and (row["t_us"] - ticks[-1][1] > self.gap_us or row.get("session_id") != state["session"]):
            ticks.clear()
        state["session"] = row.get("session_id")
        ticks.append([row["event_id"], row["t_us"], row["speed_ms"]])
        if len(ticks) < self.steps:
            return []
        out = (ticks[0][0], ticks[-1][0], ticks[0][1], ticks[-1][1], round(sum(x[2] for x in ticks) / len(ticks), 9))
        del ticks[: self.drop]
        return [out]


class Alerts(Logic):
    """Alert states (J3) of a key, which should name the player and the type of alert."""

    out = "state string, persistence int, episode int"
    names = ("NONE", "WATCH", "WARNING", "CRITICAL", "HOLD", "SAFE_MODE")

    def __init__(self, warn: int = 3, critical: int = 10, recover: int = 3, hold_below: float = 0.4):
        self.warn, self.critical, self.recover, self.hold_below = warn, critical, recover, hold_below

    def start(self) -> dict:
        return {"level": 0, "on": 0, "off": 0, "episode": 0}

    def row(self, state: dict, row: dict) -> list[tuple]:
        if row.get("safe_mode"):
            return [(self.names[5], state["on"], state["episode"])]
        before = state["level"]
        if row["confidence"] is not None and row["confidence"] < self.hold_below:
            state["level"] = 4
        elif row["active"]:
            state["on"], state["off"] = state["on"] + 1, 0
            state["level"] = max(before, 3 if state["on"] >= self.critical else 2 if state["on"] >= self.warn else 0)
        else:
            state["on"], state["off"] = 0, state["off"] + 1
            if state["off"] >= self.recover:
                state["level"] = 0
        state["episode"] += before == 0 and 0 < state["level"] < 4
        return [(self.names[state["level"]], state["on"], state["episode"])]


SEVERITIES = {"low": 0, "medium": 1, "high": 2, "critical": 3}
TRUSTED, SPRINT_MS, RECENT = 0.8, 7.0, 50


class MatchState(Logic):
    """A player's running match state after each scored window (J15).

    Rows: score, telemetry_confidence, speed_ms, heart_rate, hr_recovery; alert (a recommendation, null without one),
    episode; finding, severity, confidence. Below a telemetry confidence of TRUSTED only alerts and findings count. An
    alert of the episode of the one before counts by its kind but neither goes on nor breaks a sequence. The risk level
    follows the alerts since the last two windows in a row without one; a pattern is the finding that alerts go on with."""

    out = "n_scored bigint, mean_score double, peak_score double, peak_hr double, sprints bigint, fatigue_alerts bigint, workload_alerts bigint, anomaly_alerts bigint, consecutive_alerts bigint, first_alert_us bigint, finding_state string, n_findings bigint, transitions map<string,bigint>, recent_scores array<double>, risk_windows bigint, risk_level string, pattern string, pattern_windows bigint, closed boolean"

    def start(self) -> dict:
        zero = dict.fromkeys(("n", "total", "peak", "hr", "sprints", "fatigue", "workload", "anomaly", "run", "risk", "clean", "pattern_n"), 0)
        return zero | {"first": None, "last_alert": "", "episode": None, "findings": [], "moves": {}, "scores": [], "pattern": ""}

    def row(self, s: dict, row: dict) -> list[tuple]:
        if (row["telemetry_confidence"] or 0.0) >= TRUSTED:
            s["n"], s["total"], s["peak"] = s["n"] + 1, s["total"] + row["score"], max(s["peak"], row["score"])
            s["hr"] = max(s["hr"], row["heart_rate"] or 0.0)
            s["sprints"] += (row["speed_ms"] or 0.0) >= SPRINT_MS
            s["scores"] = [*s["scores"], row["score"]][-RECENT:]
        state = None
        if row["finding"] is not None:
            minute, severity, confidence = row["t_us"] // 60_000_000, SEVERITIES.get(row["severity"], 0), 0.5 if row["confidence"] is None else row["confidence"]
            if s["findings"]:
                kind, _, sure, at = s["findings"][-1]
                if 0 <= minute - at <= 3 and min(sure, confidence) >= 0.55:
                    move = f"{kind}>{row['finding']}"
                    s["moves"][move] = s["moves"].get(move, 0) + 1
            before = next((f for f in reversed(s["findings"]) if f[0] == row["finding"]), None)
            state = finding_step(before and before[1], before and before[2], severity, confidence)
            s["findings"] = [*s["findings"], [row["finding"], severity, confidence, minute]][-RECENT:]
        if row["alert"] is not None:
            s["fatigue" if "fatigue" in row["alert"] else "workload" if "workload" in row["alert"] else "anomaly"] += 1
            if row["episode"] is None or row["episode"] != s["episode"]:
                s["run"] = s["run"] + 1 if s["last_alert"] == row["alert"] else 1
                s["episode"], s["last_alert"] = row["episode"], row["alert"]
                s["first"] = row["t_us"] if s["first"] is None else s["first"]
            s["clean"], s["risk"] = 0, s["risk"] + 1
            if row["finding"] is not None:
                s["pattern_n"] = s["pattern_n"] + 1 if row["finding"] == s["pattern"] else 1
                s["pattern"] = row["finding"]
        else:
            s["clean"] += 1
            if s["clean"] >= 2:
                s["risk"], s["pattern_n"], s["pattern"], s["clean"] = 0, 0, "", 0
        return [self._told(s, state, False)]

    def end(self, s: dict) -> list[tuple]:
        return [self._told(s, None, True)]

    def _told(self, s: dict, state: str | None, closed: bool) -> tuple:
        level = "critical" if s["risk"] >= 8 else "high" if s["risk"] >= 5 else "elevated" if s["risk"] >= 3 else "normal"
        mean = round(s["total"] / s["n"], 9) if s["n"] else 0.0
        return (s["n"], mean, float(s["peak"]), float(s["hr"]), s["sprints"], s["fatigue"], s["workload"], s["anomaly"], s["run"], s["first"], state, len(s["findings"]), dict(s["moves"]), [float(x) for x in s["scores"]], s["risk"], level, s["pattern"], s["pattern_n"], closed)


def finding_step(severity_before: int | None, confidence_before: float | None, severity: int, confidence: float) -> str:
    """A finding's state against the last one of its type."""
    if severity_before is None or confidence_before is None:
        return "active"
    if severity > severity_before or confidence > confidence_before + 0.10:
        return "escalating"
    if confidence < confidence_before - 0.10:
        return "resolving"
    return "stabilizing" if severity == severity_before and abs(confidence - confidence_before) < 0.05 else "active"


class Ticks(Logic):
    """A number for each event of a match and, where `every_us` of match time passed since the last tick (the first event
    begins), a tick: tick numbers go up from 1, 0 is no tick. The match's end is a tick of its own, with closed true."""

    out = "seq bigint, tick bigint, closed boolean"

    def __init__(self, every_us: int):
        self.every_us = every_us

    def start(self) -> dict:
        return {"seq": 0, "tick": 0, "at": None}

    def row(self, state: dict, row: dict) -> list[tuple]:
        state["seq"] += 1
        state["at"] = row["t_us"] if state["at"] is None else state["at"]
        due = row["t_us"] - state["at"] >= self.every_us
        if due:
            state["tick"], state["at"] = state["tick"] + 1, row["t_us"]
        return [(state["seq"], state["tick"] if due else 0, False)]

    def end(self, state: dict) -> list[tuple]:
        return [(state["seq"], state["tick"] + 1, True)]
