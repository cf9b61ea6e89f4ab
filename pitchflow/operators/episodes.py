"""Episodes of findings: runs of one type, gates, cooldown, trend, response and merging."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .walks import Walk, _plain, ordered_walk

# Fixed values
SEVERITIES = ("low", "medium", "high", "critical")
HIGH, CRITICAL = 2, 3
MERGE_MINUTES, LEAST_WINDOWS, LEAST_CONFIDENCE, COOLDOWN = 2, 5, 0.55, 2

EPISODE = "episode bigint, finding string, start_minute bigint, end_minute bigint, trend string, severity string, response string, n_windows bigint, peak_score double, peak_confidence double"


def _same(x: DataFrame, y: DataFrame, columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [x[c].eqNullSafe(y[c]) for c in columns])


def finding_groups(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], within: int = MERGE_MINUTES) -> DataFrame:
    """A row for each run of findings of one type whose neighbours are at most `within` minutes apart (a missing minute
    parts none): at, finding, start_minute, end_minute, n_windows, level (0 low to 3 critical), peak_confidence, peak_score,
    trend, response, is_last.

    findings: finding, minute, severity, confidence, state, score. Missing: a finding is "unknown", a severity low, a
    confidence 0.5, a state active; missing scores are no scores.

    trend of two findings or more: worsening if one escalates, recovering if one resolves; else as the mean severity of the
    second half is above or below that of the first; else worsening if its mean confidence is above by over 0.05. response:
    by the state of the key's last finding of the type, if it comes later (resolved, escalated, else persisted); else, if any
    finding comes later, escalated or resolved by the run's last state; else by that state, persisted where it stabilizes or
    is active. peak_score is the highest of the key's last n_windows scores, 0 if it has fewer.

    All windows share the partitioning by keys, and rows stream through them; only runs go on."""
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    level = F.coalesce(sum((F.when(F.col("severity") == s, k).otherwise(0) for k, s in enumerate(SEVERITIES)), F.lit(0)), F.lit(0))
    r = findings.select(*keys, *order, F.coalesce("finding", F.lit("unknown")).alias("finding"), F.col("minute").cast("long").alias("minute"), F.when(F.col("severity").isNull(), 0).otherwise(level).alias("level"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce("state", F.lit("active")).alias("state"), F.col("score").cast("double").alias("score"))
    r = r.withColumns({"at": F.row_number().over(w), "_type": F.lag("finding").over(w), "_minute": F.lag("minute").over(w)})
    parts = F.coalesce((F.col("_type") != F.col("finding")) | F.coalesce(F.abs(F.col("minute") - F.col("_minute")) > within, F.lit(False)), F.lit(True))
    r = r.withColumn("grp", F.sum(parts.cast("int")).over(upto))
    whole, run = W.partitionBy(*keys), W.partitionBy(*keys, "grp")
    r = r.withColumns({"_n": F.count("*").over(run), "_first": F.min("at").over(run), "_all": F.max("at").over(whole), "_later": F.max(F.struct("at", "state")).over(W.partitionBy(*keys, "finding"))})
    early = F.col("at") - F.col("_first") < F.floor(F.col("_n") / 2)
    mean = lambda c, half: F.avg(F.when(half, F.col(c)))
    timed = F.when(F.col("minute").isNotNull(), F.struct("at", "minute"))
    g = r.groupBy(*keys, "grp").agg(
        F.first("finding").alias("finding"), F.min("at").alias("at"), F.max("at").alias("_to"), F.max("_all").alias("_all"), F.count("*").alias("n_windows"), F.max("level").alias("level"), F.max("confidence").alias("peak_confidence"),
        F.min(timed)["minute"].alias("start_minute"), F.max(timed)["minute"].alias("end_minute"), F.max(F.struct("at", "state"))["state"].alias("_state"), F.max("_later").alias("_later"),
        F.bool_or(F.col("state") == "escalating").alias("_up"), F.bool_or(F.col("state") == "resolving").alias("_down"), mean("level", early).alias("_s1"), mean("level", ~early).alias("_s2"), mean("confidence", early).alias("_c1"), mean("confidence", ~early).alias("_c2"),
    )
    trend = F.when(F.col("n_windows") < 2, "stable").when(F.col("_up"), "worsening").when(F.col("_down"), "recovering").when(F.col("_s2") > F.col("_s1"), "worsening").when(F.col("_s2") < F.col("_s1"), "recovering").when(F.col("_c2") > F.col("_c1") + 0.05, "worsening").otherwise("stable")
    by = lambda state, otherwise: F.when(state == "resolving", "resolved").when(state == "escalating", "escalated").otherwise(otherwise)
    is_last = F.col("_to") == F.col("_all")
    trailing = by(F.col("_state"), F.when(F.col("_state").isin("stabilizing", "active"), "persisted").otherwise("unknown"))
    response = F.when(F.col("_later.at") > F.col("_to"), by(F.col("_later.state"), "persisted")).when(~is_last, F.when(F.col("_state") == "escalating", "escalated").otherwise("resolved")).otherwise(trailing)
    g = g.withColumns({"trend": trend, "response": response, "is_last": is_last})
    back = W.partitionBy(*keys).orderBy(F.desc("at"))
    tops = r.filter("score IS NOT NULL").select(*keys, "at", "score").withColumns({"n_windows": F.row_number().over(back).cast("long"), "top": F.max("score").over(back.rowsBetween(W.unboundedPreceding, 0))})
    g = g.join(tops.select(*keys, "n_windows", "top"), _same(g, tops, (*keys, "n_windows")), "left").select(*[g[c] for c in g.columns], "top")
    return g.select(*keys, "at", "finding", "start_minute", "end_minute", "n_windows", "level", "peak_confidence", F.coalesce("top", F.lit(0.0)).alias("peak_score"), "trend", "response", "is_last")


class _Episodes(Walk):
    """Runs to episodes. Holds the last index that closed for each type and the episodes that are still open."""

    def __init__(self, least_windows: int, least_confidence: float, cooldown: int):
        self.least_windows, self.least_confidence, self.cooldown = least_windows, least_confidence, cooldown
        self.next, self.closed, self.open = 1, {}, []

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for r in rows.itertuples(index=False):
            start, end = (None if (x := _plain(v)) is None else int(x) for v in (r.start_minute, r.end_minute))
            if r.known:
                e = {"i": int(r.at), "finding": r.finding, "start": start, "end": end, "trend": r.trend, "level": int(r.level), "response": r.response, "n": int(r.n_windows), "score": float(r.peak_score), "confidence": float(r.peak_confidence)}
                self.next = max(self.next, e["i"] + 1)
                if end is None:
                    self.open.append(e)
                else:
                    self.closed[r.finding] = e["i"]
                    out.append(self._row(e))
                continue
            n, level, confidence, high = int(r.n_windows), int(r.level), float(r.peak_confidence), r.level >= HIGH
            e = next((x for x in reversed(self.open) if x["finding"] == r.finding), None)
            if e is not None:
                e |= {"n": n, "score": max(e["score"], float(r.peak_score)), "confidence": max(e["confidence"], confidence), "trend": r.trend, "response": r.response, "level": level}
                e["start"] = start if e["start"] is None else e["start"]
                if not r.is_last:
                    gate = self._gate(n, e["confidence"], high)
                    if gate:
                        out.append(self._held(r, gate))
                    else:
                        e["end"], self.closed[r.finding] = end, e["i"]
                        if end is not None:
                            self.open.remove(e)
                            out.append(self._row(e))
                continue
            if not r.is_last:
                since = self.next - self.closed[r.finding] if r.finding in self.closed else None
                gate = "cooldown" if self.cooldown > 0 and level < CRITICAL and since is not None and since < self.cooldown else self._gate(n, confidence, high)
                if gate:
                    out.append(self._held(r, gate))
                    continue
            e = {"i": self.next, "finding": r.finding, "start": start, "end": None if r.is_last else end, "trend": r.trend, "level": level, "response": r.response, "n": n, "score": float(r.peak_score), "confidence": confidence}
            self.next += 1
            if not r.is_last:
                self.closed[r.finding] = e["i"]
            if e["end"] is None:
                self.open.append(e)
            else:
                out.append(self._row(e))
        return out

    def _gate(self, n: int, confidence: float, high: bool) -> str | None:
        return None if high else "min_windows" if n < self.least_windows else "confidence" if confidence < self.least_confidence else None

    def _row(self, e: dict) -> tuple:
        return e["i"], e["finding"], e["start"], e["end"], e["trend"], SEVERITIES[e["level"]], e["response"], e["n"], e["score"], e["confidence"], None

    def _held(self, r, gate: str) -> tuple:
        return None, r.finding, None, None, None, None, None, int(r.n_windows), None, None, gate

    def end(self) -> list[tuple]:
        return [self._row(e) for e in self.open]


def episode_steps(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], existing: DataFrame | None = None, within: int = MERGE_MINUTES, least_windows: int = LEAST_WINDOWS, least_confidence: float = LEAST_CONFIDENCE, cooldown: int = COOLDOWN) -> DataFrame:
    """Episodes before merging (gate null) and the runs that a gate held back (gate says which; episode null).

    In order of a key's runs: a run extends the last open episode of its type, else begins one, open if it is the last run.
    An episode of a run that isn't the last closes with it. Below high severity that needs least_windows findings and a
    confidence of least_confidence; below critical a type that closed `cooldown` episodes ago or less does not begin again.
    `existing`: episodes of before, which come first."""
    g = finding_groups(findings, keys, order, within).withColumn("known", F.lit(False))
    if existing is not None:
        level = sum((F.when(F.col("severity") == s, k).otherwise(0) for k, s in enumerate(SEVERITIES)), F.lit(0))
        e = existing.select(*keys, F.col("episode").cast("long").alias("at"), "finding", F.col("start_minute").cast("long").alias("start_minute"), F.col("end_minute").cast("long").alias("end_minute"), F.col("n_windows").cast("long").alias("n_windows"), level.alias("level"), "peak_confidence", "peak_score", "trend", "response", F.lit(False).alias("is_last"), F.lit(True).alias("known"))
        g = g.withColumn("at", F.col("at").cast("long")).unionByName(e)
    g = g.withColumn("_turn", (~F.col("known")).cast("int"))
    return ordered_walk(g, keys, ("_turn", "at"), lambda: _Episodes(least_windows, least_confidence, cooldown), f"{EPISODE}, gate string")


def merge_adjacent(episodes: DataFrame, keys: tuple[str, ...], gap: int = MERGE_MINUTES + 1) -> DataFrame:
    """Neighbours of one type, both closed and at most `gap` minutes apart (or without a start), become the first of them,
    which then ends with the last; windows add up, peaks and severity are the highest, a later worsening prevails, and so
    does the last response of a later one that escalated or persisted."""
    w = W.partitionBy(*keys).orderBy("episode")
    near = F.col("start_minute").isNull() | (F.col("start_minute") - F.lag("end_minute").over(w) <= gap)
    joins = (F.lag("finding").over(w) == F.col("finding")) & F.col("end_minute").isNotNull() & F.lag("end_minute").over(w).isNotNull() & near
    level = sum((F.when(F.col("severity") == s, k).otherwise(0) for k, s in enumerate(SEVERITIES)), F.lit(0))
    e = episodes.withColumns({"_joins": F.coalesce(joins, F.lit(False)), "_level": level}).withColumn("_of", F.sum((~F.col("_joins")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = lambda c: F.min(F.struct("episode", c))[c]
    bad = F.max(F.when(F.col("_joins") & F.col("response").isin("escalated", "persisted"), F.struct("episode", "response")))["response"]
    m = e.groupBy(*keys, "_of").agg(
        F.min("episode").alias("episode"), F.first("finding").alias("finding"), first("start_minute").alias("start_minute"), F.max(F.struct("episode", "end_minute"))["end_minute"].alias("end_minute"),
        F.when(F.bool_or(F.col("_joins") & (F.col("trend") == "worsening")), "worsening").otherwise(first("trend")).alias("trend"), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max("_level") + 1).alias("severity"),
        F.coalesce(bad, first("response")).alias("response"), F.sum("n_windows").alias("n_windows"), F.max("peak_score").alias("peak_score"), F.max("peak_confidence").alias("peak_confidence"),
    )
    return m.drop("_of")


def segment_episodes(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], existing: DataFrame | None = None, within: int = MERGE_MINUTES, least_windows: int = LEAST_WINDOWS, least_confidence: float = LEAST_CONFIDENCE, cooldown: int = COOLDOWN) -> DataFrame:
    """A key's episodes, the open ones without an end_minute: keys, episode, finding, start_minute, end_minute, trend,
    severity, response, n_windows, peak_score, peak_confidence. Runs are islands, gates and cooldown a walk over runs that
    holds the open episodes only, merging islands again. Without findings a key keeps its existing episodes."""
    steps = episode_steps(findings, keys, order, existing, within, least_windows, least_confidence, cooldown)
    return merge_adjacent(steps.filter("gate IS NULL").drop("gate"), keys, within + 1)


def gate_counts(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], existing: DataFrame | None = None) -> DataFrame:
    """How many runs of a key each gate held back."""
    return episode_steps(findings, keys, order, existing).filter("gate IS NOT NULL").groupBy(*keys, "gate").agg(F.count("*").alias("n"))


def newly_closed(episodes: DataFrame, history: DataFrame | None, keys: tuple[str, ...], least: int = 2) -> DataFrame:
    """The closed episodes of `least` windows or more that the history (keys, episode) lacks: each is kept once, when it is
    first seen closed."""
    done = episodes.filter(F.col("end_minute").isNotNull() & (F.col("n_windows") >= least))
    if history is None:
        return done
    known = history.select(*keys, "episode")
    return done.join(known, _same(done, known, (*keys, "episode")), "left_anti")


NARRATIVE_LENGTH = 200


def trajectory_narrative(episodes: DataFrame, escalation: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, narrative: a sentence of 200 characters at most on how a key's episodes went on, from the first to the last,
    whether more of them worsened or recovered, and its level of escalation (keys, level; "normal" without a row)."""
    end = lambda f, c: f(F.struct("episode", c))[c]
    e = episodes.groupBy(*keys).agg(
        F.count("*").alias("n"), *[end(f, c).alias(f"_{name}_{c}") for name, f, c in (("first", F.min, "finding"), ("first", F.min, "start_minute"), ("last", F.max, "finding"), ("last", F.max, "end_minute"))],
        F.count_if(F.col("trend") == "worsening").alias("_worse"), F.count_if(F.col("trend") == "recovering").alias("_better"),
    )
    j = e.join(escalation.select(*keys, "level"), _same(e, escalation, keys), "full").select(*[F.coalesce(e[k], escalation[k]).alias(k) for k in keys], *[e[c] for c in e.columns if c not in keys], "level")
    arc = F.when(F.col("_worse") > F.col("_better"), "progressive deterioration").when(F.col("_better") > F.col("_worse"), "improving trajectory").otherwise("fluctuating state")
    start = F.coalesce(F.concat(F.lit("from min~"), F.col("_first_start_minute").cast("string")), F.lit("from early match"))
    stop = F.coalesce(F.concat(F.lit("to min~"), F.col("_last_end_minute").cast("string")), F.lit("ongoing"))
    named = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    n, first, last, level = F.col("n").cast("string"), named("_first_finding"), named("_last_finding"), F.concat(F.lit(" Escalation: "), F.coalesce("level", F.lit("normal")), F.lit("."))
    one = F.concat(n, F.lit(" episode(s) of "), first, F.lit(" — "), arc, F.lit(" "), start, F.lit(", "), stop, F.lit("."), level)
    two = F.concat(n, F.lit(" episode(s): "), first, F.lit(" ("), start, F.lit(") → "), last, F.lit(" ("), stop, F.lit(") — "), arc, F.lit("."), level)
    text = F.when(F.col("n").isNull(), "No significant episodes detected yet.").otherwise(F.substring(F.when(first == last, one).otherwise(two), 1, NARRATIVE_LENGTH))
    return j.select(*keys, text.alias("narrative"))
