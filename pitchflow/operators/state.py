"""Alert states, risk, episodes and gates: folds over a player's signals in order."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .walks import Walk, ordered_walk

STATES = ("NONE", "WATCH", "WARNING", "CRITICAL", "HOLD", "SAFE_MODE")


def alert_states(signals: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], warn: int = 3, critical: int = 10, recover: int = 3, hold_below: float = 0.4, safe_mode: str | None = None) -> DataFrame:
    """State after each signal (active, confidence). Under hold_below: HOLD, counters untouched. Active: one more in a row,
    WARNING from `warn` on, CRITICAL from `critical` on, only upward (so HOLD, the highest, is left by recovering alone).
    Inactive: the run ends, and `recover` of them in a row lead to NONE. An episode begins where an active signal lifts
    NONE. Rows whose column safe_mode is true are SAFE_MODE and change nothing.

    No fold: runs are islands, a recovery begins an era, and a state is the highest that its era has seen. All windows
    share the partitioning by keys."""
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    safe = F.coalesce(F.col(safe_mode).cast("boolean"), F.lit(False)) if safe_mode else F.lit(False)
    on = F.coalesce(F.col("active").cast("boolean"), F.lit(False))
    hold = ~safe & F.coalesce(F.col("confidence") < hold_below, F.lit(False))
    n = lambda c: c.cast("int")
    r = signals.select(*keys, *order, n(safe).alias("_safe"), n(hold).alias("_hold"), n(~safe & ~hold & on).alias("_on"), n(~safe & ~hold & ~on).alias("_off"))
    r = r.withColumns({"_offs": F.sum("_off").over(upto), "_ons": F.sum("_on").over(upto)})
    run = lambda flag, island: F.sum(flag).over(W.partitionBy(*keys, island).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)).cast("int")
    r = r.withColumns({"persistence": run("_on", "_offs"), "_calm": run("_off", "_ons")})
    r = r.withColumn("_reset", n((F.col("_off") == 1) & (F.col("_calm") >= recover))).withColumn("_era", F.sum("_reset").over(upto))
    rise = F.when(F.col("_on") == 0, 0).when(F.col("persistence") >= critical, 3).when(F.col("persistence") >= warn, 2).otherwise(0)
    era = W.partitionBy(*keys, "_era").orderBy(*order)
    before = era.rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("_rise", rise).withColumns({"_held": F.max("_hold").over(era.rowsBetween(W.unboundedPreceding, 0)), "_top": F.max("_rise").over(era.rowsBetween(W.unboundedPreceding, 0)), "_was": F.coalesce(F.max("_rise").over(before), F.lit(0)), "_was_held": F.coalesce(F.max("_hold").over(before), F.lit(0))})
    begins = n((F.col("_rise") > 0) & (F.col("_was") == 0) & (F.col("_was_held") == 0))
    state = F.when(F.col("_safe") == 1, 5).when(F.col("_held") == 1, 4).otherwise(F.col("_top"))
    return r.withColumn("_b", begins).select(*keys, *order, F.element_at(F.array(*map(F.lit, STATES)), state + 1).alias("state"), "persistence", F.sum("_b").over(upto).cast("int").alias("episode"))


def risk_trajectory(windows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Alerts since the last two clean windows in a row, and the level they give: 3, 5 and 8 are its steps. With a column
    finding, also pattern, the last finding that an alert came with since then, and pattern_windows, in how many alerts on
    end it was that one: an alert without a finding neither counts nor ends a pattern."""
    w = W.partitionBy(*keys).orderBy(*order)
    clean = (F.col("alert") == 0).cast("int")
    r = windows.withColumn("_reset", F.coalesce(clean * F.lag(clean).over(w), F.lit(0))).withColumn("_island", F.sum("_reset").over(w.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy(*keys, "_island").orderBy(*order)
    upto, before = island.rowsBetween(W.unboundedPreceding, 0), island.rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("total", F.sum("alert").over(upto))
    level = F.when(F.col("total") >= 8, "critical").when(F.col("total") >= 5, "high").when(F.col("total") >= 3, "elevated").otherwise("normal")
    out = [*keys, *order, F.col("total").cast("long").alias("total"), level.alias("level")]
    if "finding" in windows.columns:
        r = r.withColumn("_f", F.when(F.col("alert") != 0, F.col("finding")))
        r = r.withColumns({"pattern": F.last("_f", True).over(upto), "_was": F.last("_f", True).over(before)})
        r = r.withColumn("_run", F.sum((F.col("_f").isNotNull() & ~F.col("_f").eqNullSafe(F.col("_was"))).cast("int")).over(upto))
        run = W.partitionBy(*keys, "_island", "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        r = r.withColumn("_n", F.count("_f").over(run))
        out += ["pattern", F.when(F.col("pattern").isNull(), 0).otherwise(F.col("_n")).cast("long").alias("pattern_windows")]
    return r.select(*out)


# The family of alerts that a recommendation belongs to.
FAMILIES = {"anomaly_flag": "physiological_instability", "substitution": "physiological_instability", "fatigue_alert": "physiological_instability", "positional_drift": "tactical_instability", "workload_alert": "workload_instability"}


def alert_family(recommendation: Column) -> Column:
    """The family of a recommendation's alerts; null for a name without one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), recommendation)


class _Gate(Walk):
    def __init__(self, order: tuple[str, ...], cooldown_us: int):
        self.order, self.cooldown_us, self.last, self.at = list(order), cooldown_us, None, 0

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for *at, family in rows[[*self.order, "family"]].itertuples(index=False, name=None):
            if family is None:
                self.last = None
            ok = family is not None and not (family == self.last and at[0] - self.at < self.cooldown_us)
            if ok:
                self.last, self.at = family, at[0]
            out.append((*at, family, ok))
        return out


def alert_gate(alerts: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], cooldown_us: int) -> DataFrame:
    """Alerts that pass: one of the family that passed last is held back within the cooldown; another family, or a row
    without one, opens the gate. Whether a row passes depends on which passed before, so rows are walked in order; the
    state is the last family and its time."""
    kinds = {f.name: f.dataType.simpleString() for f in alerts.schema}
    out = ", ".join([*(f"{c} {kinds[c]}" for c in order), "family string", "passed boolean"])
    return ordered_walk(alerts.select(*keys, *order, "family"), keys, order, partial(_Gate, order, cooldown_us), out)


def finding_transitions(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], least: float = 0.55, within: int = 3) -> DataFrame:
    """Counts and add-one probabilities of one finding type after another: neighbours in order, both of enough
    confidence, no more than `within` minutes apart."""
    w = W.partitionBy(*keys).orderBy(*order)
    r = findings.withColumns({"_b": F.lag("finding").over(w), "_c": F.lag("confidence").over(w), "_m": F.lag("minute").over(w)})
    ok = (F.col("_c") >= least) & (F.col("confidence") >= least) & (F.col("minute") - F.col("_m")).between(0, within)
    n = r.filter(ok).groupBy(F.col("_b").alias("source"), F.col("finding").alias("target")).agg(F.count("*").alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("total"))
    return n.join(total, "source").select("source", "target", "n", "total", F.round((F.col("n") + 1) / (F.col("total") + 2), 9).alias("probability"))


def finding_state(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], last: int = 50) -> DataFrame:
    """Each finding against the last one of its type among the player's last 50: escalating where its severity, or its
    confidence by over 0.1, is above; resolving where its confidence is below by over 0.1; stabilizing where the severity
    is the same and the confidence within 0.05; else, and without such a finding, active."""
    w = W.partitionBy(*keys).orderBy(*order)
    r = findings.withColumn("_rn", F.row_number().over(w))
    p = F.lag(F.struct("severity", "confidence", "_rn")).over(W.partitionBy(*keys, "finding").orderBy(*order))
    r = r.withColumn("_p", p)
    near = F.coalesce(F.col("_rn") - F.col("_p._rn") <= last, F.lit(False))
    more = F.col("confidence") - F.col("_p.confidence")
    up = (F.col("severity") > F.col("_p.severity")) | (F.col("confidence") > F.col("_p.confidence") + 0.1)
    same = (F.col("severity") == F.col("_p.severity")) & (F.abs(more) < 0.05)
    state = F.when(~near, "active").when(up, "escalating").when(F.col("confidence") < F.col("_p.confidence") - 0.1, "resolving").when(same, "stabilizing").otherwise("active")
    return r.select(*keys, *order, "finding", state.alias("state"))


def episodes(findings: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], within: int = 2, least: int = 2) -> DataFrame:
    """Runs of findings of one type, neighbours at most `within` minutes apart; those of `least` windows or more."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = (F.lag("finding").over(w) != F.col("finding")) | (F.abs(F.col("minute") - F.lag("minute").over(w)) > within)
    r = findings.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("episode", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = r.groupBy(*keys, "episode").agg(F.first("finding").alias("finding"), F.min("minute").alias("start_minute"), F.max("minute").alias("end_minute"), F.count("*").alias("n_windows"), F.max("severity").alias("severity"), F.round(F.avg("confidence"), 9).alias("confidence"))
    return e.filter(F.col("n_windows") >= least)


def rebuild_state(journal: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Value of each key after its journal: the last set or delete, and the increments after it."""
    w = W.partitionBy(*keys).orderBy(*order)
    fixed = F.col("op").isin("set", "delete")
    since = F.sum(fixed.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    r = journal.withColumn("_era", since)
    r = r.withColumn("_now", F.max("_era").over(W.partitionBy(*keys))).filter("_era = _now")
    v = F.sum(F.when(F.col("op").isin("set", "increment"), F.col("value")).otherwise(0))
    return r.groupBy(*keys).agg(F.round(v, 6).alias("value"), F.bool_or(F.col("op") == "delete").alias("_d"), F.count("*").alias("_n")).filter("NOT _d OR _n > 1").drop("_d", "_n")
