"""Thresholds, scores, episodes, evaluation, feedback and fairness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dynamic_threshold(losses: DataFrame, by: str, value: str, least: int = 30, many: int = 150) -> DataFrame:
    """threshold of each group from its losses without those above their 95th percentile (all, if under 15 remain): the
    99.5th percentile of 150 or more, else median + 5 * 1.4826 * MAD; infinite under `least` losses."""
    q = losses.groupBy(by).agg(F.percentile(value, F.lit(0.95)).alias("p95"), F.count(value).alias("n"), F.count_if(F.col(value).isNotNull()).alias("_"))
    j = losses.join(q.select(by, "p95", "n"), by)
    few = j.groupBy(by).agg(F.count_if(F.col(value) <= F.col("p95")).alias("kept"))
    clean = j.join(few, by).filter((F.col("kept") < 15) | (F.col(value) <= F.col("p95")))
    mid = clean.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("mid"), F.percentile(value, F.lit(0.995)).alias("high"), F.count("*").alias("n_clean"), F.first("n").alias("n"))
    mad = clean.join(mid.select(by, "mid"), by).groupBy(by).agg(F.percentile(F.abs(F.col(value) - F.col("mid")), F.lit(0.5)).alias("mad"))
    out = mid.join(mad, by)
    t = F.when(F.col("n") < least, F.lit(float("inf"))).when(F.col("n_clean") >= many, F.col("high")).otherwise(F.col("mid") + 5 * 1.4826 * F.col("mad"))
    return out.select(by, F.round(t, 9).alias("threshold"), "n", "n_clean")


def ecdf_confidence(scored: DataFrame, calibration: DataFrame, by: str, value: str) -> DataFrame:
    """Share of the group's calibration losses up to each loss, by a running count over both together."""
    u = scored.withColumn("_c", F.lit(0)).unionByName(calibration.select(by, value).withColumn("_c", F.lit(1)), allowMissingColumns=True)
    upto = F.sum("_c").over(W.partitionBy(by).orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    total = F.sum("_c").over(W.partitionBy(by))
    return u.withColumn("confidence", F.when(total > 0, upto / total)).filter("_c = 0").drop("_c")


def confusion(scored: DataFrame) -> DataFrame:
    l, p = F.col("label") == 1, F.col("pred") == 1
    c = scored.agg(F.count_if(l & p).alias("tp"), F.count_if(~l & p).alias("fp"), F.count_if(l & ~p).alias("fn"), F.count_if(~l & ~p).alias("tn"))
    precision, recall = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return c.withColumns({"precision": F.round(precision, 9), "recall": F.round(recall, 9), "f1": F.round(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 9)})


def with_sums_above(per: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """per with {column}_above: the sum over rows of the same key from a row's order value on. With a key that is a
    window; over a whole table rows are parted by ranges of the value, and each range adds the totals of those above it:
    a number a range and column goes to one task, never the rows. Ranges lie between approximate quantiles, which the
    driver holds (a number a shuffle partition); which range a row is in depends on its value alone."""
    if key:
        w = W.partitionBy(*key).orderBy(F.col(order).desc()).rangeBetween(W.unboundedPreceding, 0)
        return per.select("*", *[F.sum(c).over(w).alias(f"{c}_above") for c in columns])
    parts = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(per.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.lit(edges), lambda e: e <= F.col(order))) if edges else F.lit(0)
    ranged = per.withColumn("_part", part)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    higher = W.orderBy(F.col("_part").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(higher), F.lit(0)).alias(f"_{c}") for c in columns])  # a row a range
    w = W.partitionBy("_part").orderBy(F.col(order).desc()).rangeBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_part")
    return out.select(*per.columns, *[(F.sum(c).over(w) + F.col(f"_{c}")).alias(f"{c}_above") for c in columns])


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """One row (q: array): exact quantiles of a column, between ranks linearly. Values are counted first, counts are
    parted by ranges, and only the rows that hold a wanted rank (two a quantile) meet in one task."""
    per = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    wanted = total.select("all", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])).alias("w"))
    rank = F.col("w.s") * (F.col("all") - 1)
    wanted = wanted.select(F.col("w.i").alias("i"), rank.alias("r"), "all")  # a row a quantile
    above = with_sums_above(per, [], "v", ["n"])
    j = above.crossJoin(F.broadcast(wanted)).withColumn("below", F.col("all") - F.col("n_above"))
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    at = j.filter(holds(F.floor("r")) | holds(F.ceil("r")))
    one = at.groupBy("i", "r").agg(F.max(F.when(holds(F.floor("r")), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil("r")), F.col("v"))).alias("hi"))
    q = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("r") - F.floor("r"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x.q).alias("q"))


def auc(scored: DataFrame) -> DataFrame:
    """ROC area (ties count half) and average precision, from counts per distinct score, which are parted by ranges of the
    score: no task holds more than its range."""
    per = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    c = with_sums_above(per, [], "score", ["pos", "n"]).withColumn("neg", F.col("n") - F.col("pos"))
    total = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum((F.col("pos_above") - F.col("pos") / 2) * F.col("neg")).alias("u"), F.sum(F.col("pos") * F.col("pos_above") / F.col("n_above")).alias("ap"))
    return total.select(F.round(F.when(F.col("p") * F.col("q") > 0, F.col("u") / (F.col("p") * F.col("q"))), 9).alias("roc_auc"), F.round(F.when(F.col("p") > 0, F.col("ap") / F.col("p")), 9).alias("average_precision"))


def precision_at_k(scored: DataFrame, by: str) -> DataFrame:
    """Per group the share of positives among its k highest scores, k the number of its positives."""
    r = scored.withColumns({"rn": F.row_number().over(W.partitionBy(by).orderBy(F.col("score").desc(), "event_id")), "k": F.sum("label").over(W.partitionBy(by))})
    return r.filter("rn <= k").groupBy(by).agg(F.round(F.avg("label"), 9).alias("precision_at_k"), F.count("*").alias("k"))


def merge_episodes(rows: DataFrame, flag: str, by: str, order: tuple[str, ...], tolerance: int = 2) -> DataFrame:
    """Runs of positives with at most `tolerance` negatives between. A run ends at its last positive, but one still open
    at the end of the sequence ends there."""
    w = W.partitionBy(by).orderBy(*order)
    r = rows.withColumns({"i": F.row_number().over(w) - 1, "m": F.count("*").over(W.partitionBy(by))}).filter(F.col(flag) == 1)
    wi = W.partitionBy(by).orderBy("i")
    r = r.withColumn("new", F.coalesce((F.col("i") - F.lag("i").over(wi) > tolerance + 1).cast("int"), F.lit(1))).withColumn("episode", F.sum("new").over(wi.rowsBetween(W.unboundedPreceding, 0)))
    e = r.groupBy(by, "episode").agg(F.min("i").alias("start"), F.max("i").alias("last"), F.first("m").alias("m"), F.count("*").alias("n_positive"))
    return e.select(by, "episode", "start", F.when(F.col("m") - 1 - F.col("last") <= tolerance, (F.col("m") - 1).cast("int")).otherwise(F.col("last")).alias("end"), "n_positive")


def match_episodes(predicted: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """Each predicted episode with the first true one that it overlaps, or none.

    Of the true episodes that end at a prediction's start or later, the one of least start is the first overlapping one if
    it starts by the prediction's end, and else none overlaps. So one running minimum over both in order tells it; no pair
    is formed."""
    t = truth.select(by, F.col("end").alias("_at"), F.col("start").alias("_true"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    p = predicted.select(by, F.col("start").alias("_at"), F.lit(None).cast(truth.schema["start"].dataType).alias("_true"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    later = W.partitionBy(by).orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, 0)
    m = p.unionByName(t).withColumn("true_start", F.min("_true").over(later)).filter(F.col("start").isNotNull())
    kinds = predicted.schema
    return m.select(by, *[F.col(c).cast(kinds[c].dataType).alias(c) for c in ("start", "end")], F.when(F.col("true_start") <= F.col("end"), F.col("true_start")).alias("true_start"))


def episode_metrics(predicted: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """True and false positives, misses and precision, recall over all groups' episodes."""
    m = match_episodes(predicted, truth, by)
    found = match_episodes(truth, predicted, by)
    a = m.agg(F.count_if(F.col("true_start").isNotNull()).alias("tp"), F.count_if(F.col("true_start").isNull()).alias("fp"), F.round(F.avg(F.col("true_start") - F.col("start")), 9).alias("mean_lead"))
    b = found.agg(F.count_if(F.col("true_start").isNull()).alias("fn"), F.count("*").alias("n_true"))
    return a.crossJoin(b)  # one row each


def event_report(predicted: DataFrame, truth: DataFrame, windows: DataFrame, by: str, interval_s: float = 120.0, minutes: float = 90.0) -> DataFrame:
    """One row on episodes: tp and fp predictions (with and without an overlapping true episode), fn true ones that are no
    prediction's first overlapping one, precision, recall, f1, false positives for each `minutes` of play, fragmentation
    (predicted to true episodes) and its inverse, stability, and the mean lead in seconds (negative: before the truth).
    windows: one row (windows), how many were evaluated, interval_s each."""
    m = match_episodes(predicted, truth, by)
    a = m.agg(F.count_if(F.col("true_start").isNotNull()).alias("tp"), F.count_if(F.col("true_start").isNull()).alias("fp"), F.round(F.avg((F.col("start") - F.col("true_start")) * interval_s), 6).alias("mean_lead_s"))
    b = m.filter("true_start IS NOT NULL").select(by, "true_start").distinct().agg(F.count("*").alias("_matched"))
    c = truth.agg(F.count("*").alias("_true"))
    one = a.crossJoin(b).crossJoin(c).crossJoin(windows)  # one row each
    n = lambda x, y: F.col(x) / F.greatest(y, F.lit(1))
    one = one.withColumn("fn", F.col("_true") - F.col("_matched"))
    one = one.withColumns({"precision": n("tp", F.col("tp") + F.col("fp")), "recall": n("tp", F.col("tp") + F.col("fn")), "fragmentation": (F.col("tp") + F.col("fp")) / F.greatest("_true", F.lit(1))})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    per = F.col("fp") * (minutes * 60) / F.greatest(F.col("windows") * interval_s, F.lit(1.0))
    rounded = {"precision": F.col("precision"), "recall": F.col("recall"), "f1": f1, "fp_per_match": per, "fragmentation": F.col("fragmentation"), "stability": 1 / F.greatest(F.col("fragmentation"), F.lit(1e-6))}
    return one.select("tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in rounded.items()], "mean_lead_s")


def threshold_sweep(scored: DataFrame, points: int = 50, low: float = 0.8, high: float = 0.995) -> DataFrame:
    """False and true positives at evenly spaced thresholds between two percentiles of the scores: each score is counted
    at the last threshold that it reaches, then counts are added up from above."""
    cut = quantiles(scored, "score", (low, high)).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    step = (F.col("b") - F.col("a")) / (points - 1)
    th = cut.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), "a", "b").withColumn("threshold", F.col("a") + F.col("k") * step)
    grid = F.broadcast(th.agg(F.array_sort(F.collect_list("threshold")).alias("ths")))  # `points` numbers
    k = F.size(F.filter("ths", lambda x: x <= F.col("score"))) - 1
    per = scored.crossJoin(grid).withColumn("k", k).filter("k >= 0").groupBy("k").agg(F.count_if(F.col("label") == 0).alias("fp"), F.count_if(F.col("label") == 1).alias("tp"))
    w = W.orderBy(F.col("k").desc())
    full = th.join(per, "k", "left").fillna(0, ["fp", "tp"])
    return full.select("k", F.round("threshold", 9).alias("threshold"), F.sum("fp").over(w).alias("fp"), F.sum("tp").over(w).alias("tp"))


def budget_pick(sweep: DataFrame, totals: DataFrame, budget: float = 2.0, interval_s: float = 120.0, minutes: float = 90.0) -> DataFrame:
    """The first threshold of a sweep whose false positives for each `minutes` of play stay within the budget, with its
    false positives for them, precision and recall; no row, if none does. totals: one row (windows, positives)."""
    per = F.col("fp") * (minutes * 60) / F.greatest(F.col("windows") * interval_s, F.lit(1.0))
    r = sweep.crossJoin(F.broadcast(totals)).withColumn("fp_per_match", F.round(per, 6)).filter(per <= budget)
    r = r.agg(F.min_by(F.struct("k", "threshold", "fp", "tp", "fp_per_match", "positives"), "k").alias("r")).filter("r IS NOT NULL").select("r.*")
    share = lambda x: F.round(F.col("tp") / F.greatest(x, F.lit(1)), 6)
    return r.select("k", "threshold", "fp", "tp", "fp_per_match", share(F.col("tp") + F.col("fp")).alias("precision"), share(F.col("positives")).alias("recall"))


def fairness_audit(inferences: DataFrame, attributes: tuple[str, ...], limit: float = 0.15) -> DataFrame:
    """Flag rate of each attribute's groups against all inferences; null groups are left out."""
    overall = inferences.agg(F.avg("is_anomaly").alias("overall"))
    long = inferences.select("is_anomaly", *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot(["is_anomaly"], list(attributes), "attribute", "group")
    g = long.filter("group IS NOT NULL").groupBy("attribute", "group").agg(F.avg("is_anomaly").alias("rate"), F.count("*").alias("n")).crossJoin(F.broadcast(overall))  # one row
    delta = F.col("rate") - F.col("overall")
    return g.select("attribute", "group", F.round("rate", 9).alias("rate"), "n", F.round(delta, 9).alias("delta"), (F.abs(delta) > limit).alias("biased"))


def squad_recalibration(rate: float | None, n: int, current: float) -> float | None:
    """A new contamination for the squad from the override rate of n recent recommendations, or None."""
    if n < 10 or rate is None:
        return None
    if rate > 0.4:
        return min(0.2, current + 0.05)
    return max(0.01, current - 0.05) if 0 < rate < 0.05 else None


def recalibrate_squad(decisions: DataFrame, current: float = 0.05, step: float = 0.05, least: int = 10) -> DataFrame:
    """One row (n_overrides_analyzed, override_rate, old, new, reason) where the share of overrides among `least` or more
    recent decisions asks for another contamination: over 0.4 a step up, to 0.2 at most; under 0.05 but not 0 a step down,
    to 0.01 at least. Else no row."""
    r = decisions.agg(F.count("*").alias("n"), F.avg((F.coalesce("decision", F.lit("")) == "override").cast("int")).alias("rate"))
    many, few = F.col("rate") > 0.4, (F.col("rate") > 0) & (F.col("rate") < 0.05)
    new = F.when(many, min(0.2, current + step)).otherwise(max(0.01, current - step))
    reason = F.when(many, "too many overrides").otherwise("few overrides")
    return r.filter((F.col("n") >= least) & (many | few)).select(F.col("n").alias("n_overrides_analyzed"), F.round("rate", 9).alias("override_rate"), F.lit(current).alias("old"), new.alias("new"), reason.alias("reason"))


def player_recalibration(overrides: DataFrame, least: int = 3, size: float = 2.0) -> DataFrame:
    """Features whose snapshot value exceeds `size` in `least` or more of a player's overrides."""
    x = overrides.select("player_id", "override_id", F.explode("snapshot").alias("feature", "value")).filter(F.abs("value") > size)
    return x.groupBy("player_id", "feature").agg(F.count_distinct("override_id").alias("n"), F.round(F.avg("value"), 9).alias("mean_value")).filter(F.col("n") >= least)


def ranked_by_hash(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """key, rank (from 0) and n of distinct keys, in order of a seeded hash, ties by key. Keys are parted by ranges of the
    hash, numbered in their range, and the totals of the ranges before are added: no task holds all keys."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    # the hash is even over 52 bits, so equal ranges are about equally full
    d = keys.select(key).distinct().withColumn("_h", h).withColumn("_part", F.floor(F.col("_h") / F.lit((1 << 52) / parts)))
    totals = d.groupBy("_part").agg(F.count("*").alias("_m"))
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_before"), F.sum("_m").over(W.partitionBy(F.lit(1))).alias("n"))  # a row a range
    at = F.row_number().over(W.partitionBy("_part").orderBy("_h", key)) - 1
    return d.withColumn("_at", at).join(F.broadcast(offsets), "_part").select(key, (F.col("_at") + F.col("_before")).cast("long").alias("rank"), "n")


def split_sessions(sessions: DataFrame, key: str, seed: int = 42, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    """sessions with split: train, validate or calibrate, by the sessions' ranks by a seeded hash. The first
    floor(train * n) sessions (one at least) train, the next floor(validate * n) (one at least) validate. All rows of a
    session are in one split; a null session is in none."""
    ranks = ranked_by_hash(sessions.filter(F.col(key).isNotNull()), key, seed)
    a, b = F.greatest(F.floor(F.col("n") * train), F.lit(1)), F.greatest(F.floor(F.col("n") * validate), F.lit(1))
    split = F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "validate").otherwise("calibrate")
    return sessions.join(ranks.select(key, split.alias("split")), key, "left")


def normaliser(rows: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation (1 where it is next to nothing) of each column, one row per `by` (players), or one."""
    return rows.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) > 1e-6, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_std"))])


def normalised(rows: DataFrame, fitted: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """columns in deviations from the mean; 0 where a value or the fit is missing."""
    j = rows.join(fitted, list(by), "left") if by else rows.crossJoin(F.broadcast(fitted))  # one row
    return j.select(*[c for c in rows.columns if c not in columns], *[F.round(F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(0.0)), 6).alias(c) for c in columns])
