"""Scores of activity windows: a linear reconstructor, decisions, attributions and findings."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import dynamic_threshold, normalised, normaliser, quantiles

FEATURES = ("mean_speed", "max_speed", "mean_accel", "mean_x", "mean_y", "distance")


class Reconstructor:
    """Principal components as a linear autoencoder. Its weights are a matrix of features, so every row is scored by an
    expression over columns: no Python in the tasks."""

    def __init__(self, training: DataFrame, columns: tuple[str, ...] = FEATURES, k: int = 3, by: tuple[str, ...] = ("player_id",)):
        self.columns, self.by, self.fitted = columns, by, normaliser(training, columns, by)
        z = normalised(training, self.fitted, columns, by)
        model = PCA(k=k, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=list(columns), outputCol="v").transform(z))
        self.weights = model.pc.toArray()

    def error(self, values: list[Column]) -> Column:
        """Mean squared error of a normalised row's reconstruction."""
        parts = [sum((v * float(w) for v, w in zip(values, column, strict=True)), F.lit(0.0)) for column in self.weights.T]
        back = [sum((p * float(self.weights[i, j]) for j, p in enumerate(parts)), F.lit(0.0)) for i in range(len(values))]
        return sum(((v - b) * (v - b) for v, b in zip(values, back, strict=True)), F.lit(0.0)) / len(values)

    def score(self, rows: DataFrame) -> DataFrame:
        z = normalised(rows, self.fitted, self.columns, self.by)
        return z.withColumn("loss", F.round(self.error([F.col(c) for c in self.columns]), 6))

    def ablation(self, rows: DataFrame) -> DataFrame:
        """loss, and for each feature how much of it goes when the feature is replaced by its mean (0, normalised)."""
        z = normalised(rows, self.fitted, self.columns, self.by)
        full = self.error([F.col(c) for c in self.columns])
        shares = []
        for i, c in enumerate(self.columns):
            other = [F.lit(0.0) if j == i else F.col(x) for j, x in enumerate(self.columns)]
            shares += [F.lit(c), F.round(full - self.error(other), 6)]
        return z.withColumns({"loss": F.round(full, 6), "attribution": F.create_map(*shares)})


def top_features(attribution: Column, n: int = 5) -> Column:
    """The n features of largest effect, ties by name."""
    rows = F.transform(F.map_entries(attribution), lambda e: F.struct((-F.abs(e.value)).alias("minus"), e.key.alias("feature"), e.value.alias("value")))
    return F.transform(F.slice(F.array_sort(rows), 1, n), lambda x: F.struct(x.feature.alias("feature"), x.value.alias("value")))


def counterfactual(attribution: Column, threshold: float = 0.0) -> Column:
    """A sentence on the feature that raises the loss most, or null."""
    best = F.array_max(F.transform(F.map_entries(attribution), lambda e: F.struct(e.value.alias("v"), e.key.alias("k"))))
    return F.when(best.v > threshold, F.format_string("Without the change of %s the loss were lower by %.3f.", best.k, best.v))


def regime_threshold(losses: DataFrame, regime: str, by: str, value: str) -> DataFrame:
    """Each (group, regime)'s threshold, the group's own where the regime has too few losses."""
    key = F.concat_ws("|", F.col(by).cast("string"), F.col(regime))
    fine = dynamic_threshold(losses.withColumn("_k", key), "_k", value)
    whole = dynamic_threshold(losses, by, value).select(by, F.col("threshold").alias("_whole"))
    pairs = losses.select(by, regime).distinct().withColumn("_k", key).join(fine.select("_k", "threshold"), "_k", "left").join(whole, by, "left")
    own = F.col("threshold").isNotNull() & (F.col("threshold") != float("inf"))
    return pairs.select(by, regime, F.when(own, F.col("threshold")).otherwise(F.col("_whole")).alias("threshold"), F.when(own, "regime").otherwise("player").alias("tracker"))


def pooled_threshold(losses: DataFrame, value: str, least: int = 30, many: int = 150) -> float:
    """dynamic_threshold() of all losses as one group, by exact quantiles over ranges: a few numbers reach the driver, and
    no task meets all losses."""
    known = losses.filter(F.col(value).isNotNull()).select(value)
    if known.count() < least:
        return float("inf")
    at = lambda df, c, q: quantiles(df, c, (q,)).first()["q"][0]
    clean = known.filter(F.col(value) <= at(known, value, 0.95))
    n = clean.count()
    if n < 15:
        clean, n = known, known.count()
    if n >= many:
        return round(at(clean, value, 0.995), 9)
    mid = at(clean, value, 0.5)
    return round(mid + 5 * 1.4826 * at(clean.select(F.abs(F.col(value) - mid).alias("off")), "off", 0.5), 9)


def resolve_thresholds(losses: DataFrame, regime: str, by: str, value: str, pilot: bool = False) -> DataFrame:
    """by, regime, threshold, source: regime_threshold() for groups with enough losses of their own (per_player). With pilot
    the others take the threshold of all groups' losses in the regime, or in all where the regime has too few
    (pilot_pooled); else, and without a pooled one, they have none (none, null). There are a few dozen regimes."""
    own = regime_threshold(losses, regime, by, value)
    whole = dynamic_threshold(losses, by, value).select(by, (F.col("threshold") < float("inf")).alias("_own"))
    r = own.join(whole, by, "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    pooled = F.lit(None).cast("double")
    if pilot and (all_ := pooled_threshold(losses, value)) < float("inf"):
        cells = [x[0] for x in losses.select(regime).distinct().collect()]
        each = {c: pooled_threshold(losses.filter(F.col(regime) == c), value) for c in cells if c is not None}
        pairs = [F.lit(v) for c, t in each.items() if t < float("inf") for v in (c, t)]
        pooled = F.coalesce(F.element_at(F.create_map(*pairs), F.col(regime)), F.lit(all_)) if pairs else F.lit(all_)
    threshold = F.when(F.col("_own"), F.col("threshold")).otherwise(pooled)
    source = F.when(F.col("_own"), "per_player").when(pooled.isNotNull(), "pilot_pooled").otherwise("none")
    return r.select(by, regime, threshold.alias("threshold"), source.alias("source"))


def kmeans_background(rows: DataFrame, k: int, columns: tuple[str, ...] = FEATURES, seed: int = 7) -> DataFrame:
    """Centres of k-means over distinct rows; no more centres than rows, of which a few stand for themselves."""
    d = VectorAssembler(inputCols=list(columns), outputCol="v", handleInvalid="skip").transform(rows.select(*columns).distinct())
    few = d.select(*columns).limit(k + 1).collect()  # k + 1 rows tell whether there are more than k
    if len(few) <= k:
        centres = [(i, [float(x) for x in r]) for i, r in enumerate(sorted(few))]
    else:
        model = KMeans(k=k, seed=seed, featuresCol="v").fit(d)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centres, "centre int, v array<double>").select("centre", *[F.col("v")[i].alias(c) for i, c in enumerate(columns)])
