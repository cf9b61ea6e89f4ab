"""Reconstruction scores and attributions of whole windows (steps x channels), over the steps that are there."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Holds a step's weights where few steps are there.
RIDGE = 1e-6
#: Windows are wide: tasks work through so many at once, and batches between Spark and Python hold so many.
PIECE, BATCH_ROWS = 256, 1000


def stacked_windows(ticks: DataFrame, channels: tuple[str, ...], keys: tuple[str, ...], order: tuple[str, ...], steps: int = 8) -> DataFrame:
    """keys, window (from 0), values (steps * channels numbers, step by step), mask (a boolean a step): each key's rows in
    order, `steps` at a time. The last window is filled up with zeros that are masked; a row with a null channel is
    masked too."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    there = F.lit(True)
    for c in channels:
        there = there & F.col(c).isNotNull()
    step = F.struct((F.col("_at") % steps).alias("i"), there.alias("there"), F.array(*[F.when(there, F.col(c).cast("double")).otherwise(0.0) for c in channels]).alias("x"))
    g = ticks.withColumn("_at", at).groupBy(*keys, F.floor(F.col("_at") / steps).cast("long").alias("window")).agg(F.array_sort(F.collect_list(step)).alias("s"))  # `steps` rows at most
    filled = F.concat(F.flatten(F.transform("s", lambda r: r["x"])), F.array_repeat(F.lit(0.0), (steps - F.size("s")) * len(channels)))
    mask = F.concat(F.transform("s", lambda r: r["there"]), F.array_repeat(F.lit(False), steps - F.size("s")))
    return g.select(*keys, "window", filled.alias("values"), mask.alias("mask"))


@dataclass
class WindowModel:
    """Principal components of normalised windows with missing steps. weights: (steps * channels, k)."""

    channels: tuple[str, ...]
    steps: int
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def normal(self, x: np.ndarray) -> np.ndarray:
        n = len(self.channels)
        return ((x.reshape(len(x), self.steps, n) - self.mean) / self.deviation).reshape(len(x), -1)

    def codes(self, z: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Coordinates of normalised windows by least squares over their steps that are there."""
        n, k = len(self.channels), self.weights.shape[1]
        by_step = self.weights.reshape(self.steps, n, k)
        gram = np.einsum("tfi,tfj->tij", by_step, by_step)
        left = np.einsum("nt,tij->nij", mask.astype(float), gram) + RIDGE * np.eye(k)
        right = (z * np.repeat(mask, n, axis=1)) @ self.weights
        return np.linalg.solve(left, right[..., None])[..., 0]

    def loss(self, z: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Mean squared error of the reconstruction over the cells that are there; 0 where none is."""
        n = len(self.channels)
        off = (z - self.codes(z, mask) @ self.weights.T) ** 2 * np.repeat(mask, n, axis=1)
        return off.sum(1) / (mask.sum(1) * n + 1e-8)


def _pieces(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in pieces of at most PIECE rows, with values (rows x cells) and mask (rows x steps), read from Arrow's
    buffers. A task's memory is that of a few pieces beside one batch, however many rows it has."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            rows = batch.slice(at, PIECE)
            mask = rows.column("mask").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), steps)
            yield rows, rows.column("values").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), mask


def _batches(df: DataFrame) -> DataFrame:
    """df, after bounding the batches that its session hands to Python where they are not bounded more tightly."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def fit_windows(windows: DataFrame, channels: tuple[str, ...], steps: int = 8, k: int = 8, rounds: int = 10, seed: int = 3) -> WindowModel:
    """Fits a WindowModel to all windows. Channels are normalised by mean and population deviation over the steps that are
    there. Components follow from alternating least squares: in each round every task finds the coordinates c of its
    windows and sends two sums, of c c' by step and of x c', over the cells that are there; their totals give the weights of
    the next round. A task's sums have steps * k^2 + steps * channels * k numbers, whatever the rows."""
    n = len(channels)
    cells = windows.select(F.posexplode("mask").alias("t", "there"), "values").filter("there")
    steps_there = cells.select(F.slice("values", F.col("t") * n + 1, n).alias("x"))
    aggregates = [g(F.col("x")[i]).alias(f"{name}{i}") for i in range(n) for name, g in (("m", F.avg), ("d", F.stddev_pop))]
    told = steps_there.agg(*aggregates).first()
    mean = np.array([told[f"m{i}"] or 0.0 for i in range(n)])
    deviation = np.array([told[f"d{i}"] if told[f"d{i}"] and told[f"d{i}"] > 1e-9 else 1.0 for i in range(n)])
    k = min(k, steps * n)
    kept = windows.select("values", "mask").persist()  # read once a round
    model = WindowModel(tuple(channels), steps, mean, deviation, np.random.default_rng(seed).normal(size=(steps * n, k)))
    for _ in range(rounds):
        shared = windows.sparkSession.sparkContext.broadcast(model)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m: WindowModel = shared.value
            gram, cross = np.zeros((steps, k, k)), np.zeros((steps * n, k))
            for _, x, mask in _pieces(batches, steps):
                z = m.normal(x) * np.repeat(mask, n, axis=1)
                c = m.codes(z, mask)
                gram += np.einsum("nt,ni,nj->tij", mask.astype(float), c, c)
                cross += z.T @ c
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([gram.ravel(), cross.ravel()])]})

        parts = _batches(kept).mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        total = np.zeros(steps * k * k + steps * n * k)
        for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many numbers as a task's
            total[r["i"]] = r["v"]
        gram, cross = total[: steps * k * k].reshape(steps, k, k) + RIDGE * np.eye(k), total[steps * k * k :].reshape(steps, n, k)
        weights = np.linalg.solve(gram[:, None], cross[..., None])[..., 0].reshape(steps * n, k)
        model = WindowModel(tuple(channels), steps, mean, deviation, np.linalg.qr(weights)[0])
    kept.unpersist()
    return model


def score_windows(windows: DataFrame, model: WindowModel) -> DataFrame:
    """windows with a column loss. Windows without a step have a loss of 0."""
    shared = windows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: WindowModel = shared.value
        for rows, x, mask in _pieces(batches, m.steps):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(m.loss(m.normal(x), mask))], [*rows.schema.names, "loss"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    return _batches(windows).mapInArrow(run, f"{schema}, loss double")


def window_background(windows: DataFrame, model: WindowModel, k: int = 10, seed: int = 7) -> np.ndarray:
    """The mean of the k-means centres of normalised windows whose steps are all there (zeros, the channels' means, if
    there is none): what a channel is replaced by."""
    n = len(model.channels)
    scaled = F.transform("values", lambda x, i: (x - F.get(F.lit(model.mean.tolist()), (i % n).cast("int"))) / F.get(F.lit(model.deviation.tolist()), (i % n).cast("int")))
    whole = windows.filter(F.forall("mask", lambda m: m)).select(scaled.alias("z"))
    rows = whole.distinct().limit(k + 1).collect()  # k + 1 rows tell whether there are more than k
    if len(rows) <= k:
        return np.mean([r["z"] for r in rows], axis=0) if rows else np.zeros(model.steps * n)
    fitted = KMeans(k=k, seed=seed, featuresCol="v").fit(whole.select(array_to_vector("z").alias("v")))
    return np.mean(fitted.clusterCenters(), axis=0)


def ablate_windows(windows: DataFrame, model: WindowModel, background: np.ndarray) -> DataFrame:
    """windows with loss, base_value (the loss of the background itself at the window's steps) and attribution (for each
    channel, how much the loss changes when the channel is the background's): channels + 2 reconstructions a window, in
    one matrix each."""
    shared = windows.sparkSession.sparkContext.broadcast((model, background))
    n = len(model.channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, back = shared.value
        for rows, x, mask in _pieces(batches, m.steps):
            z = m.normal(x)
            loss = m.loss(z, mask)
            base = m.loss(np.tile(back, (len(z), 1)), mask)
            effect = np.zeros((len(z), n))
            for f in range(n):
                other = z.copy()
                other[:, f::n] = back[f::n]
                effect[:, f] = m.loss(other, mask) - loss
            names = pa.array(m.channels).take(pa.array(np.tile(np.arange(n), len(z))))
            told = pa.MapArray.from_arrays(pa.array(np.arange(len(z) + 1) * n, pa.int32()), names, pa.array(effect.ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(loss), pa.array(base), told], [*rows.schema.names, "loss", "base_value", "attribution"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    return _batches(windows).mapInArrow(run, f"{schema}, loss double, base_value double, attribution map<string,double>")
