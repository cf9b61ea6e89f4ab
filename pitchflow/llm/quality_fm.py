"""Operator 9: a factorisation machine that scores the quality of texts."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, given_back, releasing, text_slices

BUCKETS = 1 << 14
#: Structure statistics and metadata come before the hashed words among the features.
STATS = 24
FEATURES = STATS + BUCKETS
#: At most so many labelled rows are fitted: those whose hashed ids are smallest.
SAMPLE = 8_000
FACTORS, EPOCHS, RATE, L2 = 8, 12, 0.02, 1e-4


@functools.lru_cache(maxsize=1)
def _buckets() -> Memo:
    return Memo(300_000)


def word_buckets(texts: list[list[str]]) -> dict:
    memo = _buckets()
    missing = memo.missing({w for words in texts for w in words})
    young = memo.young
    for w in missing:
        young[w] = STATS + zlib.crc32(w.lower().encode()) % BUCKETS
    return young


def features(text: str, words: list[str], bucket: dict) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text's features: about 1 in size, so that long texts count like short ones."""
    x = np.zeros(STATS)
    x[0] = 1.0
    data = text.encode()
    n = len(data)
    if n:
        c = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
        lines = text.split("\n")
        letters = c[97:123].sum() + c[192:256].sum()
        upper = c[65:91].sum()
        x[1:14] = (
            math.log1p(n) / 10, upper / max(upper + letters, 1e-9), c[48:58].sum() * 4, c[32] + c[10] + c[9], c[33] * 10, c[124] * 10, c[35:39].sum() * 10, c[42] * 10,
            c[60] * 10 + c[62] * 10, c[44] * 10, c[46] * 10, (c[64] + c[47] + c[58] + c[61] + c[95]) * 10, 1 - len(set(lines)) / len(lines),
        )
        x[14] = math.log1p(n / len(lines)) / 10
    idx = np.fromiter(map(bucket.__getitem__, words), np.int64, len(words))
    if len(idx):
        lengths = (n - len(words) + 1) / len(words)
        kinds, counts = np.unique(idx, return_counts=True)
        x[15] = math.log1p(len(idx)) / 10
        x[16] = min(lengths, 40) / 10
        x[17] = len(kinds) / min(len(idx), BUCKETS)
        x[18] = (idx[1:] == idx[:-1]).mean() if len(idx) > 1 else 0
        x[19] = counts.max() / len(idx)
        x[20] = ((idx[2:] == idx[:-2]).mean() if len(idx) > 2 else 0)
        weight = np.sqrt(counts) / math.sqrt(len(idx))
        weight /= max(np.linalg.norm(weight), 1e-9)
        return np.concatenate([np.arange(STATS), kinds]), np.concatenate([x, weight]).astype(np.float32)
    x[21] = 1.0
    return np.arange(STATS), x.astype(np.float32)


class FactorisationMachine:
    """y = b + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j, the last as half of |sum v_i x_i|^2 - sum |v_i x_i|^2,
    which takes time linear in the features that a row has."""

    def __init__(self, bias: float = 0.0, seed: int = 7):
        self.b, self.w = bias, np.zeros(FEATURES, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32)

    def raw(self, idx: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[idx] * x[:, None]
        s = vx.sum(0)
        return float(self.b + self.w[idx] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> None:
        """Logistic loss by AdaGrad, a row at a time, in an order fixed by the seed."""
        gw, gv, gb = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, FACTORS), 1e-2, np.float32), 1e-2
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                idx, x = rows[i]
                v = self.v[idx]
                vx = v * x[:, None]
                s = vx.sum(0)
                y = self.b + self.w[idx] @ x + 0.5 * (s @ s - (vx * vx).sum())
                g = 1 / (1 + math.exp(-max(-30.0, min(30.0, y)))) - labels[i]
                dw = g * x + L2 * self.w[idx]
                dv = g * (x[:, None] * s - vx * x[:, None]) + L2 * v
                gw[idx] += dw * dw
                gv[idx] += dv * dv
                gb += g * g
                self.w[idx] -= 2 * RATE * dw / np.sqrt(gw[idx])
                self.v[idx] -= RATE * dv / np.sqrt(gv[idx])
                self.b -= RATE * g / math.sqrt(gb)

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(idx, x)))))


def _featurise(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words = [t.split() for t in texts]
    bucket = word_buckets(words)
    for t, w in zip(texts, words, strict=True):
        yield features(t, w, bucket)


@releasing
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "text"):
        rows = list(_featurise(texts))
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("quality"), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["id", "quality", "idx", "x"]
        )


def held_out(id_col, folds: int = 5):
    """crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fits on at most `sample` labelled rows outside the held-out fold. A bounded sample in a fixed order of hashed ids:
    the same rows give the same model however they are partitioned. Without any label the machine scores all rows 0.5."""
    chosen = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "quality")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "id")  # chosen: at most `sample` rows of two numbers
    # of repeated ids one text each, so that what is brought to the driver is as many rows at most
    picked = picked.groupBy("id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "quality", "t.text")
    kind = picked.schema["id"].dataType.simpleString()
    model = _fitted(picked.mapInArrow(_sampled, f"id {kind}, quality int, idx array<int>, x array<float>").toArrow().to_pandas())
    given_back()  # what the sample took in the driver, which lives on
    return model


def _fitted(rows: pd.DataFrame) -> FactorisationMachine:
    model = FactorisationMachine()
    if len(rows):
        rows = rows.sort_values("id")
        labels_ = rows["quality"].to_numpy(float)
        rate = min(max(labels_.mean(), 0.01), 0.99)
        model.b = math.log(rate / (1 - rate))
        model.fit([(np.asarray(i, np.int64), np.asarray(x, np.float32)) for i, x in zip(rows["idx"], rows["x"], strict=True)], labels_)
    return model


@releasing
def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    fm: FactorisationMachine = model.value
    for part, texts in text_slices(batches, "text"):
        scores = [fm.score(*f) for f in _featurise(texts)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])
    _buckets.cache_clear()


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) per row of docs.

    Features are hashed words, statistics of the text's structure and its length; language, source and id are none.
    The model (about half a MB) is broadcast, each task scores its own documents: no shuffle. Null text is empty and
    scored like it; labels of unknown documents and null labels are passed over; a document labelled twice takes its
    larger label. Rows with equal or null ids each keep a row; an empty table gives an empty result; other columns are
    not read. With key_col, doc_id in the result is that column; labels and folds still go by id_col."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    narrow = docs.select(F.col(key_col or id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    scored = narrow.mapInArrow(partial(_score, model=model), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@releasing
def _keep(batches: Iterator[pa.RecordBatch], model, threshold: float, text_col: str) -> Iterator[pa.RecordBatch]:
    fm: FactorisationMachine = model.value
    for part, texts in text_slices(batches, text_col):
        yield part.filter(pa.array([fm.score(*f) >= threshold for f in _featurise(texts)], pa.bool_()))
    _buckets.cache_clear()  # the worker lives on, for stages that need the memory


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score_quality() predicts 1, with all their columns. Each row is judged where it lies, by its
    own text: repeated and null ids don't matter, and no text is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    return docs.mapInArrow(partial(_keep, model=model, threshold=threshold, text_col=text_col), docs.schema)
