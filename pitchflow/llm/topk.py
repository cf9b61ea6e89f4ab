"""Operator 1: exact top-k search by MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, stored

#: Vectors of a shard, which a task holds, and queries of a block, which it streams past them; tasks at most.
SHARD, BLOCK, TASKS = 8192, 1 << 16, 20_000
#: Documents of a shard are worked through in ranges of so many, the threshold rising from one to the next.
RANGE = 2048
#: Vectors with larger components have postings of their own in a shard, so that the others' bounds stay low.
LARGEST = 1 << 24
#: Doubles hold whole numbers up to this exactly; scores that may be larger are computed in Python's integers.
EXACT = 1 << 53
RESULT = "query_id bigint, query_h bigint, query_copies bigint, vec_id bigint, copies bigint, score bigint"


class Postings:
    """A shard's vectors by component: documents (in order of id) and weights where the weight isn't zero. h tells rows of
    one id apart, copies says how many rows one stands for."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], kind: type = float, h: np.ndarray | None = None, copies: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.kind = ids[order], kind
        self.h, self.copies = (ids if h is None else h)[order], (np.ones(len(ids), np.int64) if copies is None else copies)[order]
        self.dims = max((len(v) for v in vectors), default=0)
        self.rows = np.full((len(ids), self.dims), kind(0), kind)
        for at, k in enumerate(order):
            self.rows[at, : len(vectors[k])] = vectors[k]
        self.columns = np.ascontiguousarray(self.rows.T)
        self.docs = [np.flatnonzero(c) for c in self.columns]
        self.low, self.high = (self.rows.min(0), self.rows.max(0)) if len(ids) else (np.zeros(self.dims), np.zeros(self.dims))
        self._whole: Postings | None = None

    def whole(self) -> Postings:
        """The same in Python's integers."""
        if self._whole is None:
            self._whole = Postings(self.ids, [np.array([int(x) for x in r], object) for r in self.rows], int, self.h, self.copies) if self.kind is float else self
        return self._whole

    def exact(self, query_id: int, query_h: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """search() in doubles where all sums are exact in them, else in integers."""
        n = min(len(query), self.dims)
        if self.kind is float and np.abs(query[:n]) @ np.maximum(-self.low, self.high)[:n] < EXACT:
            return self.search(query_id, query_h, query, k)
        return self.whole().search(query_id, query_h, np.array([int(x) for x in query], object), k)

    def search(self, query_id: int, query_h: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k highest scores, ties to smaller ids, without the query's own row if it has no copies.

        A term's bound is the most that it can add, 0 at least. Terms in ascending order of bounds are non-essential
        while their bounds together stay below the threshold (the k-th best score so far): a document in none of the
        other, essential lists can't reach it. Essential lists are traversed and their documents' scores summed;
        the others are probed one by one, largest bound first, and only for documents that can still reach the
        threshold."""
        q = np.full(self.dims, self.kind(0), self.kind)
        n = min(len(query), self.dims)
        q[:n] = query[:n]
        bound = np.maximum(0, np.maximum(q * self.low, q * self.high))
        order = np.argsort(bound, kind="stable")
        together = np.cumsum(bound[order])  # of the terms up to and with this one
        places, best = np.empty(0, np.int64), np.empty(0, self.kind)
        for a in range(0, len(self.ids), RANGE):
            b = min(a + RANGE, len(self.ids))
            threshold = best[-1] if len(best) >= k else -np.inf
            split = int(np.searchsorted(together, threshold, "left"))  # the first `split` terms are non-essential
            essential = order[split:]
            alive = np.zeros(b - a, bool)
            if split == 0:
                alive[:] = True  # also documents in no list at all
            else:
                for t in essential:
                    docs = self.docs[t]
                    i, j = np.searchsorted(docs, (a, b))
                    if j - i == b - a:
                        alive[:] = True
                        break
                    alive[docs[i:j] - a] = True
            at = np.flatnonzero(alive) + a
            if not len(at):
                continue
            used = essential[q[essential] != 0]
            score = q[used] @ self.columns[used, a:b] if len(at) == b - a else q[used] @ self.columns[np.ix_(used, at)]
            for t in range(split - 1, -1, -1):
                can = score + together[t] >= threshold
                if not can.all():
                    at, score = at[can], score[can]
                if not len(at):
                    break
                score = score + q[order[t]] * self.columns[order[t], at]
            keep = (score >= threshold) & ~((self.ids[at] == query_id) & (self.h[at] == query_h) & (self.copies[at] == 1))
            places, best = np.concatenate([places, at[keep]]), np.concatenate([best, score[keep]])
            top = np.lexsort((self.ids[places], -best))[:k]
            places, best = places[top], best[top]
        return places, best


def _shard(rows: list[pd.DataFrame]) -> list[Postings]:
    p = pd.concat(rows)
    ids, h, copies, vectors = p["vec_id"].to_numpy(np.int64), p["h"].to_numpy(np.int64), p["copies"].to_numpy(np.int64), [np.asarray(v, float) for v in p["v"]]
    large = np.array([np.abs(v).max(initial=0) >= LARGEST for v in vectors], bool)
    return [Postings(ids[at], [vectors[i] for i in np.flatnonzero(at)], float, h[at], copies[at]) for at in (~large, large) if at.any()]


def _search(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows come in order of key, a key's vectors before its queries: the shard is held, the queries pass."""
    key, gathered, shard = None, [], None
    for batch in batches:
        for mine, rows in batch.groupby("key", sort=True):
            if mine != key:
                key, gathered, shard = mine, [], None
            gathered.append(rows[~rows["is_query"]])
            queries = rows[rows["is_query"]]
            if not len(queries):
                continue
            shard = shard or _shard(gathered)
            gathered = []
            out: list[tuple] = []
            for query_id, h, n, v in zip(queries["vec_id"], queries["h"], queries["copies"], queries["v"], strict=True):
                for part in shard:
                    at, scores = part.exact(query_id, h, np.asarray(v, float), k)
                    copies = part.copies[at] - ((part.ids[at] == query_id) & (part.h[at] == h))
                    out += zip([query_id] * len(at), [h] * len(at), [n] * len(at), part.ids[at].tolist(), copies.tolist(), [int(s) for s in scores], strict=True)
            # beyond 64 bits the result's column fails, as SQL's cast does
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype("int64")


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as double (doubles from 2^53 on are whole). Left out: null ids, null
    vectors, vectors with a null or non-finite component."""
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    v = F.transform(F.col(vector_col), lambda x: whole(x.cast("double") * scale))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k others of highest integer
    inner product, ties to smaller ids.

    Vectors are dealt to shards and queries to blocks by a hash of id and vector. A task holds a shard and streams a block's
    queries past it, so queries go to every shard (8192 vectors) and vectors only to every block (65,536 queries); k rows
    a query and shard are merged by query. Scores are exact: where a query's sums may pass 2^53 they are computed in
    Python's integers. A score beyond 64 bits is an error.

    Missing components of shorter vectors are 0. Rows of equal ids are each queries and candidates: a row leaves out itself
    only. Rows equal in id and vector are searched once and returned as often as they occur. Empty tables give an empty
    result; other columns are not read."""
    v = integer_vectors(vectors, scale, id_col, vector_col)
    paths = [fresh(v.sparkSession, "vectors"), fresh(v.sparkSession, "ranked")]
    v = stored(v.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("vec_id", "v")), paths[0])
    queries = v.filter(F.col("vec_id") % every == 0)
    shards, blocks = max(1, -(-v.count() // SHARD)), max(1, -(-queries.count() // BLOCK))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["key", "is_query", "vec_id", "h", "copies", "v"]
    candidates = v.withColumn("block", every_one(blocks)).withColumn("key", F.pmod("h", F.lit(shards)) * blocks + F.col("block")).withColumn("is_query", F.lit(False))
    asked = queries.withColumn("shard", every_one(shards)).withColumn("key", F.col("shard") * blocks + F.pmod(F.xxhash64("h", F.lit("block")), F.lit(blocks))).withColumn("is_query", F.lit(True))
    tasks = min(TASKS, shards * blocks)
    dealt = candidates.select(columns).unionByName(asked.select(columns)).repartitionById(tasks, F.pmod("key", F.lit(tasks)).cast("int")).sortWithinPartitions("key", "is_query")
    found = dealt.mapInPandas(partial(_search, k=k), RESULT)
    found = found.withColumn("_", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k).cast("long")).cast("int"))))
    best = Window.partitionBy("query_id", "query_h", "query_copies").orderBy(F.desc("score"), "vec_id")
    ranked = stored(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "query_copies", "rank", "vec_id", "score"), paths[1])
    dropped(v.sparkSession, paths[0])
    return ranked.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("query_copies").cast("int")))).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.rid <> d.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
