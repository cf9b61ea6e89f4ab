"""Operator 11: nearest neighbours by inner product, by adaptive dimension scans of probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, importable, stored

#: Rows (those of smallest hash) and components that the lists' centres are fitted on, at most; lists at most; rounds.
SAMPLE, SAMPLE_VALUES, LISTS, ROUNDS = 16_384, 1 << 22, 1024, 8
#: Rows whose scores give a query its first bound; queries whose true neighbours (over all rows) tell how many lists to
#: probe, and the share of those neighbours that must lie in them.
SEEDS, TUNED, PROBED = 512, 128, 0.97
#: Rows of a group (whole lists, or a part of a large one) and queries of a block: what a task holds, and what it streams.
GROUP, BLOCK = 8192, 1 << 16
#: Columns of a block; chance that a test abandons a candidate as near as the bound.
COLUMNS, ALPHA = 16, 1e-3
#: Pairs of queries and rows that are scanned at a time, and the share of them below which those that are left are gathered.
PAIRS, GATHER = 1 << 19, 0.25
#: Tasks that groups and blocks are dealt to, at most.
TASKS = 20_000
ROW = "list int, vec_id bigint, h bigint, copies bigint, v array<double>"
DEALT = "key bigint, is_query boolean, vec_id bigint, h bigint, copies bigint, v array<double>, lists array<int>, bound double"
FOUND = "query_id bigint, query_h bigint, query_copies bigint, vec_id bigint, copies bigint, score double"


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list array, with zeros up to dims."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - at] = flat
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d) if d else np.zeros(n + 1), pa.int32()), pa.array(rows.reshape(-1)))


def units(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(1, keepdims=True, initial=0)
    rows = rows / np.where(top > 0, top, 1)
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first component to the last: equal rows score equally."""
    return np.cumsum(rows * query, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def centres_of(rows: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Directions of the lists: k-means by the cosine."""
    rows = np.unique(units(rows), axis=0)
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([(rows[a : a + 2048] @ centres.T).argmax(1) for a in range(0, len(rows), 2048)])
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres = np.where(np.abs(total).sum(1, keepdims=True) > 0, units(total), centres)
    return centres


def share_quantiles(dims: int, columns: int, alpha: float) -> np.ndarray:
    """For each block of columns but the last: the part of a difference's squared length that its first d components have
    at most, but for a chance of alpha. In a random rotation that part is Beta(d/2, (dims-d)/2) distributed."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for d in range(columns, dims, columns):
        log = (d / 2 - 1) * np.log(x) + ((dims - d) / 2 - 1) * np.log1p(-x)
        p = np.cumsum(np.exp(log - log.max()))
        out.append(x[np.searchsorted(p, (1 - alpha) * p[-1])] + 1 / 20_000)
    return np.array(out)


@dataclass
class Index:
    """What is fitted on the sample, the same size at any size of the table."""

    dims: int
    scale: float  # components are divided by it before they are rotated
    rotation: np.ndarray
    centres: np.ndarray
    shares: np.ndarray
    seeds: np.ndarray  # the vectors of SEEDS rows, scaled; their hashes and lists
    seed_h: np.ndarray
    seed_list: np.ndarray

    def nearest_list(self, rows: np.ndarray) -> np.ndarray:
        return (units(rows) @ self.centres.T).argmax(1) if len(rows) else np.zeros(0, np.int64)


class Group:
    """A task's rows: by list, rotated, in blocks of columns."""

    def __init__(self, index: Index, lists: np.ndarray, ids: np.ndarray, h: np.ndarray, copies: np.ndarray, rows: np.ndarray):
        order = np.lexsort((ids, lists))
        self.index, self.ids, self.h, self.copies, self.rows = index, ids[order], h[order], copies[order], rows[order]
        self.of = {int(x): (int(a), int(b)) for x, a, b in zip(*self._spans(lists[order]), strict=True)}
        turned = (self.rows / index.scale) @ index.rotation
        self.turned = turned
        self.blocks = [np.ascontiguousarray(turned[:, a : a + COLUMNS].T) for a in range(0, index.dims, COLUMNS)]
        before = np.cumsum([(b * b).sum(0) for b in self.blocks], axis=0)  # squared length of the first blocks
        self.before, self.square = before, before[-1]
        self.rest = np.sqrt(np.maximum(0, self.square - before))
        self.is_seed = np.isin(self.h, index.seed_h)
        self.longest = float(np.sqrt(self.square.max(initial=0)))
        self.scanned = self.tested = 0  # components read, and that a whole scan would have read

    @staticmethod
    def _spans(lists: np.ndarray) -> tuple:
        at = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else np.zeros(0, np.int64)
        return lists[at], at, np.append(at[1:], len(lists))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, query_h: np.ndarray, probed: list[list[int]], bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, place, score) of the k best rows of its lists that the scan finds for each query, ties to smaller
        ids. A list is scanned for all queries that probe it, in pieces of at most PAIRS pairs.

        A piece adds one block of columns at a time to its inner products. A pair's partial squared distance,
        q^2 + x^2 - 2qx over the columns so far, is tested against the distance of a row whose inner product is the
        query's bound (the k-th best so far): the row goes where a rotation would leave so much in so few columns with a
        chance of ALPHA only, or where even the rest's lengths can't lift it to the bound. Seeds only go by the latter.
        While many pairs stay they are a matrix product, then the pairs that are left are gathered."""
        ix = self.index
        q = (queries / ix.scale) @ ix.rotation
        edges = range(0, ix.dims, COLUMNS)
        before = np.cumsum([(q[:, a : a + COLUMNS] ** 2).sum(1) for a in edges], axis=0)
        rest = np.sqrt(np.maximum(0, before[-1] - before))
        slack = 1e-10 * np.sqrt(before[-1]) * self.longest
        bounds = bounds.astype(float).copy()
        asking: dict[tuple[bool, int], list[int]] = {}  # a query's nearest list gives it a bound before the others
        for i, lists in enumerate(probed):
            for x in lists:
                asking.setdefault((x != lists[0], x), []).append(i)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for later, x in sorted(asking):
            if x not in self.of:
                continue
            a, b = self.of[x]
            rows = np.array(asking[later, x], np.int64)
            step = max(1, PAIRS // (b - a))
            for c in range(0, len(rows), step):
                r, at = self._piece(q, rows[c : c + step], a, b, before, rest, slack, bounds)
                own = (self.ids[at] == query_ids[r]) & (self.h[at] == query_h[r]) & (self.copies[at] == 1)
                r, at = r[~own], at[~own]
                if not len(r):
                    continue
                mine = np.isin(best[0], r)
                r, at, score = np.concatenate([best[0][mine], r]), np.concatenate([best[1][mine], at]), np.concatenate([best[2][mine], inner(self.rows[at], queries[r])])
                order = np.lexsort((self.ids[at], -score, r))
                r, at, score = r[order], at[order], score[order]
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
                full = rank == k - 1
                bounds[r[full]] = np.maximum(bounds[r[full]], score[full] / ix.scale / ix.scale)
                keep = rank < k
                best = tuple(np.concatenate([u[~mine], v[keep]]) for u, v in zip(best, (r, at, score), strict=True))
        return best

    def _piece(self, q: np.ndarray, rows: np.ndarray, a: int, b: int, before: np.ndarray, rest: np.ndarray, slack: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query rows, places) of the pairs of rows and the list at a to b that no test abandons."""
        ix, last = self.index, len(self.blocks) - 1
        self.tested += len(rows) * (b - a) * ix.dims
        r, at = rows[:, None], np.arange(a, b)[None, :]
        ip: np.ndarray = np.zeros((len(rows), b - a))
        for j, block in enumerate(self.blocks):
            part = q[:, j * COLUMNS : j * COLUMNS + block.shape[0]]
            if ip.ndim == 2:
                ip = ip + part[rows] @ block[:, a:b]
            else:
                ip = ip + np.einsum("ij,ij->i", part[r], self.turned[at, j * COLUMNS : j * COLUMNS + block.shape[0]])
            self.scanned += ip.size * block.shape[0]
            bound = bounds[r] - slack[r]
            if j == last:
                keep = ip >= bound
            else:
                radius = before[-1][r] + self.square[at] - 2 * bound
                keep = before[j][r] + self.before[j][at] - 2 * ip <= radius * ix.shares[j]
                keep |= self.is_seed[at]
                keep &= ip + rest[j][r] * self.rest[j][at] >= bound
            if ip.ndim == 2 and (j == last or keep.mean() < GATHER):
                i, c = np.nonzero(keep)
                ip, r, at = ip[i, c], rows[i], c + a
            elif ip.ndim == 1:
                ip, r, at = ip[keep], r[keep], at[keep]
        return r, at


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v, copies, h: distinct (id, vector) rows, how many rows they stand for, and a hash of both. Left out: null
    ids, vectors that are null, empty, zero or hold null or non-finite components."""
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(F.col(vector_col), lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    return rows.select("vec_id", "copies", F.xxhash64("vec_id", "v").alias("h"), F.col("v").cast("array<double>").alias("v"))


def fit(rows: DataFrame, n: int, dims: int, largest: float) -> Index:
    count = max(1, min(SAMPLE, SAMPLE_VALUES // max(1, dims)))
    sample = rows.orderBy("h").limit(count).select("h", "v").toArrow()
    x, h = matrix(sample["v"], dims), sample["h"].to_numpy()
    scale = float(2.0 ** np.floor(np.log2(largest))) if largest > 0 else 1.0
    lists = max(1, min(LISTS, round(n**0.5), len(x) // 8))
    centres = centres_of(x, lists)
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(dims, dims)))[0]
    index = Index(dims, scale, rotation, centres, share_quantiles(dims, COLUMNS, ALPHA), x[:SEEDS] / scale, h[:SEEDS], np.zeros(0, np.int64))
    index.seed_list = index.nearest_list(x[:SEEDS])
    return index


def _assign(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = index.value.nearest_list(matrix(b.column("v"), index.value.dims))
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column("vec_id"), b.column("h"), b.column("copies"), b.column("v")], ["list", "vec_id", "h", "copies", "v"])


def _neighbours(batches: Iterator[pa.RecordBatch], queries, k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """(query, score, list) of a task's k best rows for each query by plain inner products."""
    q, qh = queries.value
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qh]
    for b in batches:
        x, lists, h = matrix(b.column("v"), dims), b.column("list").to_numpy(), b.column("h").to_numpy()
        scores = q @ x.T
        scores[qh[:, None] == h[None, :]] = -np.inf
        for i, s in enumerate(scores):
            s, at = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], lists])
            top = np.argsort(-s, kind="stable")[:k]
            best[i] = s[top], at[top]
    for i, (s, at) in enumerate(best):
        real = s > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array([i] * int(real.sum()), pa.int32()), pa.array(s[real]), pa.array(at[real], pa.int32())], ["query", "score", "list"])


def lists_to_probe(rows: DataFrame, index: Index, every: int, k: int) -> int:
    """How many lists, the nearest first, hold PROBED of the true k neighbours of TUNED queries (those of smallest hash),
    found among all rows."""
    spark = rows.sparkSession
    asked = rows.filter(F.col("vec_id") % every == 0).orderBy("h").limit(TUNED).select("h", "v").toArrow()
    if not asked.num_rows:
        return 1
    q = matrix(asked["v"], index.dims)
    told = spark.sparkContext.broadcast((q / index.scale, asked["h"].to_numpy()))
    near = rows.mapInArrow(partial(_neighbours, queries=told, k=k, dims=index.dims), "query int, score double, list int")
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("at") <= k).select("query", "list").toArrow()
    order = np.argsort(-(units(q) @ index.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort(place[near["query"].to_numpy(), near["list"].to_numpy()])
    return int(needed[min(len(needed) - 1, int(np.ceil(PROBED * len(needed))) - 1)]) + 1 if len(needed) else 1


def _ask(batches: Iterator[pa.RecordBatch], index, groups, probes: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each query once for each group with a list that it probes."""
    ix: Index = index.value
    first, parts, sizes = groups.value
    for b in batches:
        q, h = matrix(b.column("v"), ix.dims), b.column("h").to_numpy()
        order = np.argsort(-(units(q) @ ix.centres.T), axis=1, kind="stable") if len(q) else np.zeros((0, 1), np.int64)
        known = (q / ix.scale) @ ix.seeds.T
        ids, copies = b.column("vec_id").to_numpy(), b.column("copies").to_numpy()
        rows: list[tuple[int, int, list[int], float]] = []  # query's place in the batch, group, its lists there, bound
        for i in range(len(q)):
            held = np.cumsum(sizes[order[i]])
            p = max(probes, int(np.searchsorted(held, k + 1)) + 1)  # lists that hold k rows besides its own
            mine = order[i][:p]
            seed = known[i][np.isin(ix.seed_list, mine) & (ix.seed_h != h[i])]
            bound = float(np.partition(seed, len(seed) - k)[len(seed) - k]) if len(seed) >= k else -np.inf
            by_group: dict[int, list[int]] = {}
            for x in mine.tolist():
                for g in range(first[x], first[x] + parts[x]):
                    by_group.setdefault(g, []).append(x)
            rows += [(i, g, lists, bound) for g, lists in by_group.items()]
            if len(rows) >= 2000 or i == len(q) - 1:
                for a in range(0, len(rows), 2000):
                    at, groups_, lists, bounds = zip(*rows[a : a + 2000], strict=True)
                    z = np.array(at)
                    columns = [pa.array(groups_, pa.int64()), pa.array(ids[z]), pa.array(h[z]), pa.array(copies[z]), _lists(q[z]), pa.array(lists, pa.list_(pa.int32())), pa.array(bounds, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["grp", "vec_id", "h", "copies", "v", "lists", "bound"])
                rows = []


def _scan(batches: Iterator[pa.RecordBatch], index, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of key, a key's candidates before its queries: its group is held, its queries pass."""
    ix: Index = index.value
    key, gathered, group = None, [], None
    for b in batches:
        keys, asks = b.column("key").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1]))) if len(keys) else []
        for a, z in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            part = b.slice(a, z - a)
            if keys[a] != key:
                key, gathered, group = keys[a], [], None
            if not asks[a]:
                gathered.append(pa.RecordBatch.from_arrays([part.column(c) for c in ("lists", "vec_id", "h", "copies", "v")], ["lists", "vec_id", "h", "copies", "v"]))
                continue
            if group is None:
                if not gathered:
                    continue
                t = pa.Table.from_batches(gathered)
                lists = t["lists"].combine_chunks().flatten().to_numpy()
                group, gathered = Group(ix, lists, t["vec_id"].to_numpy(), t["h"].to_numpy(), t["copies"].to_numpy(), matrix(t["v"], ix.dims)), []
            ids, h, bounds = (part.column(c).to_numpy() for c in ("vec_id", "h", "bound"))
            row, at, score = group.search(matrix(part.column("v"), ix.dims), ids, h, part.column("lists").to_pylist(), bounds, k)
            qid, qh, qn = (part.column(c).to_numpy()[row] for c in ("vec_id", "h", "copies"))
            copies = group.copies[at] - ((group.ids[at] == qid) & (group.h[at] == qh))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid, qh, qn, group.ids[at], copies, score)], ["query_id", "query_h", "query_copies", "vec_id", "copies", "score"])


def packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, number of groups) of each list, and how many groups there are: lists in turn fill a group up to GROUP
    rows, a larger list has groups of its own."""
    first, parts, group, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for x, n in enumerate(sizes.tolist()):
        if n > GROUP:
            parts[x] = -(-n // GROUP)
            first[x], group, room = group + 1, group + int(parts[x]), 0
            continue
        if n > room or group < 0:
            group, room = group + 1, GROUP
        first[x], room = group, room - n
    return first, parts, group + 1


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows of largest inner
    product that the index finds (all, if there are fewer), ties to smaller ids.

    Rows lie in lists by direction. The lists' centres are fitted on SAMPLE rows; every row is in a list. How many lists a
    query probes is measured: the true neighbours of TUNED queries among all rows tell it. Within the lists rows are
    abandoned early (Group.search). A task holds the rows of one group (8192, of a few lists or a part of a large one) and
    streams a block of queries past them; queries go to the groups of the lists they probe, rows to each block of 65,536
    queries. Results of groups are merged by the query, k rows a group at most before the shuffle.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Shorter vectors
    count as zero beyond their end. Rows of equal ids are each queries and candidates: a row leaves out itself only, and
    rows equal in id and vector are searched once and returned as often as they occur. Empty tables give an empty result;
    other columns are not read."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    importable(spark)
    paths = [fresh(spark, "vectors"), fresh(spark, "listed"), fresh(spark, "found")]
    rows = stored(valid_vectors(vectors, id_col, vector_col), paths[0])
    n, dims, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fitted = fit(rows, n, dims, largest)
    index = sc.broadcast(fitted)
    listed = stored(rows.mapInArrow(partial(_assign, index=index), ROW), paths[1])
    sizes = np.zeros(len(fitted.centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    first, parts, count = packed(sizes)
    asked = listed.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK))
    probes = lists_to_probe(listed, fitted, every, k)
    places = spark.createDataFrame([(x, int(a), int(b)) for x, (a, b) in enumerate(zip(first, parts, strict=True))], "list int, first bigint, parts bigint")
    group = F.col("first") + F.pmod(F.xxhash64("h"), F.col("parts"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = listed.join(F.broadcast(places), "list").withColumn("block", each).select((group * blocks + F.col("block")).alias("key"), F.lit(False).alias("is_query"), "vec_id", "h", "copies", "v", F.array("list").alias("lists"), F.lit(0.0).alias("bound"))
    told = sc.broadcast((first, parts, sizes))
    queries = asked.mapInArrow(partial(_ask, index=index, groups=told, probes=probes, k=k), "grp bigint, vec_id bigint, h bigint, copies bigint, v array<double>, lists array<int>, bound double")
    queries = queries.select((F.col("grp") * blocks + F.pmod(F.xxhash64("h", F.lit("block")), F.lit(blocks))).alias("key"), F.lit(True).alias("is_query"), "vec_id", "h", "copies", "v", "lists", "bound")
    tasks = min(TASKS, count * blocks)
    dealt = candidates.unionByName(queries).repartitionById(tasks, F.pmod("key", F.lit(tasks)).cast("int")).sortWithinPartitions("key", "is_query")
    found = dealt.select(*[c.split()[0] for c in DEALT.split(", ")]).mapInArrow(partial(_scan, index=index, k=k), FOUND)
    found = found.withColumn("_", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k).cast("long")).cast("int")))).drop("_", "copies")
    best = Window.partitionBy("query_id", "query_h", "query_copies").orderBy(F.desc("score"), "vec_id")
    ranked = stored(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), paths[2])
    for path in paths[:2]:
        dropped(spark, path)
    copies = F.explode(F.sequence(F.lit(1), F.col("query_copies").cast("int")))
    return ranked.withColumn("_", copies).select("query_id", "rank", "vec_id", "score")
