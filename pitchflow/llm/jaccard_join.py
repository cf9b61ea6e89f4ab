"""Operator 10: exact n-gram Jaccard join by set-relation skipping, and its classes of linked documents.

Sets are joined, not documents: equal sets are one node. Nodes meet in the lists of an inverted index over prefixes: of a
set's shingles in one global order, rare before frequent, two sets that link share one among each one's first fifth.
The order is exact: a shuffle finds each shingle that recurs anywhere, with its count, and only those have lists.
What spares work:

* Index level. A list's rows lie in blocks by size class and position. A row whose position leaves too little of the set
  behind it (9 * position > size, at 80 percent) can only be the larger of a pair, so two such blocks never meet; a block
  is skipped whole where no other block's least and largest sizes and least position admit a partner. Lists with the same
  members are kept once.
* Answer level. A set takes over the answer of a set that is highly similar to it: rounds join each list only to one
  leader, a set with few shingles of its own, whoever links to it gets its class, and each round looks only at pairs of
  different classes, so a group of copies costs pairs in proportion to its size. The last round leaves no pair out, but derives each set's answer from that
  of its leader: what is further from the leader than the set's own distance and the bound together can't link to it, so
  the distances that are known spare the fetching of whole sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fresh, joined_by, releasing, stored, text_slices

#: Frequent shingles are told apart by at most so many counts (16 bytes each); they go to all tasks.
HOT = 1 << 18
#: A shingle is frequent if it recurs so often within the tasks' own slices, of which counts from LEAST_LOCAL on are told.
LEAST_HOT, LEAST_LOCAL = 64, 4
#: Shingles of about so many sets are looked through at once, and sets of a block of numbers.
FLUSH, BLOCK_BITS = 2_000_000, 13
#: A partition that counts shingles holds about so many.
BUCKET = 2_000_000
#: Bits of the filter of candidate sets (2 to 32 MB), which spares moving most other sets.
FILTER_BITS, MOST_FILTER_BITS = 24, 28
LEADER_ROUNDS = 2
#: Texts of about so many bytes are hashed at once: some twenty times as much memory.
SLICE = 1 << 19
A, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@functools.lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """(a number for each byte, A-Z as a-z; whether it parts words)."""
    number = np.random.default_rng(1710).integers(1, 1 << 63, 256, np.uint64)
    number[65:91] = number[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    number[space] = 0
    return number, space


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    up, down = np.full(n, A), np.full(n, np.uint64(pow(int(A), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles: runs of `width` words, A-Z lower-cased; all words of a
    shorter text; none without words. Words are hashed all at once: the hash is a difference of running sums of the
    bytes' numbers times powers, shifted to the word's beginning."""
    number, space = _bytes()
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    size = 1 << max(16, (len(data) - 1).bit_length())
    up, down = _powers(size)
    sums = np.cumsum(number[data] * up[: len(data)])
    parts = space[data]
    begins, ends = np.flatnonzero(parts[:-1] & ~parts[1:]) + 1, np.flatnonzero(~parts[:-1] & parts[1:])
    h = mixed((sums[ends] - sums[begins - 1]) * down[begins])
    lengths = np.array([len(t) + 1 for t in texts])
    edges = np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)]) + 1)
    runs = np.zeros(0, np.uint64)
    if len(h) >= width:
        n = len(h) - width + 1
        runs = np.full(n, width, np.uint64)
        for i in range(width):
            runs = runs * A + h[i : n + i]
        runs = mixed(runs)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])].view(np.int64)
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = one * A + h[i : i + 1]
            yield mixed(one).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else 0


@releasing
def _survey(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, node, size) of documents, and (shingle, n) of shingles that several of the task's sets have."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    total = 0
    empty = pa.nulls

    def repeats() -> pa.RecordBatch:
        s = np.concatenate(held)
        held.clear()
        s.sort()
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        counts = np.diff(ends, prepend=-1)
        many = counts >= LEAST_LOCAL
        k = int(many.sum())
        return pa.RecordBatch.from_arrays([empty(k, kind), pa.array(s[ends[many]]), pa.array(counts[many], pa.int64()), pa.array([True] * k, pa.bool_())], ["doc_id", "node", "n", "is_shingle"])

    kind = pa.int64()
    for part, texts in text_slices(batches, "text", SLICE):
        kind = part.schema.field("doc_id").type
        nodes, sizes = [], []
        for s in shingle_sets(texts, width):
            nodes.append(node := node_of(s))
            sizes.append(len(s))
            if node not in seen and len(s):
                seen.add(node)
                held.append(s)
                total += len(s)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([False] * len(nodes), pa.bool_())], ["doc_id", "node", "n", "is_shingle"])
        if total > FLUSH:
            yield repeats()
            total = 0
            if len(seen) > 1_000_000:
                seen.clear()
    if held:
        yield repeats()


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """data cut at starts, as binary values."""
    bounds = np.append(starts, len(data)).astype(np.int32) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _packed(**columns) -> pa.RecordBatch:
    kinds = {f.name: f.type for f in PACKED_TYPES}
    n = max(len(c) for c in columns.values() if not np.isscalar(c))
    arrays = []
    for name, kind in kinds.items():
        c = columns.get(name)
        if c is None:
            arrays.append(pa.nulls(n, kind))
        elif np.isscalar(c):
            arrays.append(pa.array(np.full(n, c), kind))
        else:
            arrays.append(c if isinstance(c, pa.Array) else pa.array(c, kind))
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


#: kind 0: shingles (ids' low halves) of a bucket; 1: sets (node; size and number of shingles that aren't frequent);
#: 2: frequent shingles of prefixes (id; position); 3: recurring shingles (low half; count), base being their bucket.
PACKED = "dest int, kind int, block bigint, base bigint, off binary, val binary, x binary"
PACKED_TYPES = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("base", pa.int64()), ("off", pa.binary()), ("val", pa.binary()), ("x", pa.binary())])


def _prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _home(block: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(block.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


@releasing
def _spread(batches: Iterator[pa.RecordBatch], width: int, percent: int, hot, parts: int) -> Iterator[pa.RecordBatch]:
    """Each set's shingles, dealt to buckets by their ids: 6 bytes each, packed by the bucket. A set is known by its task's
    block of sets and its number (off) in it."""
    from pyspark import TaskContext

    keys, counts = hot.value
    keys, counts = np.append(keys, np.iinfo(np.int64).max), np.append(counts, 0)  # a search's end
    bits = np.zeros(1 << 24, bool)  # most shingles are told not to be frequent by their last bits
    bits[keys & (len(bits) - 1)] = True
    block = TaskContext.get().partitionId() << (33 - BLOCK_BITS)
    seen: set[int] = set()
    plain: list[np.ndarray] = []
    sets: list[tuple[int, int, int]] = []
    hots: list[tuple[int, int, int]] = []
    total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        home = int(_home(np.array([block]), parts)[0])
        zero = np.zeros(1, np.int64)
        info = np.array(sets, np.int64)
        yield _packed(dest=[home], kind=1, block=block, base=0, off=_binary(np.arange(len(sets), dtype="<u2"), zero), val=_binary(info[:, 0], zero), x=_binary(info[:, 1:].astype("<u4").ravel(), zero))
        if hots:
            h = np.array(hots, np.int64)
            yield _packed(dest=[home], kind=2, block=block, base=0, off=_binary(h[:, 0].astype("<u2"), zero), val=_binary(h[:, 1], zero), x=_binary(h[:, 2].astype("<u4"), zero))
        if total:
            s = np.concatenate(plain).view(np.uint64)
            off = np.repeat(np.arange(len(plain), dtype=np.uint16), [len(x) for x in plain])
            bucket = ((s >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            yield _packed(dest=bucket[starts].astype(np.int32), kind=0, block=block, base=0, off=_binary(off[order].astype("<u2"), starts), val=_binary((s & np.uint64(0xFFFFFFFF)).astype("<u4")[order], starts))
        plain.clear(), sets.clear(), hots.clear()

    for _, texts in text_slices(batches, "text", SLICE):
        for s in shingle_sets(texts, width):
            n = len(s)
            if not n or (node := node_of(s)) in seen:
                continue
            seen.add(node)
            frequent = bits[s & (len(bits) - 1)]
            if frequent.any():
                f = s[frequent]
                at = np.searchsorted(keys, f)
                found = keys[at] == f
                frequent[np.flatnonzero(frequent)[~found]] = False
                s, f, c = s[~frequent], f[found], counts[at[found]]
                over = _prefix_length(n, percent) - len(s)
                if over > 0:
                    f = f[np.lexsort((f, c))][:over]
                    hots.extend(zip([len(sets)] * len(f), f.tolist(), range(len(s), len(s) + len(f)), strict=True))
            plain.append(s)
            sets.append((node, n, len(s)))
            total += len(s)
            if total >= FLUSH or len(sets) == 1 << BLOCK_BITS:
                yield from flush()
                total, block = 0, block + 1
                if len(seen) > 1_000_000:
                    seen.clear()
    if sets:
        yield from flush()


@releasing
def _recurring(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All shingles of a bucket are in one partition: those that more than one set has go back to the sets' blocks."""
    key, uid = [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind != 0).any():
            yield batch.filter(pa.array(kind != 0))
        rows = batch.filter(pa.array(kind == 0))
        for dest, block, off, val in zip(*(rows.column(c).to_pylist() for c in ("dest", "block", "off", "val")), strict=True):
            fp = np.frombuffer(val, "<u4")
            key.append(fp.astype(np.uint64) | np.uint64(dest << 32))
            uid.append(np.frombuffer(off, "<u2").astype(np.int64) | (block << BLOCK_BITS))
    if not key:
        return
    k, u = np.concatenate(key), np.concatenate(uid)
    key.clear(), uid.clear()
    order = np.argsort(k, kind="stable")
    k, u = k[order], u[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    n = np.diff(np.append(starts, len(k)))
    n = np.repeat(n, n)
    many = n > 1
    k, u, n = k[many], u[many], np.minimum(n[many], 65_535)
    if not len(k):
        return
    block, bucket = u >> BLOCK_BITS, (k >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((block, bucket))
    k, u, n, block, bucket = k[order], u[order], n[order], block[order], bucket[order]
    starts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1])))
    off = (u & ((1 << BLOCK_BITS) - 1)).astype("<u2")
    yield _packed(dest=_home(block[starts], parts), kind=3, block=block[starts], base=bucket[starts], off=_binary(off, starts), val=_binary((k & np.uint64(0xFFFFFFFF)).astype("<u4"), starts), x=_binary(n.astype("<u2"), starts))


POSTINGS = "shingle bigint, node bigint, size int, pos int, is_hot boolean"


@releasing
def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """All that concerns a set is in one partition: the recurring shingles of its prefix, with their places in the order.
    Those that nothing else has come first in it and need no rows."""
    parts: dict[int, list] = {1: [], 2: [], 3: []}
    for batch in batches:
        for kind, block, base, off, val, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "base", "off", "val", "x")), strict=True):
            uid = np.frombuffer(off, "<u2").astype(np.int64) | (block << BLOCK_BITS)
            if kind == 3:
                parts[3].append((uid, np.frombuffer(val, "<u4").astype(np.int64) | (base << 32), np.frombuffer(x, "<u2").astype(np.int64)))
            else:
                parts[kind].append((uid, np.frombuffer(val, "<i8"), np.frombuffer(x, "<u4").reshape(len(uid), -1).astype(np.int64)))
    if not parts[1]:
        return
    ids, nodes, sizes = (np.concatenate(c) for c in zip(*parts[1], strict=True))
    order = np.argsort(ids)
    ids, nodes, n, plain = ids[order], nodes[order], sizes[order, 0], sizes[order, 1]
    for kind in (2, 3):
        if not parts[kind]:
            continue
        uid, key, x = (np.concatenate(c) for c in zip(*parts[kind], strict=True))
        parts[kind].clear()
        if kind == 3:
            order = np.lexsort((key, x, uid))
            uid, key = uid[order], key[order]
            starts = np.flatnonzero(np.append(True, uid[1:] != uid[:-1]))
            many = np.diff(np.append(starts, len(uid)))
            at = np.searchsorted(ids, uid)
            pos = plain[at] - np.repeat(many, many) + np.arange(len(uid)) - np.repeat(starts, many)
        else:
            at, pos = np.searchsorted(ids, uid), x[:, 0]
        keep = pos < _prefix_length(n[at], percent)
        at, pos, key = at[keep], pos[keep], key[keep]
        shingle = mixed(key.view(np.uint64) ^ M1).view(np.int64) if kind == 3 else key
        for a in range(0, len(at), 20_000):
            z = slice(a, a + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[z]), pa.array(nodes[at[z]]), pa.array(n[at[z]], pa.int32()), pa.array(pos[z], pa.int32()), pa.array([kind == 2] * len(at[z]))], ["shingle", "node", "size", "pos", "is_hot"])


def live_blocks(shingle: np.ndarray, size: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """(whether some partner is possible for each row, blocks, blocks skipped) of rows in order of (shingle, size). A
    block: rows of one list, size class and side of the position bound. Whole blocks are held against those of the same
    list whose classes are near enough."""
    classes = np.floor(np.log(size) / math.log(100 / percent)).astype(np.int64)
    late = (100 + percent) * (size - pos) < 2 * percent * size  # too little is left for a partner of the same size or a larger one
    order = np.lexsort((late, classes, shingle))
    s, c, z, n, p = shingle[order], classes[order], late[order], size[order], pos[order]
    starts = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (z[1:] != z[:-1]))) if len(s) else np.zeros(0, np.int64)
    many = np.diff(np.append(starts, len(s)))
    if not len(starts):
        return np.zeros(0, bool), 0, 0
    low, high, first = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts), np.minimum.reduceat(p, starts)
    left = high - first  # what a set of the block has at most from its shared shingle on
    bs, bc, bz = s[starts], c[starts], z[starts]
    live = (many > 1) & ~bz
    for step in range(1, 6):  # three classes, two sides: what is further apart is too different in size
        i = np.arange(len(starts) - step) if len(starts) > step else np.zeros(0, np.int64)
        j = i + step
        ok = (bs[i] == bs[j]) & (bc[j] - bc[i] <= 2) & ~(bz[i] & bz[j]) & (100 * high[i] >= percent * low[j])
        ok &= ~(bz[i] & (low[j] >= high[i])) & ~(bz[j] & (low[i] >= high[j]))
        ok &= (100 + percent) * np.minimum(left[i], left[j]) >= percent * (low[i] + low[j])
        live[i[ok]] = live[j[ok]] = True
    rows = np.zeros(len(s), bool)
    rows[order] = np.repeat(live, many)
    return rows, len(starts), int((~live).sum())


@releasing
def _lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """All rows of a recurring shingle are in one partition: rows of blocks that are not skipped stay, and of lists with
    the same members one, with the least positions. Rows of frequent shingles pass."""
    rows: list[pa.RecordBatch] = []
    for b in batches:
        hot = b.column("is_hot").to_numpy(zero_copy_only=False)
        if hot.any():
            yield b.filter(pa.array(hot))
        if not hot.all():
            rows.append(b.filter(pa.array(~hot)))
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    rows.clear()
    s, node, n, p = (table.column(c).to_numpy() for c in ("shingle", "node", "size", "pos"))
    order = np.lexsort((node, n, s))
    order = order[np.append(True, (s[order][1:] != s[order][:-1]) | (node[order][1:] != node[order][:-1]))]
    s, node, n, p = s[order], node[order], n[order].astype(np.int64), p[order].astype(np.int64)
    stay, _, _ = live_blocks(s, n, p, percent)
    s, node, n, p = s[stay], node[stay], n[stay], p[stay]
    if not len(s):
        return
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    many = np.diff(np.append(starts, len(s)))
    members = np.repeat(mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts)).view(np.int64), many)
    order = np.lexsort((p, node, members))
    order = order[np.append(True, (members[order][1:] != members[order][:-1]) | (node[order][1:] != node[order][:-1]))]
    for a in range(0, len(order), 20_000):
        z = order[a : a + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(members[z]), pa.array(node[z]), pa.array(n[z], pa.int32()), pa.array(p[z], pa.int32()), pa.array([False] * len(z))], ["shingle", "node", "size", "pos", "is_hot"])


@releasing
def _sets(batches: Iterator[pa.RecordBatch], width: int, bits) -> Iterator[pa.RecordBatch]:
    words: np.ndarray = bits.value
    mask = len(words) * 64 - 1
    seen: set[int] = set()
    for _, texts in text_slices(batches, "text", SLICE):
        nodes, sets = [], []
        for s in shingle_sets(texts, width):
            node = node_of(s)
            at = node & mask
            if len(s) and (int(words[at >> 6]) >> (at & 63)) & 1 and node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(s)
        if len(seen) > 1_000_000:
            seen.clear()
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])


def node_filter(spark: SparkSession, nodes: DataFrame):
    """A broadcast bit map of the nodes' last bits: FILTER_BITS of them, or more (MOST_FILTER_BITS at most) where there are
    many nodes. What it lets through wrongly costs a shuffle and is left out by the joins."""
    n = nodes.distinct().count()
    width = min(MOST_FILTER_BITS, max(FILTER_BITS, (16 * n).bit_length()))
    at = F.col("node").bitwiseAND(F.lit((1 << width) - 1))
    found = nodes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(node & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (width - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(words)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) of all nodes of edges (a, b): comp is the smallest node of the connected component. Large-star and
    small-star steps in turn, each written to the shared folder, until every component is a star around its smallest node:
    about as many as the logarithm of the longest path, none for edges that are such stars. A node with many neighbours
    meets them by a minimum that is combined before the shuffle."""
    spark = edges.sparkSession

    def stars(df: DataFrame) -> bool:
        """No larger end has two edges or is some edge's smaller end."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]

    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), fresh(spark, name))
    while not stars(e):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, fresh(spark, name))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _may_link(percent: int, x: str = "x", y: str = "y"):
    """Size and position bounds of a pair that shares a shingle; a linked pair passes them at its first shared one."""
    nx, ny, px, py = (F.col(c) for c in (f"{x}.size", f"{y}.size", f"{x}.pos", f"{y}.pos"))
    both = (100 + percent) * (1 + F.least(nx - px - 1, ny - py - 1)) >= percent * (nx + ny)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & both


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, far) of distinct pairs: their Jaccard distance by whole sets, as the exact quotient of whole numbers."""
    sa, sb = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("all")).select("a", "b", "shared", "all", (1 - F.col("shared") / F.col("all")).alias("far"))


def linked(compared_: DataFrame, percent: int) -> DataFrame:
    return compared_.filter(100 * F.col("shared") >= percent * F.col("all"))


def undecided(pairs: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets must be compared: neither were they, nor does a leader's answer decide. Of a set's compared
    partners the nearest that it links to is its leader l; d(x, y) >= d(y, l) - d(x, l), as Jaccard distances obey the
    triangle inequality, so y is no partner of x where that is beyond the bound."""
    both = done.select("a", "b", "far").union(done.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    near = 1 - percent / 100 + 1e-9
    leader = both.filter(F.col("far") <= near).groupBy("a").agg(F.min(F.struct("far", "b")).alias("l")).select(F.col("a").alias("x"), F.col("l.b").alias("l"), F.col("l.far").alias("own"))
    known = both.select(F.col("a").alias("y"), F.col("b").alias("l"), F.col("far").alias("other"))
    left = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
    for x, y in (("a", "b"), ("b", "a")):
        left = left.join(leader.withColumnRenamed("x", x), x, "left").join(known.withColumnRenamed("y", y), [y, "l"], "left")
        left = left.filter(F.col("other").isNull() | (F.col("other") - F.col("own") <= near)).select("a", "b")
    return left


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def link_classes(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs: the smallest id reachable by links, a document's own included.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets. Three scans read whole
    texts: one for sets' sizes and for shingles that are frequent; one that deals each set's other shingles (6 bytes each)
    to the partitions that tell which recur; one for whole sets of those in lists with partners. Links are verified on
    whole sets of 64-bit shingle hashes (two different shingles share one with a chance of 2^-64). A shingle that a third
    of all sets have is frequent: its rows are dealt by set as well. Copies of a set in several tasks are one node from
    the lists on.

    Null and empty texts have no shingles and link to nothing, not even to each other. Rows with equal ids each keep a
    row; a null id is never the smallest. An empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        paths.append(fresh(spark, name))
        return stored(df, paths[-1])

    survey = kept(narrow.mapInArrow(partial(_survey, width=width), f"doc_id {kind}, node bigint, n bigint, is_shingle boolean"), "survey")
    members = survey.filter("NOT is_shingle").select("doc_id", "node", F.col("n").alias("n_shingles"))
    hot = sc.broadcast(frequent(survey.filter("is_shingle")))
    rows, total = members.agg(F.count("*"), F.sum("n_shingles")).first()
    parts = max(1, -(-(total or 0) // BUCKET))
    texts = narrow.select("text")
    dealt = texts.mapInArrow(partial(_spread, width=width, percent=percent, hot=hot, parts=parts), PACKED).repartitionById(parts, F.col("dest"))
    homes = dealt.mapInArrow(partial(_recurring, parts=parts), PACKED).repartitionById(parts, F.col("dest"))
    postings = homes.mapInArrow(partial(_prefixes, percent=percent), POSTINGS)
    # a frequent shingle's rows need no partition of their own, where they would meet: they are dealt by set as well
    dealt = postings.repartition(F.when(F.col("is_hot"), F.xxhash64("shingle", "node")).otherwise(F.col("shingle")))
    lists = kept(dealt.mapInArrow(partial(_lists, percent=percent), POSTINGS), "postings")
    lists = lists.groupBy("shingle", "node").agg(F.min("size").alias("size"), F.min("pos").alias("pos"))
    several = lists.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("shingle")
    lists = kept(lists.join(several, "shingle", "left_semi"), "lists")
    bits = node_filter(spark, lists.select("node"))
    sets = kept(texts.mapInArrow(partial(_sets, width=width, bits=bits), "node bigint, s array<bigint>").dropDuplicates(["node"]), "sets")
    done, comps = None, None
    for turn in range(LEADER_ROUNDS + 1):
        now = lists if comps is None else lists.join(comps, "node", "left")
        now = now.withColumn("comp", F.col("node") if comps is None else F.coalesce("comp", "node")).select("shingle", "node", "size", "pos", "comp")
        if comps is not None:
            now = kept(now, f"lists{turn}")
            several = now.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("shingle")
            now = now.join(several, "shingle", "left_semi")
        if turn < LEADER_ROUNDS:
            # the fewer rarer shingles a set has, the more sets are near it; later the same within another class
            tie = F.xxhash64("node", F.col("shingle").bitwiseAND(F.lit(3)))
            order = F.struct("pos", tie) if turn == 0 else F.struct(F.xxhash64("comp", F.lit(turn)), "pos", tie)
            other = now.groupBy("shingle").agg(F.min(F.struct(order.alias("o"), "node", "size", "pos", "comp")).alias("l")).select("shingle", "l.node", "l.size", "l.pos", "l.comp")
            x = now
        else:
            other = now
            largest = now.groupBy("shingle", "comp").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "comp")).alias("l")).select("shingle", F.col("l.comp").alias("largest"))
            x = now.join(largest, "shingle").filter("comp <> largest").drop("largest")
        x, y = x.alias("x"), other.alias("y")
        pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & _may_link(percent)).select(*_pair(F.col("x.node"), F.col("y.node"))).distinct()
        if done is not None:
            pairs = undecided(pairs, done, percent)
        new = kept(compared(pairs, sets), f"compared{turn}")
        done = new if done is None else done.union(new)
        links = linked(new, percent).select("a", "b")
        comps = components(links if comps is None else links.union(comps.select("node", "comp")))  # what is known stays a star
    ids = members.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"))
    ids = ids.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = ids.groupBy("comp").agg(F.min("smallest").alias("smallest"), F.sum("n").alias("n_all"), F.count("*").alias("n_nodes"))
    ids = ids.select("node", "n", "comp").join(of_comp.filter("n_all > 1"), "comp").select("node", "n", "smallest")
    found = joined_by(members.filter("n_shingles > 0"), kept(ids, "ids"), "node", "n", rows)
    found = kept(found.unionByName(members.filter("n_shingles = 0"), allowMissingColumns=True), "classes")
    for path in paths[:-1]:
        dropped(spark, path)
    return found.select("doc_id", "n_shingles", F.when(F.col("n").isNotNull(), F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def frequent(repeats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, counts) of the most frequent shingles, at most HOT: the smallest power of two from which on
    they are few enough bounds them."""
    counts = stored(repeats.groupBy("node").agg(F.sum("n").alias("n")), fresh(repeats.sparkSession, "repeats"))
    by_size = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}  # at most 64 rows
    bound, total = 64, 0
    while bound and 1 << (bound - 1) >= LEAST_HOT and total + by_size.get(bound - 1, 0) <= HOT:
        bound -= 1
        total += by_size.get(bound, 0)
    top = counts.filter(F.col("n") >= 1 << min(bound, 62)).toArrow()
    keys, n = top["node"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def oracle(percent: int = 80, width: int = 5) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i + 1 : i + least({width}, len(w))], ' ') AS sh FROM d, LATERAL (SELECT unnest(range(0, len(w) - least({width}, len(w)) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
r AS (SELECT rid, rid AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.rid)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN r USING (rid) JOIN d o ON o.rid = r.root GROUP BY d.rid, d.doc_id, n.n"""
