"""Operator 12: periodic runs of words, by catchers of squares over completed power-of-two blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words that are appended to the catchers at a time.
APPEND = 1 << 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Collision(Exception):
    """Two different stretches had the same name."""


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Catchers:
    """Squares in a stream of words, caught as it grows.

    Level k keeps a catcher for each completed block of B = 2^k words, at the multiples of B. The catcher at s compares
    the two blocks from s on with every suffix of 2B words that ends at a new word and begins B to 2B words after s: the
    first that is equal, at s + q, is a square of period q (the stretch from s has period q and is q + 2B words long).
    Equal stretches have equal names: level k's name of a place is that of two names of level k - 1, a 64-bit mix or,
    after a collision, a number. So an appended word costs a name and a comparison a level.

    A run of period q, B <= q < 2B, and at least 4q words contains two whole blocks and the same q words later, so that it
    is caught; and no shorter period can be caught at these blocks, as the two would have a common one (Fine and Wilf).
    """

    def __init__(self, longest: int, exact: bool = False):
        """longest: words of the longest stretch that may be one run; longer periods than its quarter are not caught."""
        self.words = np.zeros(0, np.uint64)
        self.levels = max(0, (max(longest, 0) // 4).bit_length())
        self.names: list[np.ndarray] = [np.zeros(0, np.uint64) for _ in range(self.levels + 1)]  # of places from base on
        self.base = [0] * (self.levels + 1)
        self.last = [-1] * self.levels  # the last block of the level that caught a square
        self.squares: list[list[np.ndarray]] = [[] for _ in range(self.levels)]
        self.known: list[dict] | None = [{} for _ in range(self.levels)] if exact else None

    def _name(self, k: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.known is None:
            return _mixed(left, right)
        known = self.known[k]
        return np.fromiter((known.setdefault(x, len(known)) for x in zip(left.tolist(), right.tolist(), strict=True)), np.uint64, len(left))

    def append(self, words: np.ndarray) -> None:
        self.words = np.concatenate([self.words, words.astype(np.uint64)])
        new = words.astype(np.uint64)
        n = len(self.words)
        for k in range(self.levels + 1):
            self.names[k] = np.concatenate([self.names[k], new])
            if k == self.levels:
                break
            size, names, base = 1 << k, self.names[k], self.base[k]
            begin, end = self.base[k + 1] + len(self.names[k + 1]), max(0, n - 2 * size + 1)  # places that get a name of 2 blocks
            if end <= begin:
                break
            new = self._name(k, names[begin - base : end - base], names[begin + size - base : end + size - base])
        for k in range(self.levels):
            self._compare(k, n - len(words), n)
        for k in range(self.levels + 1):  # places that neither a later name nor a later comparison needs
            spare = len(self.names[k]) - (4 << k)
            if spare > APPEND:
                self.names[k], self.base[k] = self.names[k][spare:], self.base[k] + spare

    def _compare(self, k: int, before: int, n: int) -> None:
        size, names, base = 1 << k, self.names[k + 1], self.base[k + 1]
        begin, end = max(size, before - 2 * size + 1), n - 2 * size + 1
        if end <= begin:
            return
        first, stop = (begin >> k) - 1, ((end - 1) >> k)  # the blocks that are compared
        own = np.repeat(names[(first << k) - base : ((stop - 1) << k) + 1 - base : size], size)
        shift = begin - ((first + 1) << k)
        at = np.flatnonzero(names[begin - base : end - base] == own[shift : shift + end - begin])
        if not len(at):
            return
        at += begin
        s = ((at >> k) - 1) << k
        fresh = np.append(True, s[1:] != s[:-1]) & (s > self.last[k])
        if fresh.any():
            self.last[k] = int(s[fresh][-1])
            self.squares[k].append(np.stack([s[fresh], at[fresh] - s[fresh]]))

    def runs(self, least: int = 6, times: int = 4) -> np.ndarray:
        """(start, length, period) of every run of at least max(least, times * period) words, times >= 4, in order of
        start, then period. Squares of one period whose stretches share a period are one run, which then takes in
        neighbouring words while the period holds."""
        w, found = self.words, np.zeros((0, 3), np.int64)
        for k, caught in enumerate(self.squares):
            if not caught:
                continue
            size = 1 << k
            s, q = np.concatenate(caught, axis=1)
            if len(found):  # of a shorter period: its run contains the stretch
                order = np.argsort(found[:, 0], kind="stable")
                ends = np.maximum.accumulate((found[:, 0] + found[:, 1])[order])
                at = np.searchsorted(found[order, 0], s, "right") - 1
                inside = (at >= 0) & (ends[np.maximum(at, 0)] >= s + q + 2 * size)
                s, q = s[~inside], q[~inside]
            order = np.lexsort((s, q))
            s, q = s[order], q[order]
            cut = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (s[1:] - s[:-1] > 2 * size))) if len(s) else np.zeros(0, np.int64)
            lows, periods, highs = s[cut], q[cut], (s + q + 2 * size)[np.append(cut[1:], len(s)) - 1] if len(s) else s
            may = highs - lows + 2 * size - 2 >= np.maximum(least, times * periods)
            out = []
            for low, high, p in zip(lows[may].tolist(), highs[may].tolist(), periods[may].tolist(), strict=True):
                if not np.array_equal(w[low : high - p], w[low + p : high]):
                    raise Collision
                a = max(0, low - size)
                other = np.flatnonzero(w[a:low] != w[a + p : low + p])
                low = a + int(other[-1]) + 1 if len(other) else a
                b = min(len(w), high + size)
                other = np.flatnonzero(w[high:b] != w[high - p : b - p])
                high = high + int(other[0]) if len(other) else b
                if high - low >= max(least, times * p):
                    out.append((low, high - low, p))
            found = np.concatenate([found, np.array(out, np.int64).reshape(-1, 3)])
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: np.ndarray, longest: int | None = None, least: int = 6, times: int = 4) -> np.ndarray:
    """Catchers.runs() of a whole stream of word numbers."""
    for exact in (False, True):
        catchers = Catchers(len(words) if longest is None else longest, exact)
        for a in range(0, len(words), APPEND):
            catchers.append(words[a : a + APPEND])
        try:
            return catchers.runs(least, times)
        except Collision:
            if exact:
                raise
    raise AssertionError


def _scan(batches: Iterator[pa.RecordBatch], least: int, times: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist() if batch.num_rows else []
        for a, b in slices(sizes):
            part = batch.slice(a, b - a)
            text = pc.ascii_trim_whitespace(pc.fill_null(part.column("text"), ""))
            lists = pc.ascii_split_whitespace(text)
            values = lists.flatten()
            real = pc.not_equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)  # an empty text is one empty word
            ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            if not real.all():
                values = values.filter(pa.array(real))
            n = np.diff(ends)
            docs = len(n)
            # one stream of all words, a word of its own after each document
            stream = np.empty(len(values) + docs, np.int64)
            of = np.repeat(np.arange(docs), n)
            stream[np.arange(len(values)) + of] = values.dictionary_encode().indices.to_numpy()
            stream[ends[1:] + np.arange(docs)] = np.arange(docs) + len(values)
            runs = runs_of(stream, int(n.max(initial=0)), least, times)
            starts = ends[:-1] + np.arange(docs)
            of = np.searchsorted(starts, runs[:, 0], "right") - 1
            # a document's first word of a run's second period and those after it, to its end
            edge = np.zeros(len(values) + 1, np.int64)
            np.add.at(edge, runs[:, 0] - of + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] - of + runs[:, 1], -1)
            keep = np.cumsum(edge)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[ends]
            left = values if keep.all() else values.filter(pa.array(keep))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), left), " ")
            fields = [pa.array(x, pa.int64()) for x in (runs[:, 0] - starts[of], runs[:, 1], runs[:, 2])]
            at = pa.array(np.searchsorted(of, np.arange(docs + 1)), pa.int32())
            listed = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), listed, collapsed]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs, collapsed per row of docs.

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q, at least
    max(least, times * q) long (times >= 4), that no neighbouring word extends; `runs` has start (word number from 0),
    length and period of each in order of start, then period. `collapsed` is the text without the words that are in some
    run after its first q words, one space between words.

    Nothing is shuffled and nothing outlives a slice of documents (about 2 MB, or one longer text), whose words are one
    stream of the catchers. Null, empty and blank texts have no words. Rows with equal or null ids each keep a row; an
    empty table gives an empty result; other columns are not read."""
    if times < 4 or least < 3:
        raise ValueError("runs of fewer than 4 periods or 3 words are not caught")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
    return narrow.mapInArrow(partial(_scan, least=least, times=times, schema=schema), f"doc_id {kind.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten (crc32 h of its decimals: h % 10 = 0, g = h div 10) its words up to word a = g % n,
    from which on the next p = 1 + (n - a) div (3 + g % 8) words are repeated to the text's length."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    made = F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))), F.lit(1), n)
    made = F.array_join(made, " ")
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & (n > 0), made).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run (ties: smallest start, then period; null
    without runs), runs_sha256 and collapsed_sha256."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.minus")
    return out.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), F.floor(1000 * length / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
