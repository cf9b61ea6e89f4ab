"""Joins of intervals by equality on cells of time."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are 2^level wide, from this level on. Where a cell's rows are searched instead of paired, wide cells (19 hours)
#: keep most rows in one cell.
LEAST_LEVEL, SEARCH_LEVEL = 30, 36


def _level(begin: Column, end: Column, least: int) -> Column:
    """The level whose cells are at least as wide as the interval, so that it touches two of them at most."""
    return F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(end - begin, F.lit(1)).cast("double"))).cast("int"))


def _placed(left: DataFrame, right: DataFrame, least: int) -> list[DataFrame]:
    """Both sides (l, r: the rows as structs, with begin, end and level) in the cells in which their overlaps meet."""
    sides = []
    for name, rows in (("l", left), ("r", right)):
        begin, end = F.col("begin_us"), F.greatest(F.coalesce("end_us", "begin_us"), "begin_us")
        sides.append(rows.filter(begin.isNotNull()).select(F.struct(*rows.columns).alias(name), begin.alias(f"{name}_begin"), end.alias(f"{name}_end"), _level(begin, end, least).alias(f"{name}_level")))
    found = sides[0].select(F.col("l_level").alias("v")).union(sides[1].select(F.col("r_level").alias("v"))).distinct().collect()  # a few dozen levels
    levels = sorted(r["v"] for r in found)
    placed = []
    for name, rows in zip("lr", sides, strict=True):
        own = F.col(f"{name}_level")
        at = rows.withColumn("level", F.explode(F.array_compact(F.array(*[F.when(own <= v, v) for v in levels] or [F.lit(None).cast("int")]))))
        cell = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("level"))
        at = at.withColumn(f"{name}_cell", cell(f"{name}_begin"))
        placed.append(at.withColumn("cell", F.explode(F.sequence(F.col(f"{name}_cell"), cell(f"{name}_end")))))
    return placed


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r: the rows as structs) whose intervals [begin_us, end_us] share a point; the columns are on both sides.
    A missing end is the begin, a missing begin overlaps nothing, an end before the begin is the begin.

    An interval lies in the cells of its own level that it touches, two at most, and in those of the coarser levels that
    occur at all. A pair meets at the coarser of its two levels and counts in the first cell that both touch, so that it is
    met once and no row is compared with more than those of its cells. Cells are as wide as the intervals in them: work
    follows the rows and the pairs, however lengths differ."""
    placed = _placed(left, right, LEAST_LEVEL)
    met = placed[0].join(placed[1], ["level", "cell"])
    once = (F.col("level") == F.greatest("l_level", "r_level")) & (F.col("cell") == F.greatest("l_cell", "r_cell"))
    return met.filter(once & (F.col("l_begin") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_begin"))).select("l", "r")


def _newest(begin: np.ndarray, end: np.ndarray, rank: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each [since, until] the largest rank (1 or more) among the intervals that share a point with it; 0 where none
    does. Such an interval holds `since` or begins after it: the former follow from painting intervals by rank, the latter
    from maxima over runs of 2^k begins."""
    points = np.unique(np.concatenate([begin, end]))
    painted = np.zeros(2 * len(points) + 1, np.int64)  # 2 i + 1: point i, even places: the gaps beside
    order = np.argsort(rank)
    for a, b, r in zip(2 * np.searchsorted(points, begin[order]) + 1, 2 * np.searchsorted(points, end[order]) + 2, rank[order], strict=True):
        painted[a:b] = r
    place = np.searchsorted(points, since)
    exact = points[np.minimum(place, len(points) - 1)] == since
    out = painted[2 * place + exact]
    order = np.argsort(begin)
    begins, runs = begin[order], [rank[order]]
    while 2 ** len(runs) <= len(begins):
        half = 2 ** (len(runs) - 1)
        runs.append(np.maximum(runs[-1][:-half], runs[-1][half:]))
    first, stop = np.searchsorted(begins, since, "right"), np.searchsorted(begins, until, "right")
    some = np.flatnonzero(stop > first)
    power = np.frexp((stop - first)[some].astype(float))[1] - 1
    for k in np.unique(power):
        at = some[power == k]
        out[at] = np.maximum(out[at], np.maximum(runs[k][first[at]], runs[k][stop[at] - 2**k]))
    return out


def _best_in_cell(rows: pa.Table) -> pa.Table:
    """The rows of the left with the best of the right in the same cell; ids are told apart by their rank in the cell."""
    files, found = rows.filter(pc.field("is_left")), rows.filter(pc.invert(rows["is_left"]))
    numbers = lambda t, c: t[c].to_numpy()
    best = np.zeros(len(files), np.int64)
    if len(files) and len(found):
        found = found.take(pc.sort_indices(found["id"]))
        rank, since, until = np.arange(1, len(found) + 1), numbers(files, "begin"), numbers(files, "end")
        begin, end = numbers(found, "begin"), numbers(found, "end")
        left, right = (t["members"].combine_chunks().dictionary_encode() for t in (files, found))
        having: dict = {}
        for i, text in enumerate(left.dictionary.to_pylist()):
            for member in json.loads(text):
                having.setdefault(member, []).append(i)
        which, codes = left.indices.to_numpy(), right.indices.to_numpy()
        by_group = np.argsort(codes, kind="stable")
        for text, at in zip(right.dictionary.to_pylist(), np.split(by_group, np.flatnonzero(np.diff(codes[by_group])) + 1), strict=True):
            shared = np.zeros(len(left.dictionary), np.int64)
            for member in json.loads(text):
                shared[having.get(member, [])] += 1
            newest = _newest(begin[at], end[at], rank[at], since, until)
            best = np.maximum(best, np.where(newest > 0, shared[which] * (len(found) + 1) + newest, 0))
    none, place = best == 0, best % (len(found) + 1) - 1
    ids = found["id"].take(pa.array(np.where(none, 0, place), mask=none))
    return pa.table([*[files[c] for c in files.column_names[7:]], ids, pa.array(best // (len(found) + 1), pa.int32(), mask=none)], names=[*files.column_names[7:], "id", "shared"])


def best_overlaps(left: DataFrame, right: DataFrame, keys: tuple[str, ...], id_col: str, members: str) -> DataFrame:
    """keys, id, shared: for each key of the left the row of the right that shares a point of time with one of the key's
    rows and has the most members (an array) in common, then the largest id; id null and shared 0 where there is none. Begin and
    end are those of overlapping().

    No pairs are formed: rows are shuffled once by cells, and in a cell the rows of the right with equal members are
    searched together, each search giving the newest of them for all rows of the left. Shuffles follow the rows; the work in a
    cell is its rows of the left times the different sets of members on its right. A task holds one cell at a time."""
    text = F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast(left.schema[members].dataType))))).alias("members")
    l, r = _placed(left.select(*keys, text, "begin_us", "end_us"), right.filter(F.col(id_col).isNotNull()).select(id_col, text, "begin_us", "end_us"), SEARCH_LEVEL)
    shape = right.schema[id_col].dataType
    no_id = F.lit(None).cast(shape)
    l = l.select(F.lit(True).alias("is_left"), "level", "cell", F.col("l_begin").alias("begin"), F.col("l_end").alias("end"), "l.members", no_id.alias("id"), *[F.col(f"l.{k}").alias(f"key_{k}") for k in keys])
    r = r.select(F.lit(False).alias("is_left"), "level", "cell", F.col("r_begin").alias("begin"), F.col("r_end").alias("end"), "r.members", F.col(f"r.{id_col}").alias("id"), *[F.lit(None).cast(left.schema[k].dataType).alias(f"key_{k}") for k in keys])
    out = ", ".join(f"key_{k} {left.schema[k].dataType.simpleString()}" for k in keys)
    met = l.union(r).groupBy("level", "cell").applyInArrow(lambda rows: _best_in_cell(rows), f"{out}, id {shape.simpleString()}, shared int")
    timeless = left.filter("begin_us IS NULL").select(*keys, no_id, F.lit(None).cast("int"))
    best = F.max(F.when(F.col("shared").isNotNull(), F.struct("shared", "id"))).alias("best")
    return met.union(timeless).groupBy(*[F.col(f"key_{k}").alias(k) for k in keys]).agg(best).select(*keys, F.col("best.id").alias("id"), F.coalesce("best.shared", F.lit(0)).alias("shared"))
