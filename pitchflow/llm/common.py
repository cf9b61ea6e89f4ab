"""Paths, table access and batch helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are worked through in slices of about so many bytes, so that a task's memory doesn't follow its batch size.
SLICE_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (driver and
    executor in one process, as in tests) gets one of its own; a cluster's executors would each write to their own disks,
    so there that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="pitchflow-"))
        base = _own[0]
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/pitchflow/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """df written as Parquet and read again: cuts the lineage, and survives lost executors."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a written table that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A key is heavy if more than this share of all rows have it, so there are fewer heavy keys than its inverse.
HEAVY = 1 / 1024


def joined_by(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows left-joined to table (a row a key; `count`: how many of the `total` rows have it). Rows of heavy keys never
    meet in one task: fewer than 1 / HEAVY rows of table are broadcast to them; the others are joined by a shuffle."""
    least = max(1.0, total * HEAVY)
    heavy, rest = table.filter(F.col(count) > least), table.filter(F.col(count) <= least)
    here = rows.join(F.broadcast(heavy), key)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest, key, "left")
    return here.unionByName(others)


#: Bits of the map by which rows are told that a set of keys can't concern: 2^(FLAG_BITS - 6) rows, whatever its keys.
FLAG_BITS = 24


def bits_for(keys: int, least: int = 20, most: int = 27) -> int:
    """Bits of a map that tells most rows apart from so many keys: 16 a key and at most 2^most, beyond which it lets more
    pass."""
    return min(most, max(least, (16 * max(1, keys) - 1).bit_length()))


def flagged(rows: DataFrame, keys: DataFrame, key: str, bits: int = FLAG_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not among keys, rows whose key may be). The latter are all that must be shuffled to be sure: a
    broadcast map of the keys' hashes, of 2^bits bits, tells most rows apart where they lie. Helper columns take names
    that rows lacks."""
    word, bit, held = (unused(rows, x) for x in ("word", "bit", "held"))
    at = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias(held))
    told = rows.withColumn(word, F.shiftright(at, 6)).withColumn(bit, at.bitwiseAND(F.lit(63)).cast("int")).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(held), F.col(bit)).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    names = [quoted(c) for c in rows.columns]
    return told.filter(~hit).select(names), told.filter(hit).select(names)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A column name that df lacks, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


#: Batches between Spark and Python hold at most so many bytes and rows: with long texts the default of 10,000 rows alone
#: takes up more of an executor than a task's own work.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def releasing(f):
    """f, a function of a task's batches, which in the end gives back to the system what its worker has freed: workers are
    used again, and what they hold on to would add up with what the next stage needs."""

    @functools.wraps(f)
    def run(batches: Iterator, *args, **options) -> Iterator:
        yield from f(batches, *args, **options)
        given_back()

    return run


def given_back() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def importable(spark: SparkSession) -> None:
    """Lets Python workers that start from now on find this package where the driver found it, and bounds the session's
    batches for them where they are not bounded more tightly."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    env.setdefault("MALLOC_ARENA_MAX", "2")  # each of a worker's threads would keep freed memory of its own
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else (lower() would change other letters)."""
    return F.translate(col, UPPER, LOWER)


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs whose sizes sum to about limit; a larger item is a run of its own."""
    start = total = stop = 0
    for stop, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, stop
            start, total = stop, 0
        total += n or 1
    if total:
        yield start, stop + 1


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the column's values; null is the empty value."""
    for batch in batches:
        col = batch.column(column)
        empty = b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else ""
        sizes = pc.binary_length(col).to_pylist() if batch.num_rows else []
        for a, b in slices((n or 0 for n in sizes), limit):
            part = batch.slice(a, b - a)
            yield part, [empty if x is None else x for x in part.column(column).to_pylist()]


class Memo:
    """A map of at most about twice `limit` entries: when the young half is full it becomes the old one, and what is
    asked for again moves back. Entries whose keys are longer than `longest` live for one slice."""

    def __init__(self, limit: int = 300_000, longest: int = 64):
        self.young: dict = {}
        self.old: dict = {}
        self.limit, self.longest, self._long = limit, longest, []

    def missing(self, keys: Iterable) -> list:
        """Begins a slice; the keys that are still to be computed (put them into young)."""
        for k in self._long:
            self.young.pop(k, None)
        self._long = []
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = set(keys)
        out.difference_update(young)
        if old:
            again = [k for k in out if k in old]
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            out.difference_update(again)
        self._long = [k for k in out if len(k) > self.longest]
        return list(out)
