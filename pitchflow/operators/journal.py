"""State rebuilt from a journal of mutations, as a whole or from a snapshot and the mutations after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPERATIONS = ("set", "update", "increment", "delete", "append")


def committed(journal: DataFrame) -> DataFrame:
    """The rows of mutations that were committed: of those with one event_id the first by seq. A null event_id is no
    repeat of another."""
    first = F.min("seq").over(W.partitionBy("event_id"))
    known = journal.filter("event_id IS NOT NULL").withColumn("_first", first).filter("seq = _first").drop("_first")
    return known.unionByName(journal.filter("event_id IS NULL"))


def _is(*ops: str) -> Column:
    return F.col("op").isin(*ops)


def replayed(rows: DataFrame) -> DataFrame:
    """target, key, sub, value, error: what committed rows leave, in order of (at, seq).

    Rows are the leaves of change sets: target, seq (a mutation's number), at, op, key, sub (the key inside a map; null for a
    plain value), value. set replaces the key's value, be it a map; update replaces it too unless the key holds a map and
    the change is one, then it replaces the map's keys that it names; increment adds to a plain value, 0 without one;
    delete drops the key. An increment that meets a map can't be replayed: the key has an error then and no value.

    A set, a delete and an update by a plain value begin a key's era; only the last one counts, and in it the last row of
    each sub, or the plain value and the increments after it. All windows share the partitioning by target and key."""
    plain = F.col("sub").isNull()
    # the rows of one set are one beginning: only its first row counts up
    first = F.row_number().over(W.partitionBy("target", "key", "at", "seq").orderBy(F.col("sub").asc_nulls_first()))
    r = rows.filter(_is("set", "update", "increment", "delete")).withColumn("_nth", first)
    ordered = W.partitionBy("target", "key").orderBy("at", "seq", "_nth")
    upto = ordered.rowsBetween(W.unboundedPreceding, 0)
    begins = (_is("set", "delete") | (_is("update") & plain)) & (F.col("_nth") == 1)
    r = r.withColumn("_era", F.sum(begins.cast("int")).over(upto))
    whole = W.partitionBy("target", "key")
    r = r.withColumn("_last", F.max("_era").over(whole)).filter("_era = _last")
    # a map in the era ends a plain value before it, and an increment after it fails
    mapped = F.col("sub").isNotNull() & _is("set", "update")
    r = r.withColumn("_mapped", F.max(mapped.cast("int")).over(upto))
    parts = r.groupBy("target", "key").agg(
        F.max("_mapped").alias("is_map"), F.bool_or(_is("increment") & (F.col("_mapped") == 1)).alias("_bad"),
        F.max(F.when(_is("set", "update") & plain, F.struct("at", "seq", "value")))["value"].alias("_base"), F.sum(F.when(_is("increment"), F.col("value"))).alias("_more"), F.count_if(_is("set", "update") & plain | _is("increment")).alias("_n"),
    )
    error = F.when(F.col("_bad"), F.lit("an increment meets a map"))
    value = F.when(F.col("_more").isNull(), F.col("_base")).otherwise(F.coalesce("_base", F.lit(0.0)) + F.col("_more"))
    single = parts.filter("is_map = 0 AND _n > 0 OR _bad").select("target", "key", F.lit(None).cast("string").alias("sub"), F.when(~F.col("_bad"), value).alias("value"), error.alias("error"))
    leaves = r.filter(mapped).groupBy("target", "key", "sub").agg(F.max(F.struct("at", "seq", "value"))["value"].alias("value"))
    fine = parts.filter("NOT _bad").select("target", "key")
    maps = leaves.join(fine, leaves["target"].eqNullSafe(fine["target"]) & leaves["key"].eqNullSafe(fine["key"]), "left_semi").withColumn("error", F.lit(None).cast("string"))
    return single.unionByName(maps)


def rebuild_targets(journal: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """State of all targets after their journals: rows as in replayed(). snapshot: such rows of before, without errors,
    which come first, as if set by a mutation before any other; the journal then needs what was committed after it only."""
    rows = committed(journal)
    if snapshot is not None:
        before = snapshot.filter("error IS NULL").select("target", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast(journal.schema["at"].dataType).alias("at"), F.lit("set").alias("op"), "key", "sub", "value")
        rows = rows.select("target", "seq", "at", "op", "key", "sub", "value").unionByName(before)  # nulls come first in order
    return replayed(rows)


def rebuild_lists(journal: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """target, index (from 0), value: the lists that append makes, item by item, in order of (at, seq, pos). Items stay rows:
    a long list is never one value. snapshot: such rows of before."""
    items = committed(journal).filter(_is("append")).select("target", F.lit(1).alias("_later"), "at", "seq", "pos", "value")
    if snapshot is not None:
        old = snapshot.select("target", F.lit(0).alias("_later"), F.lit(None).cast(journal.schema["at"].dataType).alias("at"), F.lit(None).cast("bigint").alias("seq"), F.col("index").alias("pos"), "value")
        items = items.unionByName(old)
    w = W.partitionBy("target").orderBy("_later", "at", "seq", "pos")
    return items.select("target", (F.row_number().over(w) - 1).cast("long").alias("index"), "value")
