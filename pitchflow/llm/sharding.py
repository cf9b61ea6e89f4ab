"""Operator 4: sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Bits of the hash, the leading ones of an MD5 digest, as many as a long holds in whole hexadecimal digits.
BITS = 60


def hash_bits(key, text):
    """BITS leading bits of md5(key as text, a unit separator, text); null counts as empty."""
    joined = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 10).cast("long")


def directory(sized: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (h, n_bytes): which leaf each `high`-bit prefix lies in, where depths low to high are tried, and the
    prefixes that exceed the limit even at `high` bits.

    A leaf is a prefix whose bytes fit under a parent whose bytes don't (or at depth low). A parent has two children at
    most, so no join has a hot key; sums by prefix are combined before they are shuffled. Each leaf is spread over the
    `high`-bit prefixes below it."""
    fine = sized.groupBy(F.shiftright("h", BITS - high).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    deep = fine.select("n_bytes", "n", "fine", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    sums = deep.groupBy("depth", F.expr(f"shiftright(fine, {high} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    above = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("shard_bytes").alias("parent_bytes"))
    j = sums.withColumn("parent", F.shiftright("prefix", 1)).join(above, ["depth", "parent"], "left")
    leaves = j.filter((F.col("shard_bytes") <= limit) & (F.col("parent_bytes").isNull() | (F.col("parent_bytes") > limit)))
    below = F.expr(f"sequence(shiftleft(prefix, {high} - depth), shiftleft(prefix + 1, {high} - depth) - 1)")
    return leaves.select(F.explode(below).alias("fine"), "depth", "prefix", "shard_bytes", "shard_docs"), fine.filter(F.col("n_bytes") > limit)


def shard_documents(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", headroom_bits: int = 6) -> DataFrame:
    """doc_id, n_bytes, depth, shard, shard_bytes, shard_docs per row of docs.

    The directory starts at zero bits; a bucket splits on its next hash bit only while it holds more than max_bytes, so
    every shard is the shortest hash prefix that fits (shard: its bits as text, "" for the only shard). The hash covers
    id and text: an id that a third of all rows share is split like any other. Sizes are first added up by a prefix a
    few bits longer than an even split would need; the splitting then runs over those sums, whose number follows that of
    the shards. Prefixes that are still too large take more bits in another round of the same.

    Rows equal in id and text can't be told apart by any bit, nor can one document be cut: such a bucket that exceeds
    the limit ends at the full depth and is as large as it must be. Null text has 0 bytes; null ids hash as empty; an
    empty table gives an empty result; other columns of docs are not read."""
    spark = docs.sparkSession
    text = F.col(text_col)
    path = fresh(spark, "sizes")
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(id_col), text).alias("h")), path)
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    high = min(BITS, max(0, math.ceil(math.log2(max(1, total / max_bytes)))) + headroom_bits)
    low, rest, parts = 0, sized, []
    while True:
        leaves, over = directory(rest, low, high, max_bytes)
        keyed = rest.withColumn("fine", F.shiftright("h", BITS - high))
        parts.append(keyed.join(leaves, "fine"))
        if not over.limit(1).count():
            break
        rest = keyed.join(over.select("fine"), "fine", "left_semi").drop("fine")
        if high == BITS:
            same = over.select("fine", F.lit(BITS).alias("depth"), F.col("fine").alias("prefix"), F.col("n_bytes").alias("shard_bytes"), F.col("n").alias("shard_docs"))
            parts.append(keyed.join(same, "fine"))
            break
        rest = stored(rest, fresh(spark, "oversized"))
        low, high = high + 1, min(BITS, high + 12)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    shard = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END")
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), shard.alias("shard"), "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as Parquet, a folder per shard. Rows meet by their shard, which fits the byte limit."""
    shards = shard_documents(docs, max_bytes, id_col, text_col)
    leaf = shards.groupBy("shard", "depth").agg(F.count("*")).select("shard", "depth")
    depths = sorted(r[0] for r in leaf.select("depth").distinct().collect())  # at most BITS + 1 numbers
    bits = F.lpad(F.bin(hash_bits(F.col(id_col), F.col(text_col))), BITS, "0")
    keyed = docs.withColumn("_prefix", F.explode(F.array(*[F.substring(bits, 1, d) for d in depths])))
    keyed.join(leaf, F.col("_prefix") == F.col("shard")).drop("_prefix", "depth").repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(max_bytes: int) -> str:
    return f"""
WITH s AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
l AS (SELECT d, h >> CAST({BITS} - d AS INT) AS p, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS c FROM s, range(0, {BITS + 1}) t(d) GROUP BY ALL),
f AS (SELECT * FROM l WHERE b <= {max_bytes} OR d = {BITS}),
m AS (SELECT h, min(d) AS d FROM (SELECT DISTINCT h FROM s) x, f WHERE f.p = x.h >> CAST({BITS} - f.d AS INT) GROUP BY h)
SELECT s.doc_id, CAST(s.n_bytes AS BIGINT) AS n_bytes, CAST(m.d AS INT) AS depth,
       CASE WHEN m.d = 0 THEN '' ELSE lpad(bin(f.p), CAST(m.d AS INT), '0') END AS shard, f.b AS shard_bytes, f.c AS shard_docs
FROM s JOIN m USING (h) JOIN f ON f.d = m.d AND f.p = s.h >> CAST({BITS} - m.d AS INT)"""

