"""Operator 13: how filters of documents interact, with repeats told by counting Bloom sketches and exact full-text groups."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, bits_for, dropped, flagged, fresh, joined_by, stored

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Counters of a sketch for each text, and positions of a text in it.
COUNTERS, POSITIONS = 16, 2
#: A sketch of at most so many words (32 counters each) is broadcast; a larger one meets hashes by a shuffle.
BROADCAST_WORDS = 1 << 20


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.length(F.regexp_replace(text, f"[^{UPPER[0]}-{UPPER[-1]}]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def _places(bits: int) -> list[Column]:
    return [F.xxhash64("h", F.lit(k)).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(POSITIONS)]


def counting_bloom(hashes: DataFrame, bits: int) -> DataFrame:
    """word, counts: the merged sketch of all rows' hashes h. Each row adds one at each of its places; tasks count what
    they meet and the counts are added up. A counter holds 0, 1 or 2 for more, in two bits, 32 to a word; words that are
    missing hold nothing."""
    places = hashes.select(F.explode(F.array(*_places(bits))).alias("place")).groupBy("place").agg(F.least(F.count("*"), F.lit(2)).alias("c"))
    return places.groupBy(F.shiftright("place", 5).alias("word")).agg(F.expr("bit_or(shiftleft(c, cast(2 * (place & 31) as int)))").alias("counts"))


def possible_repeats(hashes: DataFrame, total: int) -> DataFrame:
    """The distinct hashes h none of whose counters is 1. Any other hash is of one row only, so its text is unique."""
    bits = max(16, math.ceil(math.log2(max(1, COUNTERS * total))))
    sketch = counting_bloom(hashes, bits)
    small = 1 << (bits - 5) <= BROADCAST_WORDS
    left = hashes.select("h") if small else hashes.select("h").distinct()
    for k, place in enumerate(_places(bits)):
        words = sketch.select(F.col("word").alias(f"word{k}"), "counts")
        met = left.withColumn("place", place).withColumn(f"word{k}", F.shiftright("place", 5)).join(F.broadcast(words) if small else words, f"word{k}")
        left = met.filter(F.expr("shiftright(counts, cast(2 * (place & 31) as int)) & 3") > 1).select("h")
    return left.distinct()


def repeated(facts: DataFrame, texts: DataFrame, total: int) -> tuple[DataFrame, list[str]]:
    """(facts with a column `again`: a row of a smaller id has the same text, the paths written).

    facts: id, digest, h and other columns; texts: id, text, h of the same rows. Texts that the sketch clears stay where
    they are; the others are grouped by their whole text, whose rows each task combines before the shuffle. A text's
    SHA-256 carries the smallest id back to its rows; rows of very frequent texts get it by a broadcast."""
    spark = facts.sparkSession
    paths = [fresh(spark, "possible"), fresh(spark, "least")]
    maybe = stored(possible_repeats(facts.select("h"), total), paths[0])
    bits = bits_for(maybe.count())
    _, passed = flagged(texts, maybe, "h", bits)
    same = passed.groupBy("text").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    same = stored(same.select(F.unhex(F.sha2("text", 256)).alias("digest"), "least", "n"), paths[1])
    clear, left = flagged(facts, maybe, "h", bits)
    told = joined_by(left, same, "digest", "n", total).withColumn("again", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    return clear.withColumn("again", F.lit(False)).unionByName(told.select(*facts.columns, "again")), paths


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the counts of each step of each order of the filters, from additive counts.

    counts: part, mask (bit k: the document fails filter k), n, good, toxic, any number of rows a part. What passes a set
    S of filters is the sum over masks that have no bit of S, so that 2^filters sums a part give every order's steps."""
    m = len(letters)
    full = 1 << m
    passing = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c)).otherwise(0)) for s in range(full)]).alias(c)
    only = F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(m)]).alias("only")
    parts = counts.groupBy("part").agg(passing("n"), passing("good"), passing("toxic"), only)
    weights = {s: math.factorial(bin(s).count("1")) * math.factorial(m - 1 - bin(s).count("1")) for s in range(full - 1)}
    # orders in which exactly the filters of s come before filter k
    shapley = [sum((weights[s] * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << k))) for s in range(full) if not s & 1 << k), F.lit(0)) for k in range(m)]
    parts = parts.withColumn("shapley", F.array(*shapley))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(m)])))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(letters)), F.lit(0))
    which = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    rows = rows.withColumn("before", before).withColumn("k", which).withColumn("after", F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("k"))))
    removed = lambda c: F.get(c, "before") - F.get(c, "after")
    failing = F.get("n", F.lit(0)) - F.get("n", F.call_function("shiftleft", F.lit(1), F.col("k")))
    out = {"kept": F.get("n", "after"), "removed": removed("n"), "redundant": failing - removed("n"), "unique_fails": F.get("only", "k"), "good_lost": removed("good"), "toxic_lost": removed("toxic"), "shapley": F.get("shapley", "k")}
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[c.cast("long").alias(name) for name, c in out.items()])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each value of
    part_col, each order of the filters A to E and each step of it.

    Two scans read texts: one for flags and digests of all rows (a narrow table), one for the texts of possible repeats.
    From then on only ids, digests and masks move, added up before they do.

    Null texts are empty, null parts "". Rows with equal ids each count; E compares ids, so neither rows of equal ids nor
    of a null id repeat one another by it, while a null id is never smaller. A label of an id is set if any of its rows
    says 1; ids without labels are neither good nor toxic. An empty table gives an empty result; other columns are not
    read."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    flags = text_filters(F.col("text"))
    letters = "".join(flags) + "E"
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(flags.values())), F.lit(0))
    path = fresh(spark, "flags")
    facts = stored(narrow.select("id", "part", mask.alias("mask"), digest.alias("digest")).withColumn("h", F.xxhash64("digest")), path)
    total = facts.count()
    told, paths = repeated(facts, narrow.select("id", "text", F.xxhash64(digest).alias("h")), total)
    told = told.withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("again"), 1 << len(flags)).otherwise(0)))
    each = told.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(says("quality"), says("toxic"))
    weighed = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    counts = each.join(known, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), weighed("quality").alias("good"), weighed("toxic").alias("toxic"))
    done = fresh(spark, "mask-counts")
    counts = stored(counts, done)
    for p in (path, *paths):
        dropped(spark, p)
    return interactions(counts, letters)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, good, toxic FROM f),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
      WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
z AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS f,
             list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE mask & (coalesce(before, 0) | f) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & f <> 0), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE mask & coalesce(before, 0) <> 0 AND mask & f <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = f), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & f <> 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & f <> 0), 0) AS toxic_lost
      FROM n, z GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
