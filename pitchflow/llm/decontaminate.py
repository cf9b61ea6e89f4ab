"""Operator 7: benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, stored

#: What parts words, before A-Z are lower-cased: ASCII but for letters and digits.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A benchmark of at most so many windows is broadcast (about 150 bytes each); a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def words(text):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def item_windows(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """win (its words with a space between), size, toks, items (sorted ids as text) of the benchmark's distinct windows:
    `width` consecutive words of an item, or all words of a shorter one."""
    b = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(ascii_lower(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    b = b.withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)))
    b = b.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("toks"))
    return b.withColumn("win", F.array_join("toks", " ")).groupBy("win").agg(F.first("size").alias("size"), F.first("toks").alias("toks"), F.array_sort(F.collect_set("item")).alias("items"))


def occurrences(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """doc_id, h, at (0-based word), size, win of every window occurrence in docs (doc_id, h, w).

    A window's words are ordered by rarity over all documents. Containment must be whole, so its necessary prefix is its
    rarest word: only document words that are some window's rarest are joined. The word's place in the window bounds
    where the window can lie; what is left is verified word for word."""
    near = F.broadcast if small else (lambda df: df)
    # lower() maps more letters than A-Z to one: it finds all equal words and maybe others, which verifying leaves out
    vocabulary = windows.select(F.explode("toks").alias("tok")).select(F.lower("tok").alias("key")).distinct()
    seen = docs.select(F.explode("w").alias("tok")).select(F.lower("tok").alias("key")).join(near(vocabulary), "key").groupBy("key").agg(F.count("*").alias("n"))
    seen = stored(seen, fresh(docs.sparkSession, "rarity"))
    placed = windows.select("win", "size", F.posexplode("toks").alias("off", "tok")).withColumn("key", F.lower("tok"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off"))
    prefix = placed.join(near(seen) if small else seen, "key", "left").groupBy("win", "size").agg(rarest.alias("r"))
    prefix = prefix.filter("r.n > 0").select("win", "size", F.col("r.key").alias("key"), F.col("r.off").alias("off"))
    if small:
        found = docs.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "tok")).withColumn("key", F.lower("tok")).drop("tok").join(F.broadcast(prefix), "key")
        found = found.withColumn("at", F.col("pos") - F.col("off"))
    else:  # what is shuffled is a place, not the document around it; documents with any are brought back by their hash
        placed = docs.select("h", F.posexplode("w").alias("pos", "tok")).select("h", "pos", F.lower("tok").alias("key")).join(prefix, "key")
        found = placed.select("h", (F.col("pos") - F.col("off")).alias("at"), "size", "win").filter("at >= 0").distinct().join(docs, "h")
    found = found.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.size("w")))
    return found.filter(ascii_lower(F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ")) == F.col("win")).select("doc_id", "h", "at", "size", "win")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of docs.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A word inside any occurrence of a
    benchmark window is hit; contaminated: some word is, and share * n_hit >= n_words. The explode of all words is never
    shuffled while the benchmark is small enough to broadcast (its windows are counted first); beyond that the same join
    runs by a shuffle. Matches meet by document, of which there are at most its words times the windows' sizes.

    Null or empty text has no words and is clean. Items without words have no windows; a null item id counts as "".
    Rows with equal or null ids each keep a row (matches are kept by id and a hash of the row). An empty table gives an
    empty result, an empty benchmark only clean rows. Other columns are not read."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), words(F.col(text_col)).alias("w"))
    windows = stored(item_windows(benchmark, width, item_col, item_text_col), fresh(spark, "windows"))
    n_windows, n_items = windows.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    small, few_items = n_windows <= BROADCAST_WINDOWS, n_items <= BROADCAST_WINDOWS
    occ = stored(occurrences(d, windows, small), fresh(spark, "occurrences"))
    spans = occ.groupBy("doc_id", "h", "at").agg(F.max("size").alias("size")).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("spans"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(s.at, a.end))).alias("n"), F.greatest(a.end, s.end).alias("end")), lambda a: a.n)
    spans = spans.select("doc_id", "h", n_hit.cast("long").alias("n_hit"))
    win_items = windows.select("win", F.explode("items").alias("item"))
    items = occ.select("doc_id", "h", "win").distinct().join(F.broadcast(win_items) if few_items else win_items, "win").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.join(items, (spans.doc_id.eqNullSafe(items.doc_id)) & (spans.h == items.h)).select(spans.doc_id.alias("hit_id"), spans.h.alias("hit_h"), "n_hit", "items")
    sized = d.select("doc_id", "h", F.size("w").cast("long").alias("n_words"))
    out = sized.join(hits, sized.doc_id.eqNullSafe(F.col("hit_id")) & (sized.h == F.col("hit_h")), "left")
    n = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n > 0) & (n * share >= F.col("n_words"))).alias("contaminated"),
    )


def oracle(width: int = 13, share: int = 20) -> str:
    split = "coalesce(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), [])"
    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {width}) AS size, array_to_string(w[i + 1 : i + least(len(w), {width})], ' ') AS win
       FROM b, LATERAL (SELECT unnest(range(0, len(w) - least(len(w), {width}) + 1)) AS i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, {split.format("text")} AS w FROM documents),
dw AS (SELECT rid, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win FROM d, (SELECT DISTINCT size FROM bw) z,
       LATERAL (SELECT unnest(range(0, greatest(len(w) - size + 1, 0))) AS i)),
o AS (SELECT rid, i, dw.size, item FROM dw JOIN bw USING (win)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, size FROM o) x, LATERAL (SELECT unnest(range(i, i + size)) AS p) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM o) x GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * {share} >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""
