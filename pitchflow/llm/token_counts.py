"""Operator 2: token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import encoder, tokenizer_version
from .common import bits_for, dropped, flagged, fresh, joined_by, stored, text_slices

CACHE_SCHEMA = "digest binary, n_tokens bigint"


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, "counts")
    for part, texts in text_slices(batches, "text"):
        cut, size = enc.fill(texts)
        n = [sum(map(size.__getitem__, c)) for c in cut]
        yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])


def content_digest(text, tokenizer: str):
    """SHA-256 of the normalised content: for tokenizers that drop white space, runs of ASCII white space count as one
    space and none at the ends, which never changes their tokens; for any other tokenizer the text as it is."""
    if encoder(tokenizer, "counts").mode == "word":
        text = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    return F.unhex(F.sha2(text, 256))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The counts table at `cache` (a fresh one if None) holds one count per content digest in a folder per tokenizer
    version. Digests of docs that it lacks are found by an anti-join; one row of each is encoded, and the new counts are
    appended; then docs take their counts by digest. Digests are counted first, combined before the shuffle. Texts of
    digests that one row has are encoded where they lie; of those that several rows have (told by a broadcast map of their
    hashes), each task brings one row a digest to a shuffle that leaves one in all, however many copies
    there are, with equal ids or not.

    Null text is empty (0 bytes, 0 tokens). Rows with equal or null ids each keep a row. An empty table gives an empty
    result. Other columns of docs are not read. A task that is run again may append a digest twice: reads take one."""
    spark = docs.sparkSession
    path = f"{cache or fresh(spark, 'token-counts')}/version={tokenizer_version(tokenizer)}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", content_digest(F.col("text"), tokenizer))
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(path).select("digest").distinct() if cache else None
    except Exception as e:  # no counts of this version yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    paths = [fresh(spark, "digests"), fresh(spark, "counted")]
    texts = stored(keyed.groupBy("digest").agg(F.count("*").alias("n")), paths[0])
    left = texts if known is None else texts.join(known, "digest", "left_anti")
    pairs = keyed.select("digest", "text")
    if known is not None:  # rows of known digests stay behind as far as the map tells them
        pairs = flagged(pairs, left.select("digest"), "digest", bits_for(left.count()))[1]
    repeats = left.filter("n > 1").select("digest")
    single, several = flagged(pairs, repeats, "digest", bits_for(repeats.count()))
    # what the map lets through wrongly, of a known digest or of one row only, is grouped too and costs no more than that
    heads = several.groupBy("digest").agg(F.max("text").alias("text"))
    misses = single.union(heads)
    if known is not None:
        misses = misses.join(left.select("digest"), "digest", "left_semi")
    misses.mapInArrow(partial(_counts, path=tokenizer), CACHE_SCHEMA).write.mode("append").parquet(path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = joined_by(rows, texts.select("digest", "n").join(counts, "digest"), "digest", "n", total)
    counted = stored(counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), paths[1])
    for p in (paths[0], *([] if cache else [path])):
        dropped(spark, p)
    return counted
