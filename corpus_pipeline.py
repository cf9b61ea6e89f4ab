"""A corpus pipeline: each stage works on all documents that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import dropped, flagged, fresh, importable, quoted, stored, table, unused
from pitchflow.llm.decontaminate import contamination
from pitchflow.llm.jaccard_join import link_classes
from pitchflow.llm.quality_fm import good_documents
from pitchflow.llm.queries import _word_tokenizer
from pitchflow.llm.secrets_scan import redact
from pitchflow.llm.trie_bpe import encode_digests


#: What link_classes finds no words in: such texts link to nothing.
BLANK = "\\A[\\x20\\x09-\\x0D]*\\z"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name, which docs lacks: id and text, by which rows are judged, as ids may repeat
    or be null. In order of ids, null ones last."""
    key = unused(docs, "key")
    return docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row stays: that of the smallest id, among equal ids of the smallest hash of
    the text. Texts without words are in no class and stay. Texts of rows that are neither linked nor repeated are not
    shuffled."""
    importable(spark)
    blank = F.coalesce("text", F.lit("")).rlike(BLANK)
    columns = [quoted(c) for c in docs.columns]
    keyed, key = _keyed(docs.filter(~blank))
    classes = link_classes(keyed, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    followers = classes.filter(F.col(key) != F.col("component_id")).select(key)
    repeated = classes.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    clear, maybe = flagged(keyed, followers.union(repeated), key)
    heads = maybe.dropDuplicates([key]).join(followers.distinct(), key, "left_anti")
    return clear.select(columns).union(heads.select(columns)).union(docs.filter(blank))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    columns = [quoted(c) for c in docs.columns]
    keyed, key = _keyed(docs)
    found = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=key).filter("contaminated").select(F.col("doc_id").alias(key))
    found = stored(found.distinct(), fresh(spark, "contaminated"))
    clear, maybe = flagged(keyed, found, key)
    return clear.select(columns).union(maybe.join(found, key, "left_anti").select(columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    importable(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents' ids and of their decoded texts."""
    importable(spark)
    return encode_digests(docs, _word_tokenizer(), forget=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("BPE encoding and decoding", encode),
]

#: The classifier's scores and the tokenizer's ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is removed once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh(spark, f"stage{k}")
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            dropped(spark, before)
        before = path
    return docs
