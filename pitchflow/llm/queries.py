"""The registered queries of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

SHARD_BYTES = 1 << 20


def _word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op2_digest_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _word_tokenizer())


def op3_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gru_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .id_store import read_digests, write_store

    path = fresh(spark, "id-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_digests(spark, path)


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie_bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), _word_tokenizer())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_scan import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_classes

    return link_classes(table(spark, sf_dir, "documents"))


def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .adaptive_scan import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import looped, periodic_runs, run_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return run_digests(periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, filter_audit, jaccard_join, sharding, topk

    return {"op1_maxscore_topk": topk.ORACLE, "op4_extendible_shards": sharding.oracle(SHARD_BYTES), "op7_decontamination": decontaminate.oracle(), "op10_jaccard_classes": jaccard_join.oracle(), "op13_filter_audit": filter_audit.ORACLE}
