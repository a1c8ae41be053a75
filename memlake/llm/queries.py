"""The queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import (
    byte_bpe,
    decontaminate,
    filter_audit,
    jaccard_join,
    language_id,
    lexical_index,
    quality_rules,
    quality_trees,
    ring_sharding,
    secret_scan,
    token_rollup,
    toxicity,
    url_filter,
)
from memlake.llm.oracles import ORACLE_SQL
from memlake.plans.scratch import cut, join_hot, scratch_root

__all__ = ["ORACLE_SQL", "QUERIES"]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train_filter(docs, _fold(4) != 2)
    return language_id.predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op2_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), url_filter.entries())


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = toxicity.train_toxicity(docs, _read(spark, sf_dir, "labels"), _fold(5) != 0)
    return toxicity.score_toxicity(docs, weights).select(
        "doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_read(spark, sf_dir, "documents"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of encoded and decoded texts."""
    return byte_bpe.bpe_round_trip(docs, RANKS).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_read(spark, sf_dir, "documents"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents, one of them sent twice, in a fresh ledger.

    ``load`` inserts every document under the blank-separated counter; ``dedupe`` deletes all but the
    smallest doc_id of texts with equal words; ``tokenizer`` inserts what is left under the BPE
    counter and revises the first counter to words plus one end mark; ``dedupe`` then comes again.
    """
    counted = cut(token_rollup.count_tokens(_read(spark, sf_dir, "documents"), RANKS), "token-counts")
    copied = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = join_hot(counted, cut(copied, "token-keepers"), ["h1", "h2"], "left")
    marked = cut(met.withColumn("copy", F.col("doc_id") > F.col("keep")), "token-copies")

    def events(rows: DataFrame, op: str, tokenizer: str, count: str, old: str = "0") -> DataFrame:
        return rows.selectExpr(
            f"'{op}' as op", "source", "lang", f"'{tokenizer}' as tokenizer", f"{count} as n_tokens", f"{old} as old_tokens"
        )

    left, gone = marked.where("not coalesce(copy, false)"), marked.where("copy")
    batches = {
        "load": events(marked, "insert", "words", "words"),
        "dedupe": events(gone, "delete", "words", "words"),
        "tokenizer": events(left, "insert", "byte_bpe_50k", "bpe").union(events(left, "revise", "words", "words + 1", "words")),
    }
    ledger = token_rollup.Ledger(spark, f"{scratch_root(spark)}/ledger-{uuid.uuid4().hex[:12]}")
    for name in ("load", "dedupe", "tokenizer", "dedupe"):
        ledger.commit(name, batches[name])
    return ledger.totals()


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    forest = quality_trees.train_quality(docs, _read(spark, sf_dir, "labels"), _fold(5) != 0)
    return quality_trees.score_quality(docs, forest).select(
        "doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_bitmask, op2_url_digests, op3_jaccard_join, op4_toxicity_ftrl, op5_ring_shards, op6_secret_scan,
        op7_line_frequency, op8_latent_decontamination, op9_byte_bpe, op10_token_rollup,
        op11_filter_audit, op12_quality_trees, op13_lexical_search, pipeline,
    )
}
