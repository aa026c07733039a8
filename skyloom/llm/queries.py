"""Registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, credentials, infill, leaks, licenses, mixing, neardup, oracles, store, tokens, topk, toxicity, variants, wordpieces
from .common import arrow_map, documents, work_path


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(chat.as_replies(turns.unionByName(extra))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # here, so that the other queries do without the vocabularies

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = work_path(spark, "store")
    store.write_store(documents(spark, sf_dir), root, public_tokenizers.path("byte_bpe_50k.json"))
    return store.read_documents(spark, root)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.secret_spans(documents(spark, sf_dir))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[(s["start"], s["kind"], s["end"]) for s in row] for row in batch.column("found").to_pylist()]
            count = {f"n_{k}": pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for k in credentials.KINDS[:3]}
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | count | {"base_sha256": [credentials.digest(r) for r in rows], "spans": [credentials.joined(r) for r in rows]})

        return step

    return arrow_map(found, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    return wordpieces.digests(wordpieces.decode(wordpieces.encode(documents(spark, sf_dir), file), file))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(documents(spark, sf_dir)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_licenses, op2_chat, op3_token_counts, op4_topk, op5_near_dup, op6_token_store, op7_secrets, op8_leaks, op9_toxicity, op10_mix, op11_word_bpe, op12_variants, op13_infill, pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
