"""The corpus pipeline: five stages over ``documents``, each an operator of ``skyloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
hands what it reads back to the next stage; a stage's table goes when the next one is written. All but the last return the
columns of ``documents``.

1. toxicity: documents with a score of 0.5 or more go.
2. near-dedup: one document of each class of copies and near copies stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: documents are repeated or left out so that sources stand near their target weights, and stand in the order of the mix.
5. token store: the mixed documents become token ids in a content-addressed store, read back and verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import leaks, mixing, neardup, store, toxicity
from skyloom.llm.common import released, remove, work_path, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled rows of ``docs`` outside the held-out fold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document, read back from the store."""
    import public_tokenizers

    root = work_path(spark, "store", kept=True)
    store.write_store(docs, root, public_tokenizers.path("byte_bpe_50k.json"))
    return store.read_documents(spark, root)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_store", store_tokens),
]

#: Learned scores, sketches and byte-pair ids are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_path(spark, name)
        with released(spark):  # what a stage wrote for itself goes when its rows are written
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path.rsplit("/", 1)[0]
    return docs
