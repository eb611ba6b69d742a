"""The corpus pipeline: five stages over ``documents``, each stored and read again by the next.

Every stage works on all rows that the one before kept. The first four return
the columns of ``documents``, further ones and their names included; the last
returns where each token piece was packed. Null and empty texts score 0 and
leave with the first stage; very long ones are whole in every stage. Rows with
a null id can't be told apart: they stay but for the quality stage. Repeated
rows, and ties among near duplicates of equal ids, stay or leave together. An
empty table passes through.

Texts reach Python in Arrow batches of ``BATCH`` bytes, where the session has no
size of its own: at Spark's 64 MB each task holds several batches of that size
in the JVM and in Python.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, ngram_join, packing, quality_knn, secrets
from millrace.llm.tables import documents, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def batched(stage: Stage) -> Stage:
    """The stage in a session with batches of ``BATCH`` bytes, if it has set no other; the setting stays, as what the stage returns runs later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _BATCH not in spark.conf.getAll:
            spark.conf.set(_BATCH, BATCH)
        return stage(spark, docs, sf_dir)

    return run


@batched
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.7 or more)."""
    labels = quality_knn.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_knn.keep_good(docs, quality_knn.fit(docs, labels))


@batched
def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id."""
    return ngram_join.keep_one(docs)


@batched
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@batched
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced and n_chars counted again where one was."""
    before = "_text"
    while before in docs.columns:
        before += "_"
    out = secrets.redact(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


@batched
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each token piece with its sequence and offset."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", remove_benchmark),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: None of the stages but the scans' patterns can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
