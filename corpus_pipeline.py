"""A corpus pipeline over ``documents``: five operators of tessera.llm, one after another.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents
that stay with all their columns, the last one with token columns besides. Between stages the
documents are written as Parquet in the shared checkpoint folder and read again, so a stage
never computes its predecessors anew and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, exact_dedup, quality, simhash
from tessera.llm.queries import tokenizer_json
from tessera.runtime import ensure_checkpoint_dir, fresh


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1.

    It learns from the labels of ``labels`` that are not held out. Null and empty texts have
    the score of the labels' share of 1; without any label nothing is rejected.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.labels):
        return docs
    score = fresh("__score", docs)
    return quality.add_score(docs, model, "text", score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text (null: empty): the one with the largest doc_id."""
    return exact_dedup.drop_exact(docs, "doc_id", "text", keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints: the one with the smallest doc_id."""
    return simhash.drop_near(docs, "doc_id", "text", words=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and, after decoding, whether the text came back."""
    ids, decoded = fresh("ids", docs), fresh("__decoded", docs)
    coded = bpe.encode(docs, tokenizer_json(), "text", ids, decoded)
    n, same = fresh("n_tokens", docs), fresh("round_trip", docs)
    return coded.withColumns({n: F.size(ids).cast("long"), same: F.col(decoded) == F.coalesce("text", F.lit(""))}).drop(decoded)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", add_tokens),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the documents before the last stage are needed no more
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return STAGES[-1][1](spark, docs, sf_dir)
