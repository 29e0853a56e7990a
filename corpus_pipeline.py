"""Documents to training shards: stages that each work on all that the one before has kept.

``run`` applies the stages to ``documents`` in order. Each stage's rows are written as Parquet to the
shared folder of ``spark.checkpoint.dir`` and read again, so that a lost executor costs one stage's tasks at most.

Null, empty and letterless texts go in the first stage. Repeated rows fall to one in the second. Extra columns of any name pass
through the first four stages; the last gives its own columns. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimt.llm import decontaminate, language_id, mixing, near_copies, sharding
from glimt.llm.common import quoted, shared_folder, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected (null, without letters, or unlike all languages learned)."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one of the smallest id.

    Near-copies share a similarity of 0.8 or more of five-word shingles. The anchors of the SimHash operator propose pairs, which the sets
    confirm. No radius over fingerprints that anchors can cover holds all near-copies (see README), so the sets are then joined for the rest.
    """
    return near_copies.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that consist of them for the larger part."""
    return decontaminate.clean(docs, decontaminate.matchers(table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs).select(*map(quoted, docs.columns))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: id, size, checksum, shard and place in the shard of every row."""
    return sharding.shard(docs)


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]

#: SQL has neither the character models nor the fingerprints; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row for each document and repetition in the shards."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
