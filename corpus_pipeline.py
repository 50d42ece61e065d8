"""A training corpus from documents: quality rules, near-duplicate removal, surrogates for personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and is the next stage's docs. Nulls, empty tables,
ties, repeated rows and further columns have the results that the operators define."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlux.llm._durable import shared_dir
from parlux.llm.mixing import mix_sources
from parlux.llm.neardup import keep_first
from parlux.llm.packing import pack
from parlux.llm.pii import replace_private
from parlux.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the repetition rules."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return keep_first(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data."""
    return replace_private(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 2048."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mixture", mixture), ("packing", packing)]
#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder as Parquet and read again by the next one. What a stage has
    read goes once the stage is written; the last one's input stays, as the result reads it."""
    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
