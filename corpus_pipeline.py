"""A corpus pipeline: five stages, each written and read again before the next one works on it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm.common import join_measured, numbered, row_column
from fathomline.llm.mixing import mixed_documents
from fathomline.llm.packing import pack_documents
from fathomline.llm.queries import toxicity_model, vocabulary
from fathomline.llm.simhash import simhash_groups
from fathomline.llm.suffix_dedup import repeated_passages, without_repeats
from fathomline.llm.toxicity import THRESHOLD, score_documents
from fathomline.session import checkpoint_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is under the threshold. The model is learned from labelled documents of this stage's input."""
    return score_documents(docs, toxicity_model(spark, docs, sf_dir), keep=THRESHOLD)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies: fingerprints of three-word shingles, linked at three or fewer differing bits.

    Rows are told apart by numbers of their own, in the order of doc_id, null
    last: rows that share an id, or have none, are judged by their own texts.
    """
    rows, row = numbered(docs), row_column(docs)
    groups = simhash_groups(rows.select(F.col(row).alias("doc_id"), "text"))
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("__gone"))
    return join_measured(rows, gone, F.col(row) == F.col("__gone"), "left_anti").drop(row)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less the passages that stand in an earlier place.

    Each row is searched and cut by a number of its own: rows that share an id
    are documents of their own, and those without one come last.
    """
    rows, row = numbered(docs), row_column(docs)
    found = repeated_passages(rows.select(F.col(row).alias("doc_id"), "text"))
    return without_repeats(rows, found, row).drop(row)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources in training order; documents taken twice stand twice."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences the documents are packed into."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

# The model, the fingerprints and the tokenizer are beyond SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``.

    Every stage works on rows: null and repeated ids, null, empty and long texts
    have the results its operator states. Columns of documents that no stage
    knows stay as they are until the texts are packed. An empty table gives no
    pieces.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
