"""From raw documents to packed training sequences, in five stages.

Every stage works on all documents that the one before has kept; its result is written as Parquet in
the shared folder and read again. The stages but the last return the columns of documents. As a stage
begins, the tables that the stages before have written for themselves are deleted.

Nulls and odd input: texts that are null, empty or without a letter are rejected by the first stage; rows
with a null doc_id, lang or source pass all stages like others (each such text is a document of its own
to the near-dedup); a document that loses all its text to line dedup stays as an empty one and joins the
component of fingerprint zero; repeated rows become one in the near-dedup. An empty table gives an empty
result. Columns of any name beside those of documents are carried up to the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import op1_language_id, op2_mixing, op5_packing, op6_simhash, op10_line_dedup
from tessella.llm.common import documents, release, shared_dir, tables_written

_mark = 0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the language models reject go."""
    global _mark
    _mark = tables_written()
    return op1_language_id.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the common blocks that an earlier document has."""
    release(spark, _mark)
    return op10_line_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    release(spark, _mark)
    return op6_simhash.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    release(spark, _mark)
    return op2_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, their token ids and their place in a sequence."""
    release(spark, _mark)
    return op5_packing.packed(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]
#: SQL has no Kneser-Ney models, patience diff or XXH64 with a seed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
