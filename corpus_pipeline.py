"""A corpus cleaned, de-duplicated, scrubbed, mixed and packed, stage by stage.

Every stage takes what its predecessor kept, written as Parquet and read again; all but the last
return the columns of ``documents``. SQL can express neither the fitted classifier nor the
tokenizer, so there is no ORACLE_SQL and tests compare the stages with brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ruleweave.llm import mixing, packing, quality, secret_scan, simhash
from ruleweave.session import shared_folder
from ruleweave.sources import pointers

ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the labels are those of ``sf_dir``.

    A null text is judged as an empty one. A row without a doc_id has no label but is judged like any
    other; repeated rows are judged each by itself; an empty table stays empty.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash, the one with the smallest doc_id.

    Rows without a doc_id and repeated rows are members of their group like any other; null and empty
    texts are one group; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def scrubbed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null and empty texts and repeated rows stay as they are."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order that mixes their sources to target weights.

    A null source is a source, a null doc_id comes first in its source, repeated rows stand together, an
    empty table stays empty.
    """
    return mixing.arranged(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, packed in the stored order: one row per piece of a document.

    A null or empty text is its end mark alone, a null doc_id stays null, repeated rows are packed each
    by itself, an empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", unique), ("secrets", scrubbed), ("mix", mixed), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages applied to ``documents``; what each keeps is a table in ``folder``.

    Without ``folder`` a run gets a new one in the shared folder. A run that is given the folder of an
    earlier one goes on after its last finished stage.
    """
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        if not pointers.exists(spark, f"{folder}/{name}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
