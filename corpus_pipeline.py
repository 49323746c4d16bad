"""The corpus pipeline: documents in, token files out.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and
all but the last return documents with their columns.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import cut, file_order, release, table
from tabloom.llm.curriculum_mix import mixture
from tabloom.llm.min_max_dedup import deduplicate
from tabloom.llm.simhash_decontam import decontaminate
from tabloom.llm.site_quality import keep_good
from tabloom.llm.token_files import token_digests

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return deduplicate(docs, width=5, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: documents as often as their source's target asks, in curriculum order."""
    return mixture(docs)


#: Session setting: where the token files of each run get a folder of their own that stays.  Without it they
#: lie in the run's shared folder, which goes with the process.
TOKENS_DIR = "spark.tabloom.tokens.dir"


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the mix trains, and a row per document read back from them.

    The order is that of the rows in the files of the stage before; documents that aren't read straight
    from files stand by doc_id.
    """
    root = spark.conf.get(TOKENS_DIR, None)
    folder = f"{root.rstrip('/')}/run-{uuid.uuid4().hex[:12]}" if root else None
    placed, order = file_order(docs, ["doc_id", "text"])
    return token_digests(placed, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, folder=folder, order=order).drop("shard")


def _fresh(stage: Stage) -> Stage:
    """The stage, begun when what the one before needed on disk to shuffle is gone."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _fresh(quality)),
    ("near-dedup", _fresh(near_dedup)),
    ("benchmark decontamination", _fresh(decontamination)),
    ("mixing", _fresh(mixing)),
    ("token output", _fresh(token_output)),
]

#: SQL can express neither the classifier nor the hash order of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
