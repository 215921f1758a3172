"""Corpus pipeline: quality rules, language ID, near-duplicates, packing.

Every stage reads what the one before it stored. Rows with nulls are judged like any other:
a null text has no words, so the quality rules reject it; a null source has no host verdict;
a null doc_id takes part in near-duplicates and packing, and is no training row. Repeated
rows are copies of each other, of which one stays. An empty table gives an empty result.
Extra columns pass through the filtering stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bayworks.llm import host_rules, languages, packing, simhash
from bayworks.llm.common import held_out, short_batches
from bayworks.session import scratch_folder


def quality_rules(spark, docs, sf_dir):
    """Documents that fail their own rules, or come from a host that mostly fails, go."""
    short_batches(spark)
    return host_rules.keep(docs)


def language_id(spark, docs, sf_dir):
    """Documents without a letter, or whose language cannot be told, go."""
    short_batches(spark)
    model = languages.fit(docs, ~held_out(F.col("doc_id"), 5, 0))
    return languages.keep_identified(docs, model)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate component stays."""
    short_batches(spark)
    return simhash.keep_one(docs)


def best_fit_packing(spark, docs, sf_dir):
    """The places of all pieces of all remaining documents in sequences of 1024 ids."""
    short_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Languages, fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order; each one's result is stored and read again as the next one's input."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
