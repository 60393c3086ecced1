"""From raw documents to token-id files: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the cluster's shared folder
and read again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.

1. language: documents go that the kernel model rejects: no letter, or a score under ``language.LEAST_SCORE`` for every
   language.
2. near_dedup: of each class of near copies (five-word SimHash in the Gray-order index, checked and completed by exact
   Jaccard similarity of 0.8 or more) the document with the smallest doc_id stays.
3. decontaminate: documents that hold a benchmark item, verbatim or with other numbers and names, go.
4. mix: documents are repeated, or left out, as the capped water-filling of sources takes them.
5. tokens: the remaining documents are written as Simple-8b token-id files; one row for each document read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planloom.llm import decontaminate, language, mixing, near_copies, token_files
from planloom.llm.common import scratch, shrink_heaps, table
from planloom.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)  # the mix grew them, and the tokenizers come on top
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: Kernel models, similarity classes and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
