"""From raw documents to packed sequences: quality, boilerplate lines, near-duplicates, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir).  All but the last return the columns of ``documents``;
each works on all rows that its predecessor kept, written as Parquet and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specaudit.llm.common import mark, materialize, sweep
from specaudit.llm.decontaminate import drop_contaminated
from specaudit.llm.line_dedup import drop_boilerplate
from specaudit.llm.packing import pack
from specaudit.llm.quality import keep_good
from specaudit.llm.simhash import near_duplicate_survivors


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that are boilerplate on its source; ``n_chars`` follows the text."""
    return drop_boilerplate(docs).select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicate_survivors(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    # workers live through all stages, so the last one keeps its memo of words small
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=120_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("near-dedup", without_near_duplicates),
    ("decontamination", without_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        sweep(since, docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, SimHash and BM25 are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None
