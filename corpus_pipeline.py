"""A corpus pipeline of five stages, each on the tables of the stage before.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of
``documents``; the last one returns the packed pieces.  ``run`` writes each stage's
rows as Parquet to the shared folder and reads them again, so a lost executor costs
one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontamination, linededup, neardup, packing, queries, shared, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the network scores 0.3 or more go; it learns from all labelled rows but those of fold 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = toxicity.fit(docs, labels, queries.fold_of("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, network, threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go, and documents of which nothing is left; n_chars follows the text."""
    return linededup.remove_repeats(docs, length="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 ids."""
    return packing.pack(docs, queries.tokenizer_path(), end_id=queries.END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained network and a tokenizer are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = shared.Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return docs
