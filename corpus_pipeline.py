"""A corpus pipeline over the training-data operators: each stage works on the rows that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill import ship
from gristmill.llm.common import shared_path
from gristmill.llm.exact_dedup import exact_dedup_rows
from gristmill.llm.language_id import fit, identified_rows
from gristmill.llm.mixing import Mix
from gristmill.llm.near_dedup import near_duplicate_rows
from gristmill.llm.packing import pack


# What holds for every stage: rows keep all their columns, whatever their names (packing returns pieces instead); an empty
# table gives an empty one; very long texts are read whole.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language was found.

    Null texts and texts without a letter go; so does every row where no row has a language to learn from. Repeated rows and
    rows with a null doc_id are judged one by one. Equal votes: see the operator; they drop nothing.
    """
    return identified_rows(docs, fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the one with the largest doc_id, null below all others; of repeated rows, any one.

    A null text counts as empty.
    """
    return exact_dedup_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest doc_id, null above all others.

    Of repeated rows, any one. Null texts and texts without words are near nothing, and all stay.
    """
    return near_duplicate_rows(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: in part, or up to three times, each time a row.

    Documents without words (null texts too) give nothing. A null source is a source. Repeated rows and rows with a null
    doc_id take part each. Reruns agree.
    """
    return Mix(docs).documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences' pieces with their ids. Null and empty texts are the end id alone; each row is packed, repeated or not."""
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: No SQL can express the learned, hashed and drawn stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
