"""A corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, sanitising, packing.

Each stage works on all that the one before kept; a stage's result is written as Parquet in the shared folder and read again. All stages but
the last return the columns of the documents. See the operators for what they do with nulls, empty and long texts, ties, repeated rows and
empty tables. With two or more columns of the same name the input is refused by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assimspark.llm.common import materialise, read_table
from assimspark.llm.decontaminate import drop_leaks
from assimspark.llm.near_join import one_of_each
from assimspark.llm.packing import pack, with_checksum
from assimspark.llm.privacy import sanitise
from assimspark.llm.quality_rules import learn_rules, with_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    rules = learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return with_quality(docs, rules).where("__q_kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def near_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced; n_chars follows the text."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return with_checksum(pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_join", near_join),
    ("decontaminate", decontaminate),
    ("privacy", privacy),
    ("packing", packing),
]
#: SQL can't express the learned rules, edit matching, tokenizer and packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
