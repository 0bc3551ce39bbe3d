"""Corpus pipeline: five operators of ``plumbline.llm`` applied one after another.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but
the last return the columns of ``documents``; the last returns what the token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import _runtime as R
from plumbline.llm import decontaminate as leaks
from plumbline.llm import mixing, neardup, quality, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Labels come from all labelled documents, as in training on the whole corpus; those of other
    rows (crc32 of the id divisible by 5) are never used.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are at 80 percent similarity or more."""
    return neardup.deduplicated(docs)


def not_in_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs."""
    judged = leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 of each copy."""
    return tokens.read_back(tokens.write(docs, tokens.default_tokenizer()))


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_near_duplicates),
    ("benchmark decontamination", not_in_benchmarks),
    ("source mix", mixed_sources),
    ("token files", token_files),
]

#: The classifier, the sketches and the tokenizer are outside SQL; tests hold run() against
#: brute-force forms of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = R.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
