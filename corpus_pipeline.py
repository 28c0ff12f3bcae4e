"""A corpus prepared for training: rules, line dedup, near-dedup, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on what its predecessor kept. Each
result but the last is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from penprint.llm.decontam import without_contaminated
from penprint.llm.linedup import without_repeated_lines
from penprint.llm.minhash import near_duplicates
from penprint.llm.packing import pack_documents
from penprint.llm.quality import kept_documents, word_list
from penprint.llm.queries import public_encoder
from penprint.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many texts of a source share."""
    cut = kept_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match earlier ones; documents without words left go."""
    cut = without_repeated_lines(docs).where(F.size(word_list(F.col("text"))) > 0)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, by shingles of five words."""
    gone = near_duplicates(docs, words_per_shingle=5).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 1024."""
    return pack_documents(docs, public_encoder())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

# Packing by token ids is not for SQL; a brute-force version checks the whole in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
