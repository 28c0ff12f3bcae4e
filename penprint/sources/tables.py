"""Parquet corpora, feature tables and parse caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import strip
from ..operators.corpus import author_rows
from ..schemas import CACHE, METADATA
from .files import exists


def read_author_corpus(spark: SparkSession, path: str) -> DataFrame:
    return author_rows(spark.read.parquet(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "text" not in df.columns:
        raise ValueError("a feature table needs a text column")
    return df


def read_parse_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache rows; the layout is given, so nothing is inferred. Blank lines are skipped."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no parse cache at {path}")
    return spark.read.schema(CACHE).json(path, mode="FAILFAST")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).csv(path, header=True, escape='"', multiLine=True)


def metadata_row_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of metadata rows as a one-row table, 0 when there is no such file."""
    rows = (
        read_metadata(spark, path)
        if exists(spark, path)
        else spark.createDataFrame([], METADATA)
    )
    return rows.agg(F.count("*").alias("metadata_rows"))


def literal_words(
    spark: SparkSession, base: list[str], extra: str = "", path: str | None = None
) -> DataFrame:
    """Distinct words of the base list, a comma list and the lines of a file."""
    listed = spark.createDataFrame([(w,) for w in [*base, *extra.split(",")]], "word string")
    if path:
        listed = listed.unionByName(spark.read.text(path).withColumnRenamed("value", "word"))
    return listed.select(F.lower(strip(F.col("word"))).alias("word")).where("word <> ''").distinct()


def as_word_list(words: DataFrame, limit: int | None = None) -> list[str]:
    """The words as a list for use in an expression; refuses lists beyond a given limit."""
    rows = (words if limit is None else words.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"more than {limit} literal words")
    return sorted(r.word for r in rows)
