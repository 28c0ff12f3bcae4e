"""Cutting texts into chunks. Each text is one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_text, paragraphs, strip_header_footer, windows
from ..functions.text import filename_metadata, rule_sentences
from ..functions.arrays import bind


def clean_texts(texts: DataFrame, column: str = "raw_text") -> DataFrame:
    """Add ``text``: the marked part of a book with normalized white space."""
    return texts.withColumn("text", normalize_text(strip_header_footer(F.col(column))))


def filename_columns(texts: DataFrame, path: str = "source_path") -> DataFrame:
    """Add ``title`` and ``author`` read from the file name."""
    return texts.withColumn("_names", filename_metadata(F.col(path))).select(
        "*", "_names.title", "_names.author"
    ).drop("_names")


def _number(texts: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
    return texts.select(
        "text_id", *keep, F.posexplode(pieces).alias("chunk_id", "text")
    )


def chunk_texts(
    texts: DataFrame, mode: str = "paragraphs", window_size: int = 200, keep: list[str] = ()
) -> DataFrame:
    """``(text_id, chunk_id, text)``, numbered from 0 within each text."""
    text = F.col("text")
    if mode == "paragraphs":
        return _number(texts, paragraphs(text), list(keep))
    if mode == "window":
        return _number(texts, windows(text, window_size), list(keep))
    raise ValueError(f"unknown chunk mode: {mode}")


def sentences_by_rule(text: Column) -> Column:
    """Sentences of all paragraphs in order, split by punctuation."""
    return F.flatten(F.transform(paragraphs(text), rule_sentences))


def chunk_sentences(texts: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``(text_id, sentence_id, text)``, numbered from 1 across the whole text."""
    return texts.select(
        "text_id", *keep, F.posexplode(sentences_by_rule(F.col("text"))).alias("_i", "_s")
    ).select(
        "text_id", *keep, (F.col("_i") + 1).alias("sentence_id"), F.col("_s").alias("text")
    )


def limit_sentences(texts: DataFrame, limit: int | None, sentences: Column | None = None) -> DataFrame:
    """Keep the first ``limit`` sentences, joined by one space.

    0 or None means no limit and a negative number gives the empty text. ``sentences``
    is an array column from a parser; by default the punctuation rule is used.
    """
    if not limit:
        return texts
    if limit < 0:
        return texts.withColumn("text", F.lit(""))
    found = sentences if sentences is not None else sentences_by_rule(F.col("text"))
    return texts.withColumn(
        "text", bind(found, lambda s: F.array_join(F.slice(s, 1, limit), " "))
    )
