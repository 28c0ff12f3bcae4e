"""Texts, or a parse cache, to feature rows, motif counts and metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import paragraphs
from ..operators import chunks as ch, features as ft, motifs as mo, parses as pa
from ..session import materialize


@dataclass
class SyntaxTables:
    """What one run produces. ``sentences`` is set in sentence mode only."""

    features: DataFrame
    motifs: DataFrame
    metadata: DataFrame
    sentences: DataFrame | None = None

    def wide(self, motifs: list[str] | None = None) -> DataFrame:
        """Feature rows with motif columns; without a list every motif gets one."""
        return mo.motif_pivot(self.features, self.motifs, motifs)


def _whole_text_parses(texts: DataFrame, make_parser: Callable[[], pa.Parser]) -> DataFrame:
    return pa.parse_with(
        texts.select("text_id", F.lit(0).alias("chunk_id"), "text"),
        make_parser,
        pieces=paragraphs(F.col("text")),
    )


def syntax_tables(
    texts: DataFrame,
    make_parser: Callable[[], pa.Parser],
    chunk_mode: str = "paragraphs",
    window_size: int = 200,
    max_sentences: int = 0,
    motif_mode: str = "category",
    literal_words: list[str] = (),
    min_leaves: int = mo.MIN_LEAVES,
) -> SyntaxTables:
    """``texts`` has ``text_id, title, author, source_path, raw_text``.

    The parser runs once per text (twice with ``max_sentences``, which needs sentences
    before the text is cut); its output is written before features and motifs read it.
    """
    if chunk_mode not in ("paragraphs", "window", "sentences"):
        raise ValueError(f"unknown chunk mode: {chunk_mode}")
    cleaned = ch.clean_texts(texts)
    if max_sentences:
        limited = _whole_text_parses(cleaned, make_parser)
        cleaned = ch.limit_sentences(
            limited, max_sentences, F.transform("sents", lambda s: s["text"])
        )
    if chunk_mode == "sentences":
        parses = pa.sentence_rows(_whole_text_parses(cleaned, make_parser))
    else:
        parses = pa.parse_with(ch.chunk_texts(cleaned, chunk_mode, window_size), make_parser)
    parses = materialize(parses)
    metadata = texts.select(
        F.col("text_id").alias("id"), "title", "author", F.col("source_path").alias("path")
    )
    return SyntaxTables(
        ft.chunk_features(parses),
        mo.motif_counts(parses, motif_mode, literal_words, min_leaves),
        metadata,
        parses if chunk_mode == "sentences" else None,
    )


def syntax_tables_from_cache(
    cache: DataFrame,
    motif_mode: str = "category",
    literal_words: list[str] = (),
    min_leaves: int = mo.MIN_LEAVES,
) -> SyntaxTables:
    """Sentence features from cached parses; no parser and no Python workers."""
    parses = pa.parses_from_cache(cache)
    return SyntaxTables(
        ft.chunk_features(parses),
        mo.motif_counts(parses, motif_mode, literal_words, min_leaves),
        ft.metadata_first_wins(cache),
        parses,
    )


def cache_of(tables: SyntaxTables) -> DataFrame:
    """Cache rows of a sentence-mode run, ready for ``write_parse_cache``."""
    if tables.sentences is None:
        raise ValueError("a parse cache is written in sentence mode only")
    named = ft.attach_metadata(tables.sentences, tables.metadata)
    return pa.cache_rows(named.withColumnRenamed("path", "source_path"))
