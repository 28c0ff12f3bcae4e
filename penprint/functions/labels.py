"""Field choice and label spelling for raw corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip
from .words import HUMAN_LABELS, LLM_LABELS

# Keys tried in this order.
STORY_TEXT_KEYS = {
    "detectrl": ["text", "story", "content", "prompt"],
    "ghostbuster": ["text", "story", "document", "content"],
}
LABEL_KEYS = ["label", "source", "generated", "is_ai", "ai_generated"]


def first_nonempty(columns: list[Column]) -> Column:
    """First value that is neither null nor the empty string; blanks count as values."""
    return F.coalesce(
        *[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(None).cast("string")
    )


def normalize_label(raw: Column) -> Column:
    """``human``, ``llm``, or null for a spelling that is not known."""
    text = F.lower(strip(raw.cast("string")))
    return F.when(text.isin(HUMAN_LABELS), F.lit("human")).when(
        text.isin(LLM_LABELS), F.lit("llm")
    )


def build_metadata(split: Column, raw: Column) -> Column:
    return F.struct(
        F.nullif(split.cast("string"), F.lit("")).alias("split"), raw.cast("string").alias("raw")
    )
