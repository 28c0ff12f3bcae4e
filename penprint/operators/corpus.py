"""Raw rows to normalized corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import (
    LABEL_KEYS,
    STORY_TEXT_KEYS,
    build_metadata,
    first_nonempty,
    normalize_label,
)
from ..schemas import CORPUS

DOMAIN = "creative_writing"


def pick_field(rows: DataFrame, keys: list[str]) -> Column:
    """First non-empty value among the keys that the rows have."""
    return first_nonempty([F.col(f"`{k}`") for k in keys if k in rows.columns])


def tag_dataset(rows: DataFrame, source: str, domain: str = DOMAIN) -> DataFrame:
    return rows.withColumns({"source": F.lit(source), "domain": F.lit(domain)})


def _examine(rows: DataFrame, text_keys: list[str], label_keys: list[str]) -> DataFrame:
    """Chosen text and label, and what is wrong with the row, if anything."""
    text, spelled = pick_field(rows, text_keys), pick_field(rows, label_keys)
    label = normalize_label(spelled)
    problem = (
        F.when(text.isNull(), F.lit("no text field"))
        .when(spelled.isNull(), F.lit("no label field"))
        .when(label.isNull(), F.concat(F.lit("unknown label: "), spelled))
    )
    return rows.select(
        text.alias("text"),
        label.alias("label"),
        build_metadata(F.col("split"), F.col("raw")).alias("metadata"),
        problem.alias("problem"),
    )


def normalize_rows(
    rows: DataFrame, source: str, text_keys: list[str] | None = None, label_keys: list[str] = LABEL_KEYS
) -> DataFrame:
    """Corpus rows; a row without text or with an unknown label fails the job."""
    seen = _examine(rows, text_keys or STORY_TEXT_KEYS[source], label_keys)
    fail = F.raise_error(F.concat(F.col("problem"), F.lit(" in row: "), F.col("metadata.raw")))
    checked = seen.withColumn("label", F.when(F.col("problem").isNull(), F.col("label")).otherwise(fail))
    return tag_dataset(checked, source).select(*CORPUS.names)


def quarantine_rows(
    rows: DataFrame, source: str, text_keys: list[str] | None = None, label_keys: list[str] = LABEL_KEYS
) -> tuple[DataFrame, DataFrame]:
    """Good corpus rows, and the others as ``(split, raw, problem)``."""
    seen = _examine(rows, text_keys or STORY_TEXT_KEYS[source], label_keys)
    good = tag_dataset(seen.where(F.col("problem").isNull()), source).select(*CORPUS.names)
    bad = seen.where(F.col("problem").isNotNull()).select("metadata.split", "metadata.raw", "problem")
    return good, bad


def author_rows(df: DataFrame) -> DataFrame:
    """An author corpus in the common layout; absent columns get defaults.

    Nulls in columns that are present stay null.
    """
    for name in ("text", "label"):
        if name not in df.columns:
            raise ValueError(f"author corpus has no column {name}")
    source = F.col("source") if "source" in df.columns else F.lit("gutenberg")
    domain = F.col("domain") if "domain" in df.columns else F.lit("prose")
    raw = F.to_json("metadata") if "metadata" in df.columns else F.lit("{}")
    if dict(df.dtypes).get("metadata") == "string":
        raw = F.col("metadata")
    return df.select(
        F.col("text").cast("string").alias("text"),
        F.col("label").cast("string").alias("label"),
        source.cast("string").alias("source"),
        domain.cast("string").alias("domain"),
        build_metadata(F.lit(None), raw).alias("metadata"),
    )


def corpus_union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all corpora, duplicates kept."""
    if not parts:
        raise ValueError("no corpus to unite")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
